import re
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from tidewheel.llm import quality

TEXTS = ["", None, "a b c a b c", "x y\n\nx y\n  \nz", "one two three " * 40, "ü#1 | <b> " * 20, "w " * 2, "a a a a a"]


def brute(t):
    t = t or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines), len(lines) - len(set(lines)), len(hit))


def test_measures(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(-i, t) for i, t in enumerate(TEXTS)] + [(-3, TEXTS[3])], docs.schema)
    for r in quality.ledger(docs.union(extra)).collect():
        assert tuple(r[m] for m in quality.MEASURES) == brute(r.text), r.doc_id


def test_policies_and_ablation(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_words int").withColumns({"_words": F.lit("mine"), "_again": F.lit(1)})
    led = quality.ledger(docs)
    assert {r["_words"] for r in led.collect()} == {"mine"} and "_words_" not in led.columns
    kept = quality.apply_policy(led).collect()
    for r in kept:
        env = {m: r[m] for m in quality.MEASURES}
        bits = sum(1 << i for i, c in enumerate(quality.RULES.values()) if eval(c, {}, env))
        assert r.failed_bits == bits and r.kept == (bits & quality.mask(quality.POLICIES[quality.CURRENT]) == 0)
    rows = {r.rule: r for r in quality.ablation(led, "v2").collect()}
    bits = [r.failed_bits for r in kept]
    for i, rule in enumerate(quality.RULES):
        assert rows[rule].n_failed == sum(b >> i & 1 for b in bits)
        assert rows[rule].n_only == sum(b == 1 << i for b in bits)
    assert quality.ablation(led.limit(0)).count() == 0


def test_ablation_of_the_stored_ledger_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{sf}/documents.parquet'")
    want = sorted(con.execute(quality.ABLATION_ORACLE).fetchall())
    assert sorted(map(tuple, quality.quality_ablation(spark, sf).collect())) == want
    assert "text" not in quality.stored_ledger(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")).columns
