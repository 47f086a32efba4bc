"""Quality rules kept as a bitmask ledger: every rule is evaluated once, policies are applied to the bits.

Measurements and failure bits of a document are columns; a policy is a named, versioned set of rules, so
changing a policy or asking what a rule costs (`ablation`) never reads the texts again. DataFrame
functions only: no shuffle is needed for the ledger. `stored_ledger` writes it, without the texts, to the shared folder.

Defined cases: a null or empty text has no words and fails `few_words`; repeated rows give repeated
rows; the words of a text of any length are held as arrays of its row while it is measured; an empty table gives an empty ledger; other columns of the input are carried along by `ledger`,
but for those named like a measurement or `failed_bits`, which are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored, words

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

#: name -> condition over the measurements under which a document fails. The order gives the bit; append only.
RULES = {
    "few_words": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "many_words": "n_words > 1000000",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "100 * n_dup_lines > 30 * n_lines",
}
BASE = ("few_words", "repeats")
#: v3 leaves the length of a text to the reader of the ledger: a clean text of any length stays.
POLICIES = {"v1": BASE, "v2": tuple(RULES), "v3": tuple(r for r in RULES if r != "many_words")}
CURRENT = "v3"


def mask(rules) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in rules)


def _repeat_words(w: Column) -> Column:
    """Words inside a 3-word window that is found twice or more in the array, the first one included.

    Windows are compared by their 64-bit hash within one document."""
    windows = F.when(
        F.size(w) >= 3,
        F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p")))),
    )
    return windows


def _covered(s: Column) -> Column:
    again = F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]))
    return F.sort_array(F.transform(again, lambda x: x["p"]))


def _span(p: Column) -> Column:
    step = F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))))
    return F.coalesce(F.aggregate(step, F.lit(0), lambda a, b: a + b), F.lit(0)).cast("long")


def _free(names, columns) -> list[str]:
    """names, each with as many underscores more as it takes not to be one of columns."""
    out = []
    for n in names:
        while n in columns:
            n += "_"
        out.append(n)
    return out


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the measurements of MEASURES (long)."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(F.translate(x, " \t\n\x0b\f\r", "")) > 0)
    w, ls, windows, again = _free(("_words", "_lines", "_windows", "_again"), docs.columns)
    out = docs.withColumns({w: words(F.col(text)), ls: lines})
    out = out.withColumn(windows, _repeat_words(F.col(w)))
    out = out.withColumn(again, _covered(F.col(windows)))
    return out.withColumns(
        {
            "n_words": F.size(w).cast("long"),
            "word_chars": F.length(F.translate(t, " \t\n\x0b\f\r", "")).cast("long"),
            "n_symbols": (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long"),
            "n_lines": F.size(ls).cast("long"),
            "n_dup_lines": (F.size(ls) - F.size(F.array_distinct(ls))).cast("long"),
            "n_repeat_words": _span(F.col(again)),
        }
    ).drop(w, ls, windows, again)


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with measurements and `failed_bits` (long): bit i is set when rule i of RULES fails."""
    bits = [F.when(F.expr(c), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, c in enumerate(RULES.values())]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measure(docs, text).withColumn("failed_bits", total)


def fails(rules, bits: str = "failed_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(mask(rules)).cast("long")) != 0


def apply_policy(led: DataFrame, version: str = CURRENT) -> DataFrame:
    """The ledger with `policy` and `kept`; reads only the bits."""
    return led.withColumns({"policy": F.lit(version), "kept": ~fails(POLICIES[version])})


def ablation(led: DataFrame, version: str = CURRENT) -> DataFrame:
    """Per rule of a policy: rows that fail it, rows that fail only it (kept again without it), rows dropped in all.

    Rows are first counted per bit pattern (2^rules at most), so the shuffle does not grow with the table."""
    m = mask(POLICIES[version])
    names = list(RULES)
    patterns = led.select(F.col("failed_bits").bitwiseAND(F.lit(m).cast("long")).alias("bits")).groupBy("bits").agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).cast("long").alias("bit")) for r in POLICIES[version]])).alias("r")
    return (
        patterns.select("bits", "n", rules)
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
            F.sum(F.when(F.col("bits") != 0, F.col("n")).otherwise(0)).alias("n_dropped"),
        )
    )


def stored_ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """The ledger without the texts, written to the shared folder: policies and ablations read this table."""
    return stored(ledger(docs, text).drop(text), "quality-ledger")


def op7_quality_rules(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    led = apply_policy(stored_ledger(docs))
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "failed_bits", "policy", fails(BASE).alias("base_failed"), "kept")


def quality_ablation(spark, sf_dir):
    """What each rule of each policy costs, from the stored bits: policy, rule, n_failed, n_only, n_dropped."""
    led = stored_ledger(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return reduce(DataFrame.unionByName, [ablation(led, v).select(F.lit(v).alias("policy"), "rule", "n_failed", "n_only", "n_dropped") for v in POLICIES])


_PASS = " AND ".join(f"NOT ({RULES[r]})" for r in POLICIES[CURRENT])
_BITS = " + ".join(f"CASE WHEN {c} THEN {1 << i} ELSE 0 END" for i, c in enumerate(RULES.values()))

#: Relation `measured` over `source`: the measurements in DuckDB SQL.
MEASURED_SQL = r"""
w AS (SELECT *, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM {source}),
win AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
measured AS (SELECT w.* EXCLUDE (ws, ls), len(ws)::BIGINT AS n_words, 
    coalesce(length(list_aggregate(ws, 'string_agg', '')), 0)::BIGINT AS word_chars,
    length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
    FROM w LEFT JOIN rep USING (doc_id))"""

ORACLE = f"""WITH {MEASURED_SQL.format(source="documents")}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({_BITS})::BIGINT AS failed_bits, '{CURRENT}' AS policy,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, ({_PASS}) AS kept FROM measured"""


def _ablation_sql() -> str:
    parts = []
    for v, rules in POLICIES.items():
        m, names = mask(rules), list(RULES)
        for r in rules:
            bit = 1 << names.index(r)
            parts.append(f"SELECT '{v}' AS policy, '{r}' AS rule, count(*) FILTER (WHERE bits & {bit} <> 0) AS n_failed, count(*) FILTER (WHERE bits & {m} = {bit}) AS n_only, count(*) FILTER (WHERE bits & {m} <> 0) AS n_dropped FROM led")
    return f"WITH {MEASURED_SQL.format(source='documents')}, led AS (SELECT ({_BITS})::BIGINT AS bits FROM measured) " + " UNION ALL ".join(parts)


ABLATION_ORACLE = _ablation_sql()
