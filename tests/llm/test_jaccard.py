import random
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewheel.llm import jaccard
from tidewheel.llm.components import components


def shingle_set(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [(d, shingle_set(t)) for d, t in rows]
    inv = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for x in s:
            inv[x].append(i)
    up = list(range(len(sets)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, (_, s) in enumerate(sets):
        n = defaultdict(int)
        for x in s:
            for j in inv[x]:
                if j < i:
                    n[j] += 1
        for j, k in n.items():
            if 100 * k >= 75 * len(s | sets[j][1]):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(s), least[find(i)]) for i, (d, s) in enumerate(sets))


def planted():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(60)]
    rows, base = [], [word() for _ in range(80)]
    for _ in range(60):  # near copies of one text, some beyond the threshold
        t = base[:]
        for _ in range(rnd.randint(0, 4)):
            t[rnd.randrange(80)] = word()
        rows.append(" ".join(t))
    for _ in range(60):  # a shared passage
        rows.append(" ".join([word() for _ in range(rnd.randint(5, 60))] + passage))
    for n in (1, 2, 4, 5, 6):
        t = [word() for _ in range(n)]
        rows += [" ".join(t), "  " + " ".join(t).upper() + "\n"]
    rows += ["", None, " \t", "a b c d", "a b c d e"]
    rows += [rows[0]] * 20
    chain = [word() for _ in range(60)]
    for k in range(12):
        rows.append(" ".join(chain[k : k + 48]))
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


def test_planted(spark):
    rows = planted()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, sig string, n int").repartition(3)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect())
    assert got == brute(rows)


def brute_links(rows):
    """doc_id -> the number of other sets that its set links with."""
    sets = {d: frozenset(shingle_set(t)) for d, t in rows}
    kinds = [s for s in set(sets.values()) if s]
    n = {s: sum(4 * len(s & o) >= 3 * len(s | o) for o in kinds) - 1 for s in kinds}
    return {d: n.get(s, 0) for d, s in sets.items()}


@pytest.mark.parametrize("size", [7, 128])
def test_every_link_is_counted(spark, monkeypatch, size):
    monkeypatch.setattr(jaccard, "BLOCK_CLASSES", size)
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = jaccard.near_duplicates(docs).collect()
    want = brute_links(rows)
    assert {r.doc_id: r.n_links for r in out} == want and max(want.values()) > 20
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == brute(rows)


def test_documents(spark, sf):
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.op3_jaccard_join(spark, sf).collect())
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got == brute(rows)


def test_null_ids_and_representatives(spark):
    t = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    rows = [(5, t), (5, t + "  "), (None, t + " 1"), (5, "one two three four five six"), (3, "one two three four five  six"), (None, "alone now"), (None, None), (4, "")]
    found = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted(((r.doc_id, r.component_id) for r in found.collect()), key=str)
    assert got == sorted([(5, 5), (5, 5), (None, 5), (5, 3), (3, 3), (None, None), (None, None), (4, 4)], key=str)
    assert sorted((r.doc_id for r in jaccard.representatives(found).collect()), key=str) == [3, 5, None]
    assert sorted((r.doc_id for r in jaccard.left_out(found).collect()), key=str) == [5, 5, None]


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.near_duplicates(none).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 40), min_size=1), st.lists(st.sets(st.integers(0, 40), min_size=1), min_size=1, max_size=8))
def test_divide_skip(q, cs):
    arr = lambda s: np.array(sorted(s), np.int64)
    got = jaccard.divide_skip(arr(q), len(q), [arr(c) for c in cs], np.array([len(c) for c in cs]))
    assert list(got) == [i for i, c in enumerate(cs) if 4 * len(q & c) >= 3 * len(q | c)]


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 105), (105, 101)]
    got = {r.v: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 105: 100}


def test_components_of_a_shuffled_chain(spark):
    ids = random.Random(3).sample(range(1 << 40), 2000)
    got = {r.v: r.root for r in components(spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long")).collect()}
    assert got == dict.fromkeys(ids, min(ids))


def test_components_raise_when_unfinished(spark):
    with pytest.raises(RuntimeError):
        components(spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long"), rounds=1)


def test_block_search_finds_every_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_CLASSES", 4)
    rnd = random.Random(2)
    base = list(range(60))
    rows = []
    for i in range(40):
        s = set(base) - set(rnd.sample(base, rnd.randint(0, 9))) | {1000 + 10 * i + k for k in range(rnd.randint(0, 3))}
        rows.append((i, len(s), sorted(x for x in s if x < 1000)))
    sets = spark.createDataFrame(rows, "sig long, n int, items array<long>").where("4 * size(items) >= 3 * n")
    short = F.slice("items", F.lit(1), F.size("items") - F.ceil(F.col("n") * 0.75).cast("int") + 1)
    postings = sets.select("sig", "n", F.size("items").alias("size"), F.explode(short).alias("item"), F.col("sig").alias("root"))
    got = {tuple(sorted((r.a, r.b))) for r in jaccard._open_links(postings, sets).collect()}
    kept = [r for r in rows if 4 * len(r[2]) >= 3 * r[1]]
    want = {(a[0], b[0]) for a in kept for b in kept if a[0] < b[0] and 7 * len(set(a[2]) & set(b[2])) >= 3 * (a[1] + b[1])}
    assert got == want and want
