import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.llm import exact_dedup, mixing, sharding, token_files

ODD = [(1, "Same\nText", "a"), (2, "same\ntext", None), (3, None, "a"), (4, "", None), (5, "x " * 5000, "b"), (6, "b", "b"), (6, "b", "b"), (7, "ÄB", "é"), (8, "äB", "é")]


def odd(spark, rows=ODD):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("key", F.lit("clash")).withColumn("size", F.lit("clash"))


@pytest.mark.parametrize(("capacity", "rows"), [(2, 200_000), (4096, 200_000), (2, 0)])
def test_exact_dedup(spark, sf, monkeypatch, capacity, rows):
    """With rows = 0 nothing is broadcast by its size: the way that large tables go."""
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", rows)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source")
    docs = docs.union(docs.where("doc_id % 3 = 0").withColumn("doc_id", F.col("doc_id") + 100000)).unionByName(odd(spark).select("doc_id", "text", "source"))
    rows = docs.collect()
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    groups = defaultdict(list)
    for r in rows:
        groups[lower(r.text)].append(r.doc_id)
    import hashlib

    want = sorted((d, max(g), len(g), d == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for d in g)
    got = sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.classify(docs, capacity).collect())
    assert got == want
    # keys that collide: all rows still come through the buckets, chains are told apart by their bytes
    crowded = exact_dedup.classify(docs, capacity, key=lambda n: F.octet_length(n) % 5 * (1 << 60)).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in crowded) == want
    assert {r.bucket for r in crowded} and len({r.bucket for r in crowded}) == (3 if capacity == 2 else 1)
    index = exact_dedup.build_index(exact_dedup.entries(docs, lambda n: F.octet_length(n) % 5 * (1 << 60)), capacity)
    assert index.chains.count() == len(groups) and index.chains.groupBy("key").count().count() == 5


def test_beyond_the_bound_texts_are_grouped_before_they_move(spark, monkeypatch, capfd):
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", 0)
    seen = []
    keep = exact_dedup.stored
    monkeypatch.setattr(exact_dedup, "stored", lambda df, name: (seen.append((name, df._jdf.queryExecution().sparkPlan().toString())), keep(df, name))[1])
    ent = exact_dedup.entries(spark.createDataFrame([(i, "copy") for i in range(500)] + [(i, str(i)) for i in range(500, 600)], "doc_id long, text string"))
    exact_dedup.build_index(ent)
    (plan,) = [p for name, p in seen if name == "dedup-classes"]
    join = plan.index("Join")
    assert "Aggregate" in plan[join:] and "Aggregate" not in plan[:join]  # the texts' side is grouped below the join


def test_directory_splits_overfull_buckets(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("key"))
    slots, depth, n = exact_dedup.directory(keys, 100)
    rows = slots.collect()
    placed = keys.withColumn("slot", exact_dedup.slot_of(F.col("key"), depth)).join(slots, "slot").groupBy("bucket").count().collect()
    assert depth > 0 and len(rows) == n and all(r["count"] <= 100 for r in placed)
    assert sum(r["count"] for r in placed) == 5000
    close = spark.createDataFrame([(i << 50,) for i in range(300)], "key long")  # equal leading bits: the directory doubles on
    slots, depth, n = exact_dedup.directory(close, 100)
    placed = close.withColumn("slot", exact_dedup.slot_of(F.col("key"), depth)).join(slots, "slot").groupBy("bucket").count().collect()
    assert depth == 8 and n == 5 and sorted(r["count"] for r in placed) == [44, 64, 64, 64, 64]
    assert exact_dedup.classify(odd(spark, [])).count() == 0


def test_token_files(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(odd(spark).select((F.col("doc_id") - 50).alias("doc_id"), "text"))
    docs = docs.unionByName(spark.createDataFrame([(-9, "A<|endoftext|>b İ Σ.  x y é \x1c z")], "doc_id long, text string"))
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(token_files.vocabulary())
    folder = f"file://{tmp_path}/set"
    bases = token_files.write(docs, folder)
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    got = sorted(token_files.read_documents(spark, folder).collect(), key=lambda r: (r.doc_id, r.start))
    start = 0
    for r, g in zip(rows, got, strict=True):
        ids = [*lib.encode(r.text or "", add_special_tokens=False).ids, 1]
        assert (g.doc_id, g.start, g.n_tokens) == (r.doc_id, start, len(ids))
        assert g.ids_crc32 == zlib.crc32(np.asarray(ids, "<u4").tobytes())
        start += len(ids)
    assert sum(b["n_tokens"] for b in bases) == start
    empty = f"file://{tmp_path}/empty"
    token_files.write(odd(spark, []), empty)
    assert token_files.read_documents(spark, empty).count() == 0
    with pytest.raises(ValueError):
        token_files.local_path("hdfs://x/y")


def brute_targets(sizes, share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, out, todo = share * sum(sizes.values()), {}, set(names)
    while todo:
        level = left / sum(weight[s] for s in todo)
        over = [s for s in todo if level * weight[s] > cap * sizes[s]]
        if not over:
            return out | {s: level * weight[s] for s in todo}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
            todo.discard(s)
    return out


def check_mix(rows, docs):
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
        assert r.taken in (r.size * k for k in range(3)) and r.taken <= 2 * r.size
    want = brute_targets(dict(sizes))
    assert len(rows) == docs
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] + 1e-6


def test_mixing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source")
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "src0").otherwise(F.col("source"))).unionByName(odd(spark).select("doc_id", "text", "source"))
    rows = mixing.mix(docs).collect()
    check_mix(rows, docs.count())
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)
    assert mixing.mix(odd(spark, [])).count() == 0
    assert [r.taken for r in mixing.mix(odd(spark, [(1, None, None)])).collect()] == [0]


def test_mixing_is_unbiased(spark):
    rows = [(i, "w " * (1 + i % 7), "s") for i in range(300)] + [(i, "w " * 40, "t") for i in range(300, 320)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    check_mix(got, 320)
    t = [r for r in got if r.source == "s"]
    ratio = t[0].target / t[0].source_size
    assert abs(np.mean([r.copies for r in t]) - ratio) < 0.1


def test_repeated_rows_are_spread(spark):
    docs = spark.createDataFrame([(7, "w x y", "s")] * 3000 + [(None, "a b", "s"), (None, None, None)], "doc_id long, text string, source string")
    rows = mixing.mix(docs).collect()
    check_mix(rows, 3002)
    sized = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "source", F.lit(3).cast("long").alias("size"))
    assert mixing.numbered(sized.where("doc_id = 7")).agg(F.count_distinct("copy")).first()[0] == 3000


def brute_capacity(sizes, shards):
    def ok(c):
        n, room = 1, c
        for s in sizes:
            if s > c:
                return False
            if s > room:
                n, room = n + 1, c
            room -= s
        return n <= shards

    low, high = 1, sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if ok(mid) else (mid + 1, high)
    return low


@pytest.mark.parametrize("bits", [1, 4, 12])
def test_smallest_capacity(spark, bits, monkeypatch):
    monkeypatch.setattr(sharding, "FIRST_BITS", bits)
    rnd = random.Random(bits)
    rows = [(rnd.getrandbits(63), rnd.choice([20, 400, 3000])) for _ in range(800)] + [(rnd.getrandbits(63), 40000)]
    firsts, capacity = sharding.cut_keys(spark.createDataFrame(rows, "key long, size long"), 7)
    assert capacity == brute_capacity([s for _, s in sorted(rows)], 7)
    per = defaultdict(int)
    for k, s in rows:
        per[sum(k >= f for f in firsts)] += s
    assert max(per.values()) <= capacity


def test_sharding(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(odd(spark).select("doc_id", "text"))
    rows = sharding.assign(docs).collect()
    texts = defaultdict(set)
    src = defaultdict(list)
    for r in docs.collect():
        src[r.doc_id].append(r.text or "")
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        t = next(t for t in src[r.doc_id] if zlib.crc32(t.encode()) == r.text_crc32)
        texts[t].add(r.shard)
        assert r.size == len(t.encode()) + 16
    assert all(len(s) == 1 for s in texts.values()) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert set(slots) <= set(range(40)) and len(rows) == docs.count()
    assert sharding.assign(odd(spark, [])).count() == 0
