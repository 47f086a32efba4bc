"""Exact deduplication with an extendible-hash index kept in the shared folder.

A text's key is the 64-bit hash of its normalised bytes. The directory has a slot for each value of a key's
leading bits and names the slot's bucket. While a bucket holds more than `capacity` distinct keys it is split
by one more bit, and where its depth is that of the directory, the directory doubles; it ends when no bucket
is overfull. Buckets are key ranges: owner tasks take contiguous ranges of them and write the index, one
folder of bucket files.

1. One scan of the texts stores each document's entry: doc_id, key, digest and the normalised bytes.
2. The directory is grown over the distinct keys with their number of documents.
3. Entries of keys with several documents are inserted by bucket: within a key, entries whose bytes are equal
   become one chain entry (Spark compares the bytes when it groups by them, first in the map tasks, so
   a group of copies of any size moves one text a task). A key with one document is its own chain entry.
4. A document finds its class by slot, bucket and key; where the key's chain has several entries, by its bytes.

DataFrame functions only. Defined cases: null counts as the empty text; of equal texts, also of repeated rows,
the largest doc_id stays (null doc_ids are less than all others); when rows repeat with the same doc_id, each of
them is kept if its doc_id is the one that stays; texts of any length are one entry; other columns of the
input, whatever their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower, join_hot, partitions, stored

CAPACITY = 4096
#: A directory beyond this many slots is joined by a shuffle instead of a broadcast.
BROADCAST_ROWS = 200_000
KEY_BITS = 64


def bounded(df: DataFrame, n: int) -> DataFrame:
    """df marked for broadcast if its n rows are within the bound."""
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def key_of(text):
    return F.xxhash64(text)


def normalised(text):
    """The text with A-Z lower-cased; null is empty. Spark's own lower() serves texts that are ASCII throughout."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(ascii_lower(t))


def entries(docs: DataFrame, key=key_of) -> DataFrame:
    """One row per document: doc_id, key, text_sha256 and the normalised text n."""
    return docs.select("doc_id", normalised(F.col("text")).alias("n")).select("doc_id", key(F.col("n")).cast("long").alias("key"), F.sha2("n", 256).alias("text_sha256"), "n")


def slot_of(key, depth: int):
    """A key's leading `depth` bits as a number."""
    return F.shiftrightunsigned(key, KEY_BITS - depth).cast("long") if depth else F.lit(0).cast("long")


def directory(keys: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, int, int]:
    """The directory of distinct keys (column `key`): (slot, local_depth, bucket), its depth and its number of slots.

    Starts at the depth an even spread asks for and doubles while a bucket is overfull. A slot's local depth is the
    least at which its bucket is not, so slots share a bucket until it had to be split. Slots without keys
    are left out. At 64 bits a bucket is one key, so the doubling ends."""
    n = keys.count()
    depth = max(0, -(-n // capacity) - 1).bit_length()
    while True:
        fine = stored(keys.groupBy(slot_of(F.col("key"), depth).alias("slot")).agg(F.count("*").alias("n")), "dedup-slots")
        full = fine.agg(F.count("*").alias("slots"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
        if full.most <= capacity or depth == KEY_BITS:
            break
        depth += 1
    levels = F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("d")
    by_level = fine.select("slot", "n", levels).withColumn("prefix", F.expr(f"shiftrightunsigned(slot, {depth} - d)"))
    fits = by_level.groupBy("d", "prefix").agg(F.sum("n").alias("held")).where(F.col("held") <= capacity).select("d", "prefix")
    local = by_level.join(fits, ["d", "prefix"]).groupBy("slot").agg(F.min("d").alias("local_depth"))
    out = local.withColumn("bucket", F.expr(f"shiftleft(shiftrightunsigned(slot, {depth} - local_depth), {depth} - local_depth)"))
    return out, depth, full.slots


class Index:
    """The stored index: `slots` (the directory), its `depth`, and `chains`, a row per class:
    bucket, key, chain (place in the key's chain), links (its length), text_sha256, keep_id, group_size; n, the
    class's bytes, only where the chain has several entries."""

    def __init__(self, slots: DataFrame, depth: int, n_slots: int, chains: DataFrame):
        self.slots, self.depth, self.n_slots, self.chains = slots, depth, n_slots, chains

    def placed(self, rows: DataFrame) -> DataFrame:
        """rows (key) with the bucket that the directory names for the key's slot."""
        at = rows.withColumn("slot", slot_of(F.col("key"), self.depth))
        # beyond the bound slots are shuffled, but for those that hold a hot key
        found = at.join(F.broadcast(self.slots), "slot") if self.n_slots <= BROADCAST_ROWS else join_hot(at, self.slots, "slot")
        return found.drop("slot", "local_depth")


def build_index(ent: DataFrame, capacity: int = CAPACITY) -> Index:
    keys = stored(ent.groupBy("key").agg(F.count("*").alias("held"), F.max("doc_id").alias("last"), F.min("text_sha256").alias("digest")), "dedup-keys")
    slots, depth, n_slots = directory(keys, capacity)
    index = Index(stored(slots, "dedup-directory"), depth, n_slots, None)
    placed = index.placed(keys)
    again = placed.where("held > 1").select("bucket", "key")
    inserted, n_again = ent.select("key", "n", "doc_id", "text_sha256"), again.count()
    figures = F.first("text_sha256").alias("text_sha256"), F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")
    if n_again <= BROADCAST_ROWS:
        classes = inserted.join(F.broadcast(again), "key").groupBy("bucket", "key", "n").agg(*figures)
    else:  # equal texts become one row in the map tasks before anything is dealt by key
        classes = inserted.groupBy("key", "n").agg(*figures).join(again, "key")
    classes = stored(classes.select("bucket", "key", "n", "text_sha256", "keep_id", "group_size"), "dedup-classes")
    links = classes.groupBy("key").agg(F.count("*").cast("int").alias("links"))
    chained = classes.join(links, "key").select("bucket", "key", "links", "text_sha256", "keep_id", "group_size", F.when(F.col("links") > 1, F.col("n")).alias("n"))
    single = placed.where("held = 1").select("bucket", "key", F.lit(1).alias("links"), F.col("digest").alias("text_sha256"), F.col("last").alias("keep_id"), F.col("held").alias("group_size"), F.lit(None).cast("string").alias("n"))
    owned = chained.unionByName(single).repartitionByRange(partitions(ent.sparkSession), "bucket", "key").sortWithinPartitions("bucket", "key", "text_sha256")
    index.chains = stored(owned, "dedup-index")
    return index


def classify(docs: DataFrame, capacity: int = CAPACITY, key=key_of) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, bucket."""
    ent = stored(entries(docs, key), "dedup-entries")
    index = build_index(ent, capacity)
    found = index.chains.where("links = 1").select("bucket", "key", "keep_id", "group_size")
    # the directory names the bucket of a document's slot; within the bucket the key names the chain
    narrow = index.placed(ent.select("doc_id", "key", "text_sha256"))
    single = join_hot(narrow, found, ["bucket", "key"]).select("doc_id", "keep_id", "group_size", "text_sha256", "bucket")
    chains = index.chains.where("links > 1").select("bucket", "key", "n", "keep_id", "group_size")
    if not chains.limit(1).count():
        out = single
    else:  # texts of one key that differ: the bytes tell the chain's entries apart
        several = chains.select("key").distinct()
        texts = index.placed(ent.join(bounded(several, several.count()), "key"))
        out = single.unionByName(texts.join(chains, ["bucket", "key", "n"]).select("doc_id", "keep_id", "group_size", "text_sha256", "bucket"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "bucket")


def op5_exact_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return classify(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = """WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)"""
