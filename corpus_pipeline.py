"""The corpus pipeline: quality rules, exact and near duplicates, mixing, encoding; one stage after the other.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read as the next
stage's docs. Every stage but the last returns the columns of documents (doc_id, text, lang, source, n_chars).

Defined cases: documents are told apart by doc_id and text together, so texts that share a doc_id, also a null
one, are documents of their own; of repeated rows with one doc_id and equal texts, one row stays after the exact
stage; null and empty texts have no words and leave with the quality rules, of texts that a stage is
given all the same the exact stage keeps one; texts of any length pass every stage whole; of ties in the near stage
(equal sets under one doc_id) the text with the least hash stays; columns beside those of documents, whatever their
names, are dropped by no stage but the last; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewheel.llm import byte_bpe, exact_dedup, jaccard, mixing, quality
from tidewheel.llm.shared import stored


def quality_rules(spark, docs, sf_dir):
    """Keeps the documents that the current policy accepts."""
    led = quality.ledger(docs.select(F.col("text").alias("_text"), F.struct(*docs.columns).alias("_row")), "_text")
    # the row's number keeps the optimiser from pushing the filter through the measurements, which would expand them into each other
    judged = led.select("_row", "failed_bits", F.monotonically_increasing_id().alias("_number"))
    return judged.where(~quality.fails(quality.POLICIES[quality.CURRENT]) & (F.col("_number") >= 0)).select("_row.*")


def _without(docs, key, gone):
    """docs but for the rows whose doc_id and key (a column) are in gone (doc_id, key; distinct); a long list is shuffled."""
    gone = stored(gone.toDF("_id", "_gone"), "pipeline-gone")
    rows = docs.withColumn("_key", key)
    few = exact_dedup.bounded(gone, gone.count())
    return rows.join(few, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_gone")), "left_anti")


def exact_duplicates(spark, docs, sf_dir):
    """Keeps the row with the largest doc_id of each group of equal texts."""
    found = stored(exact_dedup.classify(docs).select("doc_id", "text_sha256", "kept"), "pipeline-classes")
    digest = F.sha2(exact_dedup.normalised(F.col("text")), 256)
    rows = _without(docs, digest, found.where("not kept").select("doc_id", "text_sha256").distinct())
    again = found.where("kept").groupBy(F.col("text_sha256").alias("_key")).count().where("count > 1").select("_key")
    if again.limit(1).count():  # rows that repeat with the doc_id that stays: one of each group
        rows = rows.join(again, "_key", "left_anti").unionByName(rows.join(again, "_key", "left_semi").dropDuplicates(["_key"]))
    return rows.select(*docs.columns)


def near_duplicates(spark, docs, sf_dir):
    """Keeps one row of each component of near duplicates, one with its smallest doc_id."""
    found = stored(jaccard.near_duplicates(docs.select("doc_id", "text")), "pipeline-near")
    gone = jaccard.left_out(found).select("doc_id", "text_key").distinct()
    return _without(docs, F.xxhash64("text"), gone).select(*docs.columns)


def mix_sources(spark, docs, sf_dir):
    """Takes each document as many times as the mix does: copies are rows of their own."""
    keys = ["_id", "_text", "_source"]
    taken = mixing.mix(docs).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_text"), F.col("source").alias("_source"), "copies")
    taken = stored(taken.groupBy(*keys).agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows")), "pipeline-copies")
    marked = docs.withColumn("_key", F.xxhash64("text"))
    if taken.where("_rows > 1").limit(1).count():  # rows that repeat: the first stands for all of them
        marked = marked.dropDuplicates(["doc_id", "source", "_key"])
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_text")) & F.col("source").eqNullSafe(F.col("_source"))
    times = marked.join(taken.where("_copies > 0"), same).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return times.select(*docs.columns)


def encode(spark, docs, sf_dir):
    """Per row: doc_id, source, number of ids and the hashes of ids and decoded bytes."""
    return byte_bpe.digests(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_duplicates),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]

#: Mixing draws random numbers by Spark's hash, which SQL does not have: the stages are tested by brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
