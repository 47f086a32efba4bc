"""What the operators share: the shared folder, tables written to it, and global row order."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A word is a run of anything but space and the control characters tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        raise ValueError("spark.checkpoint.dir names the folder that driver and executors share; set it")
    return at.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: later steps survive lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c):
    """Lower-cases A-Z only; null stays null."""
    return F.translate(c, UPPER, LOWER)


def words(text):
    """The words of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES, -1), lambda w: w != "")


def count_words(text):
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def utf8_length(text):
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def in_order(df: DataFrame, keys: list[str], name: str, weight: str | None = None) -> DataFrame:
    """Adds `position`, the row's place (from 0) in the order of keys over the whole table; with `weight`, a column
    of whole numbers, the sum of the weights of all rows before it.

    Range partitions are written to the shared folder; a row's place is its place in its partition
    plus the rows of earlier partitions. Only one count per partition is broadcast."""
    n = partitions(df.sparkSession)
    part = (
        df.repartitionByRange(n, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumns({"_part": F.shiftright("_at", 33), "_place": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
        .drop("_at")
    )
    part = stored(part, name)
    if weight:
        before = W.partitionBy("_part").orderBy("_place").rowsBetween(W.unboundedPreceding, W.currentRow)
        base = part_bases(part.groupBy("_part").agg(F.sum(weight).cast("long").alias("_n")), "_n", "_base")
        part = part.withColumn("_place", F.sum(weight).over(before) - F.col(weight))
    else:
        base = part_bases(part.groupBy("_part").agg(F.count("*").alias("_n")), "_n", "_base")
    return part.join(F.broadcast(base), "_part").withColumn("position", F.col("_base") + F.col("_place")).drop("_part", "_place", "_base")


#: A key of more rows than an even share of this many parts of a partition, and of this many rows at least, is hot.
HOT_PARTS, HOT_ROWS = 4, 256


def join_hot(left: DataFrame, right: DataFrame, keys: str | list[str], how: str = "inner") -> DataFrame:
    """left joined to right (one row per key) where a key may hold any share of left's rows.

    Rows of hot keys stay where they are and meet a broadcast of the hot keys' rows of right: there are at
    most HOT_PARTS keys per shuffle partition of them, whatever the tables' sizes. All other rows are shuffled."""
    keys = [keys] if isinstance(keys, str) else keys
    key = keys[-1]  # hot by the last column alone
    per_key = left.groupBy(key).agg(F.count("*").alias("_n"))
    total, most = per_key.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.max("_n"), F.lit(0))).first()
    share = max(HOT_ROWS, total // (HOT_PARTS * partitions(left.sparkSession)))
    hot = [r[0] for r in per_key.where(F.col("_n") > share).collect() if r[0] is not None] if most > share else []
    if not hot:
        return left.join(right, keys, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    return left.where(is_hot).join(F.broadcast(right.where(is_hot)), keys, how).unionByName(left.where(~is_hot).join(right.where(~is_hot), keys, how))


def part_bases(sizes: DataFrame, size: str, base: str) -> DataFrame:
    """Exclusive prefix sums over `_part`: one row per partition, summed on the driver."""
    rows, total, out = sorted(sizes.select("_part", size).collect()), 0, []
    for part, n in rows:
        out.append((part, total))
        total += n
    return sizes.sparkSession.createDataFrame(out, f"_part long, {base} long")
