"""Reading and writing date-partitioned tables, CSV and JSON, and keyed table maintenance."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the cluster's shared directory, spark.checkpoint.dir."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("spark.checkpoint.dir names the folder that driver and executors share; set it")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared directory and read again: computed once, and no longer part of later plans."""
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Parts into which the rows of one key or date are dealt before they are put together.
PARTS = 64


def first_few(df: DataFrame, key: str, value: str, n: int, out: str) -> DataFrame:
    """(key, out): the n least values of each key, ascending.

    Ranked in PARTS parts of a key first, of which n rows each go on, so a key of any size meets in no task."""
    part = F.pmod(F.xxhash64(value), F.lit(PARTS))
    rank = lambda *keys: F.row_number().over(W.partitionBy(*keys).orderBy(value))
    some = df.select(key, value, part.alias("_part")).withColumn("_k", rank(key, "_part")).where(F.col("_k") <= n)
    return some.withColumn("_k", rank(key)).where(F.col("_k") <= n).groupBy(key).agg(F.array_sort(F.collect_list(value)).alias(out))


def placed(df: DataFrame, keys: list[str]) -> DataFrame:
    """df with `place`, the row's place (from 0) in the order of keys over the whole table: range partitions in the
    shared folder, and the sums of the sizes of earlier ones, one number per partition, as literals."""
    spark, path = df.sparkSession, work_folder(df.sparkSession, "order")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id()
    df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_at", at).write.parquet(path)
    part = F.shiftright("_at", 33)
    rows = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("_at", T.LongType())])).parquet(path)
    total, bases = 0, []
    for p, m in sorted((r.p, r.m) for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("m")).collect()):
        bases.append((p, total))
        total += m
    base = F.broadcast(spark.createDataFrame(bases, "_part long, _base long"))  # a row per partition
    place = F.col("_base") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn("_part", part).join(base, "_part").withColumn("place", place).drop("_part", "_base", "_at")


def write_by_date(df: DataFrame, path: str, date: str = "date", order: tuple = (), mode: str = "overwrite") -> None:
    """One file per date, sorted inside; with mode overwrite only the written dates are replaced."""
    out = df.repartition(F.col(date)).sortWithinPartitions(date, *order)
    out.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(date).parquet(path)


def write_dated(df: DataFrame, path: str, date: str, *order: str) -> None:
    """As write_by_date, but a date of any size is written by several tasks: ranges of (date, order), for tables that are read again by date."""
    out = df.repartitionByRange(date, *order).sortWithinPartitions(date, *order)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(date).parquet(path)


def read_days(spark: SparkSession, path: str, since: str, until: str, columns=None, date: str = "date") -> DataFrame:
    """Days in [since, until): the filter prunes partitions; fails only if no day is there."""
    df = spark.read.parquet(path)
    df = df.where((F.col(date) >= F.to_date(F.lit(since))) & (F.col(date) < F.to_date(F.lit(until))))
    if not df.limit(1).count():
        raise ValueError(f"no day of [{since}, {until}) in {path}")
    return df.select(date, *columns) if columns else df


def missing_days(spark: SparkSession, df: DataFrame, since: str, until: str, date: str = "date") -> DataFrame:
    days = spark.sql(f"SELECT explode(sequence(date'{since}', date_sub(date'{until}', 1))) AS {date}")
    return days.join(df.select(date).distinct(), date, "left_anti")


def require_groups(df: DataFrame, groups: list[list[str]]) -> DataFrame:
    """Fails unless each group has a column in df (alternative names of one required column)."""
    lost = [g for g in groups if not set(g) & set(df.columns)]
    if lost:
        raise ValueError(f"none of these columns is there: {lost}")
    return df


def optional(df: DataFrame, name: str, kind: str):
    return F.col(name) if name in df.columns else F.lit(None).cast(kind).alias(name)


def conform(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Exactly the schema's columns: missing ones are typed nulls, the others are cast, the rest goes."""
    return df.select(*[F.col(c).try_cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in schema.items()])


def lossy(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Rows whose value does not survive the cast to the schema and back."""
    bad = F.lit(False)
    for c, t in schema.items():
        if c in df.columns:
            kept = F.col(c).try_cast(t).cast(df.schema[c].dataType)
            bad = bad | (F.col(c).isNotNull() & ~F.coalesce(kept == F.col(c), F.lit(False)))
    return df.where(bad)


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], guard: str) -> DataFrame:
    """The new snapshot: an incoming row replaces its key's row unless its guard is older. Adds `_change`."""
    cols = [c for c in current.columns if c not in keys]
    a = current.select(*keys, F.struct(*cols).alias("_a"))
    b = incoming.select(*keys, F.struct(*cols).alias("_b"))
    both = a.join(b, keys, "full")
    take = F.col("_b").isNotNull() & (F.col("_a").isNull() | (F.col(f"_b.{guard}") >= F.col(f"_a.{guard}")))
    change = F.when(F.col("_a").isNull(), "insert").when(take, "update").when(F.col("_b").isNotNull(), "older").otherwise("keep")
    return both.select(*keys, F.when(take, F.col("_b")).otherwise(F.col("_a")).alias("_x"), change.alias("_change")).select(*keys, "_x.*", "_change")


def reconcile(current: DataFrame, incoming: DataFrame, keys: list[str], created: str, scope=None) -> DataFrame:
    """Full replacement: incoming rows stay, absent keys (within scope) go, the first creation time is kept. Adds `_change`."""
    cols = [c for c in incoming.columns if c not in [*keys, created]]
    a = current.select(*keys, F.col(created).alias("_created"), F.struct(*cols).alias("_a"), (scope if scope is not None else F.lit(True)).alias("_scope"))
    b = incoming.select(*keys, F.col(created).alias("_now"), F.struct(*cols).alias("_b"))
    change = F.when(F.col("_a").isNull(), "insert").when(F.col("_b").isNotNull(), "update").when(F.col("_scope"), "delete").otherwise("keep")
    return a.join(b, keys, "full").select(*keys, F.coalesce("_created", "_now").alias(created), F.coalesce("_b", "_a").alias("_x"), change.alias("_change")).select(*keys, created, "_x.*", "_change")


def newest_generation(df: DataFrame, target: list[str], generation: str, tie: str) -> DataFrame:
    """Per target the row of the newest generation: an older run never overwrites a newer one. Combines before the shuffle."""
    rest = F.struct(*[c for c in df.columns if c not in target])
    best = df.groupBy(*target).agg(F.max_by(rest, F.struct(generation, tie)).alias("_x"))
    return best.select(*target, "_x.*")
