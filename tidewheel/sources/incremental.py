"""Keeping stored tables up to date: a control row, runs from a watermark, change signatures, an inventory of objects.

State lives beside the table it describes, in the cluster's shared folder. Each run writes a folder `run=N` of its own and the
newest run counts, so a run that is lost half way leaves the state as it was."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = 86400


def _runs(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished runs under a folder, ascending."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(hadoop)]
    done = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(int(n[4:]) for n in names if n.startswith("run=") and fs.exists(done(f"{path}/{n}/_SUCCESS")))


def read_state(spark: SparkSession, path: str) -> DataFrame | None:
    """What the newest finished run wrote, or None before the first one."""
    runs = _runs(spark, path)
    return spark.read.parquet(f"{path}/run={runs[-1]}") if runs else None


def write_state(df: DataFrame, path: str) -> DataFrame:
    """df as the newest run's state; earlier runs stay readable until the folder is cleared."""
    spark = df.sparkSession
    at = f"{path}/run={(_runs(spark, path) or [0])[-1] + 1}"
    df.write.mode("overwrite").parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def control(spark: SparkSession, path: str) -> dict | None:
    state = read_state(spark, f"{path}-control")
    return state.first().asDict() if state is not None else None


def recompute_from(newest: int, lookback: int) -> int:
    """The midnight before the newest tick less the lookback: whole days are replaced."""
    return (newest - lookback) // DAY * DAY


def reject_flat_layout(spark: SparkSession, path: str, date: str) -> None:
    """Raises if files lie directly under a partitioned table: a reader would count their rows beside the partitions'."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    flat = [s.getPath().getName() for s in fs.listStatus(root) if s.isFile() and s.getPath().getName().endswith(".parquet")] if fs.exists(root) else []
    if flat:
        raise ValueError(f"{len(flat)} files without {date}= under {path}, such as {flat[0]}; move them or build the table anew")


def run(spark: SparkSession, path: str, build: Callable[[int | None], DataFrame], now: int, lookback: int, max_age: int, context: int = DAY, at: str = "tick", date: str = "date", order: tuple = ()) -> tuple[str, int]:
    """One run of a table that is partitioned by day: ("full" | "incremental" | "skipped" | "empty", rows written).

    build(since) gives the rows that sources from `since` on determine, all for None. Without a control row everything is
    written. A control row younger than max_age seconds ends the run. Else the days from recompute_from() on are
    built with `context` seconds of earlier source rows and replaced; earlier days stay. The control row holds the newest
    tick and the run's time, and is written last: a run that fails is repeated whole."""
    last = control(spark, path)
    if last is not None and now - last["updated_at"] <= max_age:
        return "skipped", 0
    since = None if last is None else recompute_from(last["newest"], lookback)
    if since is None:
        rows = build(None)
    else:
        reject_flat_layout(spark, path, date)
        rows = build(since - context).where(F.col(at) >= since)
    kept = write_state(rows, f"{path}-increment")  # computed once: counted, written, measured
    newest, n = kept.agg(F.max(at), F.count("*")).first()
    if not n:
        return "empty", 0
    out = kept.withColumn(date, F.floor(F.col(at) / DAY))
    parts = out.repartitionByRange(date, *(order or (at,))).sortWithinPartitions(date, *(order or (at,)))
    parts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if since is not None else "static").partitionBy(date).parquet(path)
    newest = newest if last is None else max(newest, last["newest"])
    write_state(spark.createDataFrame([(newest, now)], "newest long, updated_at long"), f"{path}-control")
    return ("full" if since is None else "incremental"), n


#: Days after which a day's archive is complete, and days before a run that late rows may still change (fixed values).
ARCHIVE_DELAY, RECOMPUTE_REACH = 6, 35


def dirty_days(rows: DataFrame, since: int, until: int, reach: int = RECOMPUTE_REACH, spill: int = 0, day: str = "day", arrival: str = "arrival") -> DataFrame:
    """Days (from epoch) that rows which arrived after `since` and up to `until` (seconds) change: day, state.

    state is `recompute` for days at most `reach` days before the run's day and `out_of_reach` for earlier ones, which are
    reported and left as they are. With `spill` a row also changes that many days after its own (windows, lags)."""
    new = rows.where((F.col(arrival) > since) & (F.col(arrival) <= until)).select(day).distinct()
    days = new.select(F.explode(F.sequence(F.col(day), F.col(day) + spill)).alias(day)).distinct()
    return days.select(day, F.when(F.col(day) >= until // DAY - reach, "recompute").otherwise("out_of_reach").alias("state"))


def recompute_days(spark: SparkSession, path: str, rows: DataFrame, build: Callable[[DataFrame], DataFrame], now: int, reach: int = RECOMPUTE_REACH, spill: int = 0, day: str = "day", arrival: str = "arrival") -> DataFrame:
    """One run of a table by day over a source whose rows carry their arrival: returns dirty_days() of the run.

    Only marked days are read (with `spill` days before them) and replaced; a control row keeps the run's time, so the next
    run starts where this one ended, and a run that fails is repeated."""
    last = control(spark, path)
    marked = write_state(dirty_days(rows, -1 if last is None else last["updated_at"], now, reach if last is not None else now // DAY, spill, day, arrival), f"{path}-marked")
    again = marked.where("state = 'recompute'").select(day)
    if again.limit(1).count():
        wanted = again.select(F.explode(F.sequence(F.col(day) - spill, F.col(day))).alias(day)).distinct() if spill else again
        seen = rows.where(F.col(arrival) <= now).join(wanted, day, "left_semi")
        built = build(seen).join(again, day, "left_semi")
        built.repartitionByRange(day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)
    write_state(spark.createDataFrame([(now,)], "updated_at long"), f"{path}-control")
    return marked


def content_signature(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys, n, signature: equal for equal multisets of rows, whatever their order.

    Sum and exclusive or of row hashes and their number: partial results merge, so a key of any size is
    summed where its rows are. Nulls count: a mask of the null columns is hashed with the row."""
    nulls = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in columns])
    h = lambda seed: F.xxhash64(F.lit(seed), nulls, *columns)
    total = F.sum(h(1).cast("decimal(20,0)"))
    parts = df.groupBy(*keys).agg(F.count("*").alias("n"), total.alias("_sum"), F.bit_xor(h(2)).alias("_xor"))
    body = F.concat_ws("|", F.col("n"), F.col("_sum").cast("string"), F.col("_xor"))
    return parts.select(*keys, "n", F.sha2(body, 256).alias("signature"))


#: Folders of a table that write_changed() keeps: keys are dealt to them by hash.
BUCKETS = 256


def write_changed(df: DataFrame, path: str, key: str, columns: list[str] | None = None) -> DataFrame:
    """Writes the buckets of keys whose content changed since the last run: key, n, state of the key (written, skipped or absent).

    Keys lie in BUCKETS folders `bucket=`, whatever their number, as a folder a key costs files and renames without end. The
    signatures of the last run are stored beside the table. Buckets in which no key changed are left as they are; in the others
    all keys of df are written anew. Keys that df no longer has are reported as absent and keep their rows and signatures.
    Keys must not be null. The table's columns must not be named `bucket`."""
    spark, columns = df.sparkSession, columns or [c for c in df.columns if c != key]
    now = content_signature(df, [key], columns)
    before = read_state(spark, f"{path}-signatures")
    if before is None:
        before = now.limit(0)
    old = before.select(key, F.col("n").alias("_n"), F.col("signature").alias("_old"))
    both = now.join(old, key, "full")
    state = F.when(F.col("signature").isNull(), "absent").when(F.col("signature").eqNullSafe(F.col("_old")), "skipped").otherwise("written")
    both = both.select(key, F.coalesce("n", "_n").alias("n"), F.coalesce("signature", "_old").alias("signature"), state.alias("state"))
    both = write_state(both, f"{path}-comparison")
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")
    changed = [r.bucket for r in both.where("state = 'written'").select(bucket.alias("bucket")).distinct().collect()]  # BUCKETS at most
    if changed:
        rows = df.withColumn("bucket", bucket).where(F.col("bucket").isin(changed))
        gone = both.where("state = 'absent'").select(key, bucket.alias("bucket")).where(F.col("bucket").isin(changed)).select(key)
        if gone.limit(1).count():
            # what is read is stored before its folders are replaced
            kept = spark.read.schema(rows.schema).parquet(path).where(F.col("bucket").isin(changed)).join(gone, key, "left_semi")
            rows = rows.unionByName(write_state(kept.select(*rows.columns), f"{path}-kept"))
        rows.repartitionByRange("bucket", key, *columns).sortWithinPartitions("bucket", key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    write_state(both.select(key, "n", "signature"), f"{path}-signatures")
    return both.select(key, "n", "state")


def merge_inventory(listing: DataFrame, path: str, key: list[str], digest: str) -> DataFrame:
    """Merges a listing of immutable objects into the stored inventory: the listing's and inventory's columns, and `state`.

    new: not in the inventory, added; same; rejected: the bytes differ, the inventory keeps what it has and the listed
    row goes to a table of rejected objects of its own; kept: only in the inventory. A key that a listing has twice with
    different digests is rejected whole. The merged inventory replaces the earlier one."""
    spark = listing.sparkSession
    cols = [c for c in listing.columns if c not in key]
    before = read_state(spark, path)
    if before is None:
        before = listing.limit(0)
    seen = listing.groupBy(*key).agg(F.min(F.struct(digest, *[c for c in cols if c != digest])).alias("_new"), (F.min(digest) != F.max(digest)).alias("_torn"))
    old = before.select(*key, F.struct(*cols).alias("_old"))
    same_key = reduce(lambda a, b: a & b, [F.col(f"_l.{k}").eqNullSafe(F.col(f"_r.{k}")) for k in key])
    both = seen.alias("_l").join(old.alias("_r"), same_key, "full")
    picked = [F.coalesce(F.col(f"_l.{k}"), F.col(f"_r.{k}")).alias(k) for k in key]
    state = (
        F.when(F.col("_new").isNull(), "kept")
        .when(F.col("_torn"), "rejected")
        .when(F.col("_old").isNull(), "new")
        .when(F.col(f"_new.{digest}") == F.col(f"_old.{digest}"), "same")
        .otherwise("rejected")
    )
    merged = write_state(both.select(*picked, "_new", "_old", state.alias("state")), f"{path}-merge")
    stays = F.col("_old").isNotNull() | (F.col("state") == "new")
    take = lambda c: F.when(F.col("_old").isNotNull(), F.col(f"_old.{c}")).otherwise(F.col(f"_new.{c}")).alias(c)
    write_state(merged.where("state = 'rejected'").select(*key, "_new.*"), f"{path}-rejected")
    write_state(merged.where(stays).select(*key, *map(take, cols)), path)
    return merged.select(*key, *map(take, cols), "state")


def retention(listing: DataFrame, inventory: DataFrame, authority: DataFrame, now: int, days: int = 30) -> DataFrame:
    """What may go of a raw store: key, verdict. Nothing is deleted here.

    listing: key, modified_s. inventory and authority: key. unknown: not in the cold inventory, to be reported, and never a
    candidate; authority: the row that readers use; recent: younger than `days`; candidate: the rest."""
    flag = lambda df, name: df.select("key", F.lit(True).alias(name)).distinct()
    both = listing.join(flag(inventory, "_cold"), "key", "left").join(flag(authority, "_used"), "key", "left")
    verdict = F.when(F.col("_cold").isNull(), "unknown").when(F.col("_used"), "authority").when(F.col("modified_s") > now - days * DAY, "recent").otherwise("candidate")
    return both.select("key", verdict.alias("verdict"))


def load_archive(rows: DataFrame, path: str, columns: list[str], valid, day: str = "file_day", at: str = "s") -> DataFrame:
    """Loads whole day files (columns, `day` they are filed under, `at` in seconds) as hourly partitions day=/hh=: a row per file with
    fetched, invalid, out_of_day, repeated, written and hours.

    valid is a condition on a row. Rows of another day than their file's go, then rows that repeat in all columns. Only
    the hours of loaded files are replaced, so a file that is loaded again gives the same table."""
    spark = rows.sparkSession
    inside = F.floor(F.col(at) / DAY) == F.col(day)
    kind = F.when(~F.coalesce(valid, F.lit(False)), "invalid").when(~inside, "out_of_day").otherwise("ok")
    marked = rows.withColumn("_kind", kind)
    hh = F.floor(F.col(at) / 3600) % 24
    kept = marked.where("_kind = 'ok'").select(*columns, F.col(day).alias("day"), hh.alias("hh")).distinct()
    kept.repartitionByRange("day", "hh", *columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "hh").parquet(path)
    n = marked.groupBy(F.col(day).alias("day")).agg(F.count("*").alias("fetched"), F.count_if(F.col("_kind") == "invalid").alias("invalid"), F.count_if(F.col("_kind") == "out_of_day").alias("out_of_day"))
    hours = spark.read.parquet(path).groupBy("day", "hh").agg(F.count("*").alias("_n")).groupBy(F.col("day").cast("long").alias("day")).agg(F.sum("_n").alias("written"), F.count("*").alias("hours"))
    out = n.join(hours, "day", "left").na.fill(0, ["written", "hours"])
    return out.select("day", "fetched", "invalid", "out_of_day", (F.col("fetched") - F.col("invalid") - F.col("out_of_day") - F.col("written")).alias("repeated"), "written", "hours")
