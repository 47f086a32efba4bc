"""Sources and sinks: tables derived from the driver's data are written, read again and maintained."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import files as S
from ..sources import incremental as I
from .base import query, seconds, table


def ev(spark, sf):
    return table(spark, sf, "events").withColumn("s", seconds("ts"))


def daily(spark, sf):
    """events by date in the shared folder; the path."""
    path = S.work_folder(spark, "archive")
    S.write_by_date(ev(spark, sf).withColumn("date", F.to_date("ts")), path, order=("event_id",))
    return path


_DAY = "SELECT event_id, ts::DATE AS date FROM events WHERE ts IS NOT NULL"


@query("s01_daily_archive_scan", f"{_DAY} AND ts::DATE >= DATE '2024-01-07' AND ts::DATE < DATE '2024-01-14'")
def s01(spark, sf):
    return S.read_days(spark, daily(spark, sf), "2024-01-07", "2024-01-14", ["event_id"]).select("event_id", "date")


@query("s01b_missing_days", "SELECT d::DATE AS date FROM (SELECT unnest(range(TIMESTAMP '2024-01-25', TIMESTAMP '2024-02-04', INTERVAL 1 DAY)) AS d) WHERE d::DATE NOT IN (SELECT ts::DATE FROM events)")
def s01b(spark, sf):
    path = daily(spark, sf)
    return S.missing_days(spark, spark.read.parquet(path), "2024-01-25", "2024-02-04")


@query("s02_alternative_groups", "SELECT event_id, user_id AS station, ts AS at FROM events")
def s02(spark, sf):
    """Two generations of files under different column names: each file's schema is held against the groups of
    alternative names before any row is read, and the name that it has is used."""
    e, path = table(spark, sf, "events"), S.work_folder(spark, "generations")
    e.where("event_id % 2 = 0").select("event_id", "user_id", "ts").write.parquet(f"{path}/g=0")
    e.where("event_id % 2 = 1").select("event_id", F.col("user_id").alias("station_id"), F.col("ts").alias("rent_dt")).write.parquet(f"{path}/g=1")
    groups = {"station": ["station_id", "user_id"], "at": ["rent_dt", "ts"]}
    parts = [S.require_groups(spark.read.parquet(f"{path}/g={k}"), list(groups.values())) for k in (0, 1)]
    named = [p.select("event_id", *[F.col(next(c for c in names if c in p.columns)).alias(to) for to, names in groups.items()]) for p in parts]
    return named[0].unionByName(named[1])


@query("s03_schema_drift_read", "SELECT event_id, user_id, CASE WHEN event_id % 2 = 1 THEN event_type END AS event_type FROM events")
def s03(spark, sf):
    """Two generations of files: the older one lacks a column and has a narrower key."""
    e, path = table(spark, sf, "events"), S.work_folder(spark, "drift")
    e.where("event_id % 2 = 0").select(F.col("event_id").cast("int"), "user_id").write.parquet(f"{path}/g=0")
    e.where("event_id % 2 = 1").select("event_id", "user_id", "event_type").write.parquet(f"{path}/g=1")
    schema = {"event_id": "bigint", "user_id": "bigint", "event_type": "string"}
    parts = [S.conform(spark.read.parquet(f"{path}/g={k}"), schema) for k in (0, 1)]
    return parts[0].unionByName(parts[1])


@query("s04_latest_snapshot", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events WHERE epoch_us(ts) // 86400000000 = (SELECT max(epoch_us(ts) // 86400000000) FROM events) GROUP BY ALL")
def s04(spark, sf):
    path = S.work_folder(spark, "snapshots")
    S.write_by_date(ev(spark, sf).withColumn("date", F.to_date("ts")), path)
    df = spark.read.parquet(path)
    last = df.agg(F.max("date")).first()[0]  # one value: it prunes the scan to one partition
    return df.where(F.col("date") == F.lit(last)).groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("s05_rename_map", "SELECT user_id AS station_id, epoch_us(ts) // 1000000 AS tick FROM events")
def s05(spark, sf):
    return ev(spark, sf).withColumnsRenamed({"user_id": "station_id", "s": "tick"}).select("station_id", "tick")


@query("s06_optional_column", "SELECT event_id, NULL::DOUBLE AS snow, value FROM events")
def s06(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", S.optional(e, "snow", "double"), S.optional(e, "value", "double"))


@query("s07_many_keys", "SELECT event_id FROM events WHERE ts::DATE IN (DATE '2024-01-08', DATE '2024-01-10')")
def s07(spark, sf):
    """Wanted keys that exist: one scan with partition filters instead of a read per key."""
    return spark.read.parquet(daily(spark, sf)).where(F.col("date").isin([F.to_date(F.lit(d)) for d in ("2024-01-08", "2024-01-10", "2024-02-11", "2031-01-01")])).select("event_id")


@query("s08_date_partition_read", f"{_DAY} AND user_id < 50 AND ts::DATE BETWEEN DATE '2024-01-10' AND DATE '2024-01-12'")
def s08(spark, sf):
    return S.read_days(spark, daily(spark, sf), "2024-01-10", "2024-01-13", ["event_id", "user_id"]).where("user_id < 50").select("event_id", "date")


def _csv(spark, sf):
    path = S.work_folder(spark, "csv")
    e = table(spark, sf, "events")
    e.select(F.col("event_id").alias("no"), F.when(F.col("event_id") % 3 == 0, r"\N").otherwise(F.col("user_id").cast("string")).alias("station"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), F.when(F.col("event_id") % 2 == 0, "*").otherwise(F.col("value").cast("string")).alias("pop")).write.option("header", True).csv(path)
    return path


@query("s09_csv_bulk_load", "SELECT event_id AS no, CASE WHEN event_id % 3 <> 0 THEN user_id END AS station, 'bulk' AS kind FROM events")
def s09(spark, sf):
    df = spark.read.option("header", True).option("nullValue", r"\N").schema("no long, station long, at string, pop string").csv(_csv(spark, sf))
    return df.select("no", "station", F.lit("bulk").alias("kind"))


@query("s10_csv_time_columns", "SELECT event_id AS no, strftime(ts, '%Y%m%d') AS ymd, hour(ts)::INTEGER AS hh, strftime(ts, '%Y%m%d%H') AS ymdh FROM events")
def s10(spark, sf):
    df = spark.read.option("header", True).schema("no long, station string, at string, pop string").csv(_csv(spark, sf))
    at = F.to_timestamp_ntz("at", F.lit("yyyy-MM-dd HH:mm:ss"))
    df = df.select("no", F.date_format(at, "yyyyMMdd").alias("ymd"), F.hour(at).alias("hh"))
    return df.withColumn("ymdh", F.concat("ymd", F.lpad(F.col("hh").cast("string"), 2, "0")))


@query("s11_masked_csv_numbers", "SELECT event_id AS no, CASE WHEN event_id % 2 = 1 THEN value END AS spop FROM events")
def s11(spark, sf):
    df = spark.read.option("header", True).option("nullValue", "*").schema("no long, station string, at string, pop string").csv(_csv(spark, sf))
    return df.select("no", F.col("pop").try_cast("double").alias("spop"))


@query("s12_split_by_business_date", "SELECT (ts - INTERVAL 5 HOUR)::DATE AS date, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def s12(spark, sf):
    path = S.work_folder(spark, "business")
    S.write_by_date(ev(spark, sf).withColumn("date", F.to_date(F.col("ts") - F.expr("interval 5 hours"))), path)
    return spark.read.parquet(path).groupBy("date").agg(F.count("*").alias("n"))


@query("s13_json_flatten", "SELECT user_id, event_id, (props->>'$.k')::BIGINT AS k FROM events")
def s13(spark, sf):
    """Payloads with a nested row list, one a user and hour: parsed by a declared schema and exploded at the path."""
    raw = table(spark, sf, "events").groupBy("user_id", F.floor(seconds("ts") / 3600).alias("part")).agg(F.to_json(F.struct(F.struct(F.collect_list(F.struct("event_id", "props")).alias("row")).alias("data"))).alias("body"))
    rows = raw.select("user_id", F.explode(F.from_json("body", "data struct<row: array<struct<event_id: bigint, props: string>>>")["data"]["row"]).alias("r"))
    return rows.select("user_id", "r.event_id", F.from_json("r.props", "k bigint")["k"].alias("k"))


@query("s14_forecast_slots", "WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE event_type = 'view') SELECT user_id, max(event_id) FILTER (WHERE k = 1) AS f1, max(event_id) FILTER (WHERE k = 2) AS f2, max(event_id) FILTER (WHERE k = 12) AS f12 FROM r GROUP BY ALL")
def s14(spark, sf):
    a = S.first_few(table(spark, sf, "events").where("event_type = 'view'"), "user_id", "event_id", 12, "a")
    return a.select("user_id", *[F.get("a", F.lit(k - 1)).alias(f"f{k}") for k in (1, 2, 12)])


@query("s15_long_to_wide", "SELECT user_id, day(ts)::INTEGER AS d, max(value) FILTER (WHERE event_type = 'click') AS click, max(value) FILTER (WHERE event_type = 'view') AS view FROM events GROUP BY ALL")
def s15(spark, sf):
    return table(spark, sf, "events").groupBy("user_id", F.dayofmonth("ts").alias("d")).pivot("event_type", ["click", "view"]).agg(F.max("value"))


@query("s16_date_partition_sink", "SELECT ts::DATE AS date, count(*)::BIGINT AS n, 1::BIGINT AS files FROM events GROUP BY ALL")
def s16(spark, sf):
    df = spark.read.parquet(daily(spark, sf))
    return df.groupBy("date").agg(F.count("*").alias("n"), F.countDistinct(F.col("_metadata.file_path")).alias("files"))


@query("s17_dynamic_overwrite", "SELECT ts::DATE AS date, CASE WHEN ts::DATE >= DATE '2024-01-20' THEN 2 ELSE 1 END AS version, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def s17(spark, sf):
    path, e = S.work_folder(spark, "mart"), ev(spark, sf).withColumn("date", F.to_date("ts"))
    S.write_by_date(e.withColumn("version", F.lit(1)), path)
    S.write_by_date(e.where("date >= date'2024-01-20'").withColumn("version", F.lit(2)), path)
    return spark.read.parquet(path).groupBy("date", "version").agg(F.count("*").alias("n"))


@query("s18_daily_compaction", "SELECT event_id, user_id, NULL::DOUBLE AS snow, hour(ts)::INTEGER AS window_hour, 'live' AS source_kind FROM events WHERE epoch_us(ts) // 86400000000 = 19730")
def s18(spark, sf):
    path = S.work_folder(spark, "windows")
    ev(spark, sf).where("floor(s / 86400) = 19730").withColumn("hh", F.hour("ts")).write.partitionBy("hh").parquet(path)
    df = spark.read.option("recursiveFileLookup", True).parquet(path).withColumn("_f", F.col("_metadata.file_path"))
    hour = F.regexp_extract("_f", r"hh=(\d+)", 1).cast("int")
    body = df.withColumns({"window_hour": hour, "source_kind": F.lit("live")})
    return S.conform(body, {"event_id": "bigint", "user_id": "bigint", "snow": "double", "window_hour": "int", "source_kind": "string"})


_OBJ = "obj AS (SELECT event_id AS key, user_id AS win, event_id % 4 AS revision, event_type = 'purchase' AS published, event_type = 'view' AND event_id % 4 = 0 AS legacy FROM events)"


def objects(spark, sf):
    return table(spark, sf, "events").select(F.col("event_id").alias("key"), F.col("user_id").alias("win"), (F.col("event_id") % 4).alias("revision"), (F.col("event_type") == "purchase").alias("published"), ((F.col("event_type") == "view") & (F.col("event_id") % 4 == 0)).alias("legacy"))


@query("s19_compaction_authority", f"WITH {_OBJ}, p AS (SELECT win, arg_max(key, (revision, key)) AS key FROM obj WHERE published GROUP BY ALL), l AS (SELECT win, min(key) AS key, count(*) AS n FROM obj WHERE legacy GROUP BY ALL) SELECT w.win, coalesce(p.key, CASE WHEN l.n = 1 THEN l.key END) AS key, CASE WHEN p.key IS NOT NULL THEN 'published' WHEN l.n = 1 THEN 'legacy' ELSE 'none' END AS class FROM (SELECT DISTINCT win FROM obj) w LEFT JOIN p USING (win) LEFT JOIN l USING (win)")
def s19(spark, sf):
    o = objects(spark, sf).groupBy("win").agg(F.max(F.when(F.col("published"), F.struct("revision", "key"))).alias("p"), F.min(F.when(F.col("legacy"), F.col("key"))).alias("l"), F.count_if("legacy").alias("n"))
    return o.select("win", F.coalesce("p.key", F.when(F.col("n") == 1, F.col("l"))).alias("key"), F.when(F.col("p").isNotNull(), "published").when(F.col("n") == 1, "legacy").otherwise("none").alias("class"))


_CHANGED_SQL = """
WITH first AS (SELECT user_id, event_id, event_type, 0 AS version FROM events WHERE user_id % 11 <> 3),
second AS (
  SELECT user_id, event_id, event_type, CASE WHEN user_id % 7 = 2 AND event_id % 3 = 0 THEN 1 ELSE 0 END AS version FROM events WHERE user_id % 11 <> 4
  UNION ALL SELECT user_id, event_id, event_type, 0 FROM events WHERE user_id % 13 = 5 AND event_id % 2 = 0 AND user_id % 11 <> 4),
a AS (SELECT user_id, list_sort(list((event_id, event_type, version))) AS body FROM first GROUP BY ALL),
b AS (SELECT user_id, list_sort(list((event_id, event_type, version))) AS body FROM second GROUP BY ALL)
SELECT user_id, len(coalesce(b.body, a.body)) AS n, CASE WHEN b.body IS NULL THEN 'absent' WHEN a.body = b.body THEN 'skipped' ELSE 'written' END AS state
FROM a FULL JOIN b USING (user_id)"""


@query("s20_change_signature", _CHANGED_SQL)
def s20(spark, sf):
    """Two runs of a table by user: the second one has users without a change, with changed or repeated rows, new and
    absent ones, and writes only what changed."""
    path, e = S.work_folder(spark, "signed"), table(spark, sf, "events").select("user_id", "event_id", "event_type")
    same = F.lit(0).alias("version")
    first = e.where("user_id % 11 <> 3").select("*", same)
    changed = F.when((F.col("user_id") % 7 == 2) & (F.col("event_id") % 3 == 0), 1).otherwise(0).alias("version")
    second = e.where("user_id % 11 <> 4")
    again = second.where("user_id % 13 = 5 and event_id % 2 = 0").select("*", same)
    I.write_changed(first, path, "user_id")
    return I.write_changed(second.select("*", changed).unionByName(again), path, "user_id")


_INVENTORY_SQL = """
WITH d AS (SELECT ts::DATE AS day, event_id, user_id FROM events),
span AS (SELECT min(day) AS lo, max(day) AS hi FROM d),
body AS (
  SELECT strftime(day, '%Y-%m-%d') AS dt, day, string_agg('{"event_id":' || event_id || ',"user_id":' || user_id || '}' || chr(10), '' ORDER BY event_id) AS one,
    string_agg('{"event_id":' || event_id || ',"user_id":' || -user_id || '}' || chr(10), '' ORDER BY event_id) AS two
  FROM d GROUP BY ALL)
SELECT dt, strlen(one)::INTEGER AS bytes, sha256(one) AS sha256,
  CASE WHEN day - lo > (hi - lo) // 2 THEN 'new' WHEN day = lo THEN 'kept' WHEN one <> two AND (day - lo) % 3 = 1 THEN 'rejected' ELSE 'same' END AS state
FROM body, span"""


def raw_objects(spark, path):
    """One row per raw object under a folder: key part, bytes and hash of its content."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(path)
    return raw.select(F.regexp_extract("path", r"dt=([0-9-]+)", 1).alias("dt"), F.length("content").alias("bytes"), F.sha2("content", 256).alias("sha256"))


@query("s21_cold_bundle", _INVENTORY_SQL)
def s21(spark, sf):
    """Objects of a day each, listed twice. The first listing has the earlier half of the days; the second one has all
    but the first day, and every third earlier day with other bytes. The inventory takes new days and refuses changed ones."""
    e = ev(spark, sf).withColumn("dt", F.to_date("ts"))
    lo, hi = e.agg(F.min("dt"), F.max("dt")).first()
    inventory = S.work_folder(spark, "inventory")

    def listed(rows):
        path = S.work_folder(spark, "raw")
        lines = rows.repartition("dt").sortWithinPartitions("dt", "event_id").select(F.to_json(F.struct("event_id", "user_id")).alias("value"), "dt")
        lines.write.partitionBy("dt").text(path)
        return raw_objects(spark, path)

    age, half = F.date_diff("dt", F.lit(lo)), (hi - lo).days // 2
    other = F.when((age % 3 == 1) & (age <= half), -F.col("user_id")).otherwise(F.col("user_id"))
    I.merge_inventory(listed(e.where(age <= half)), inventory, ["dt"], "sha256")
    return I.merge_inventory(listed(e.where(age > 0).withColumn("user_id", other)), inventory, ["dt"], "sha256")


_RETENTION_SQL = """
WITH o AS (SELECT o_orderkey AS key, o_custkey AS win, epoch_us(o_orderdate) // 1000000 AS modified_s FROM orders),
used AS (SELECT arg_max(key, (modified_s, key)) AS key FROM o GROUP BY win),
cold AS (SELECT DISTINCT l_orderkey AS key FROM lineitem WHERE l_linenumber = 1)
SELECT key, CASE WHEN key NOT IN (SELECT key FROM cold) THEN 'unknown' WHEN key IN (SELECT key FROM used) THEN 'authority'
  WHEN modified_s > 946684800 - 30 * 86400 THEN 'recent' ELSE 'candidate' END AS verdict FROM o"""


@query("s22_retention_candidates", _RETENTION_SQL)
def s22(spark, sf):
    """Orders as raw objects: a customer's newest one is in use, those whose first line is there are in the inventory."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("win"), seconds("o_orderdate").alias("modified_s"))
    used = o.groupBy("win").agg(F.max_by("key", F.struct("modified_s", "key")).alias("key")).select("key")
    cold = table(spark, sf, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("key"))
    return I.retention(o, cold, used, 946684800)


_SIDES = "cur AS (SELECT user_id, max(epoch_us(ts) // 1000000) AS s, max(event_id) AS v FROM events WHERE event_id % 2 = 0 AND user_id % 7 <> 0 GROUP BY ALL), inc AS (SELECT user_id, max(epoch_us(ts) // 1000000) AS s, max(event_id) AS v FROM events WHERE event_id % 2 = 1 AND user_id % 5 <> 0 GROUP BY ALL)"


def sides(spark, sf):
    e = ev(spark, sf)
    agg = lambda df: df.groupBy("user_id").agg(F.max("s").alias("s"), F.max("event_id").alias("v"))
    return agg(e.where("event_id % 2 = 0 and user_id % 7 <> 0")), agg(e.where("event_id % 2 = 1 and user_id % 5 <> 0"))


@query("s23_guarded_upsert", f"WITH {_SIDES} SELECT user_id, CASE WHEN c.s IS NULL OR i.s >= c.s THEN i.s ELSE c.s END AS s, CASE WHEN c.s IS NULL OR i.s >= c.s THEN i.v ELSE c.v END AS v, CASE WHEN c.s IS NULL THEN 'insert' WHEN i.s >= c.s THEN 'update' WHEN i.s IS NOT NULL THEN 'older' ELSE 'keep' END AS _change FROM cur c FULL JOIN inc i USING (user_id)")
def s23(spark, sf):
    return S.upsert(*sides(spark, sf), ["user_id"], "s")


@query("s24_full_reconcile", f"WITH {_SIDES} SELECT user_id, coalesce(c.s, i.s) AS s, coalesce(i.v, c.v) AS v, CASE WHEN c.s IS NULL THEN 'insert' WHEN i.s IS NOT NULL THEN 'update' ELSE 'delete' END AS _change FROM cur c FULL JOIN inc i USING (user_id)")
def s24(spark, sf):
    return S.reconcile(*sides(spark, sf), ["user_id"], "s")


@query("s25_scoped_reconcile", f"WITH {_SIDES} SELECT user_id, coalesce(c.s, i.s) AS s, coalesce(i.v, c.v) AS v, CASE WHEN c.s IS NULL THEN 'insert' WHEN i.s IS NOT NULL THEN 'update' WHEN user_id % 2 = 0 THEN 'delete' ELSE 'keep' END AS _change FROM cur c FULL JOIN inc i USING (user_id)")
def s25(spark, sf):
    return S.reconcile(*sides(spark, sf), ["user_id"], "s", F.col("user_id") % 2 == 0)


@query("s26_generation_guard", "SELECT user_id, arg_max(event_id, (event_id % 97, event_id)) AS event_id FROM events GROUP BY ALL")
def s26(spark, sf):
    return S.newest_generation(table(spark, sf, "events").withColumn("g", F.col("event_id") % 97), ["user_id"], "g", "event_id").select("user_id", "event_id")


@query("s27_layout_guard", "SELECT count(DISTINCT ts::DATE)::BIGINT AS partitioned, 1::BIGINT AS flat FROM events")
def s27(spark, sf):
    """Files directly under a partitioned root are the old layout; here one is put there to be found."""
    path = daily(spark, sf)
    spark.range(1).coalesce(1).write.mode("append").parquet(f"{path}/legacy.parquet")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path).select("path")
    day = F.regexp_extract("path", r"/date=([0-9-]+)/", 1)
    return files.agg(F.countDistinct(F.when(day != "", day)).alias("partitioned"), F.count_if(day == "").alias("flat"))
