"""Streaming queries and incremental rebuilds; each equals its batch twin's SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rolling as R
from ..sources import files as S
from ..sources import incremental as I
from ..streaming import jobs as J
from .base import query, seconds, table, trips
from .rolling import FUTURE_SQL

#: A last row far ahead moves the watermark past all windows, so that an append stream gives them all.
END = "2031-01-01 00:00:00"


def closed(spark, sf):
    e = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 20).alias("station"), "event_id", "user_id", (F.floor("value")).alias("v"))
    last = spark.range(1).select(F.lit(END).cast("timestamp").alias("ts"), F.lit(-1).cast("long").alias("station"), F.lit(-1).cast("long").alias("event_id"), F.lit(-1).cast("long").alias("user_id"), F.lit(0).cast("long").alias("v"))
    return e.unionByName(last)


def _counts(spark, sf, name, *args):
    out = J.finished(J.tick_counts(J.replay(spark, closed(spark, sf)), *args), name)
    return out.where("station >= 0").select("station", F.unix_timestamp("w.start").alias("start_s"), "n", "v")


@query("t01_tick_windows", "SELECT user_id % 20 AS station, epoch_us(ts) // 300000000 * 300 AS start_s, count(*)::BIGINT AS n, sum(floor(value))::BIGINT AS v FROM events GROUP BY ALL")
def t01(spark, sf):
    return _counts(spark, sf, "t01")


@query("t02_hourly_counts", "SELECT user_id % 20 AS station, epoch_us(ts) // 3600000000 * 3600 AS start_s, count(*)::BIGINT AS n, sum(floor(value))::BIGINT AS v FROM events GROUP BY ALL")
def t02(spark, sf):
    return _counts(spark, sf, "t02", "1 hour")


@query("t03_sliding_history", "SELECT user_id % 20 AS station, (epoch_us(ts) // 300000000 - k) * 300 AS start_s, count(*)::BIGINT AS n, sum(floor(value))::BIGINT AS v FROM events, (SELECT unnest(range(0, 5)) AS k) GROUP BY ALL")
def t03(spark, sf):
    return _counts(spark, sf, "t03", "25 minutes", "5 minutes")


_TREND_SQL = """
WITH e AS (SELECT user_id % 20 AS station, epoch_us(ts) // 1000000 AS s, floor(value)::BIGINT AS v FROM events),
w AS (SELECT station, (s // 300 - k) * 300 AS start_s, s, v FROM e, (SELECT unnest(range(0, 5)) AS k)),
m AS (
  SELECT station, start_s, count(*) AS n, sum(s - start_s)::DOUBLE AS sx, sum(v)::DOUBLE AS sy, sum((s - start_s) * v)::DOUBLE AS sxy, sum((s - start_s) * (s - start_s))::DOUBLE AS sxx
  FROM w GROUP BY ALL HAVING max(s) >= start_s + 1200)
SELECT station, start_s, n, CASE WHEN n * sxx <> sx * sx THEN round_even(60.0::DOUBLE * (n * sxy - sx * sy) / (n * sxx - sx * sx), 6) END AS slope FROM m"""


@query("t03b_window_trend", _TREND_SQL)
def t03b(spark, sf):
    """Slope per minute of the last 25 minutes at each 5-minute anchor; stations without a row at the anchor are left out."""
    out = J.finished(J.window_trends(J.replay(spark, closed(spark, sf))), "t03b")
    return out.where("station >= 0").select("station", "start_s", "n", F.bround("slope", 6).alias("slope"))


@query("t06_replayed_ticks", "SELECT event_id, user_id FROM events")
def t06(spark, sf):
    """Every third event comes twice; the second one is dropped within the watermark."""
    c = closed(spark, sf).where("station >= 0")
    twice = c.unionByName(c.where("event_id % 3 = 0"))
    return J.finished(J.deduplicated(J.replay(spark, twice), ["event_id"]), "t06").select("event_id", "user_id")


@query("t07_incremental_mean", "SELECT user_id % 20 AS station, sum(floor(value))::BIGINT AS total, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def t07(spark, sf):
    return J.merged_state(J.replay(spark, closed(spark, sf).where("station >= 0")), ["station"], "v", "t07")


@query("t08_newer_generation_wins", "SELECT user_id, max(event_id % 97) AS g, arg_max(event_id, (event_id % 97, event_id)) AS event_id FROM events GROUP BY ALL")
def t08(spark, sf):
    c = closed(spark, sf).where("station >= 0").withColumn("g", F.col("event_id") % 97)
    return J.newest(J.replay(spark, c), ["user_id"], "g", "t08")


#: The first run's time; rows within the embargo before a run are left to the next one.
FIRST_RUN, EMBARGO = 19730 * 86400, 2400


@query(
    "t04_late_data_replay",
    f"""WITH a AS (SELECT epoch_us(ts) // 3600000000 AS hour, epoch_us(ts) // 1000000 + CASE event_id % 50 WHEN 7 THEN 5400 WHEN 8 THEN 72000 ELSE 0 END AS arrival FROM events)
SELECT hour, count(*)::BIGINT AS n FROM a WHERE (hour <= {FIRST_RUN // 3600 - 2} AND arrival <= {FIRST_RUN}) OR (hour = {FIRST_RUN // 3600 - 1} AND arrival <= {FIRST_RUN + 3600}) OR (hour BETWEEN {FIRST_RUN // 3600} AND {FIRST_RUN // 3600 + 22} AND arrival <= {FIRST_RUN + 86400}) GROUP BY ALL""",
)
def t04(spark, sf):
    """Hourly partitions kept up by three runs: the first load, a replay of the two hours before the second run, and one
    of the 24 hours before the third. A run sees what has arrived by then, leaves the last 40 minutes to the next
    one, and overwrites only the hours of its window, so late rows enter with the replay that covers their hour."""
    path = S.work_folder(spark, "late")
    s = seconds("ts")
    late = F.when(F.col("event_id") % 50 == 7, 5400).when(F.col("event_id") % 50 == 8, 72000).otherwise(0)
    e = table(spark, sf, "events").select("event_id", F.floor(s / 3600).alias("hour"), (s + late).alias("arrival"))
    for run, back in ((FIRST_RUN, None), (FIRST_RUN + 3600, 7200), (FIRST_RUN + 86400, 86400)):
        window = e.where((F.col("arrival") <= run) & ((F.col("hour") + 1) * 3600 <= run - EMBARGO))
        if back is not None:
            window = window.where(F.col("hour") * 3600 >= run - back)
        S.write_dated(window, path, "hour", "event_id")
    return spark.read.parquet(path).groupBy(F.col("hour").cast("long").alias("hour")).agg(F.count("*").alias("n"))


#: Days of the runs after the first event's day (fixed values of this query): the first load and four later ones.
ARCHIVE_RUNS = (12, 20, 30, 45, 60)

_ARCHIVE_SQL = f"""
WITH e AS (
  SELECT event_id, epoch_us(ts) // 86400000000 AS day, epoch_us(ts) // 86400000000 + 6 + CASE event_id % 40 WHEN 7 THEN 3 WHEN 8 THEN 30 WHEN 9 THEN 44 ELSE 0 END AS known
  FROM events),
runs AS (
  SELECT day AS run, lag(day, 1, -1) OVER (ORDER BY day) AS before, row_number() OVER (ORDER BY day) AS no
  FROM (SELECT (SELECT min(day) FROM e) + unnest({list(ARCHIVE_RUNS)}) AS day)),
marked AS (SELECT DISTINCT e.day, r.run FROM e JOIN runs r ON e.known > r.before AND e.known <= r.run AND (r.no = 1 OR e.day >= r.run - {I.RECOMPUTE_REACH})),
last_run AS (SELECT day, max(run) AS run FROM marked GROUP BY ALL)
SELECT e.day, count(*)::BIGINT AS n FROM e JOIN last_run USING (day) WHERE known <= run GROUP BY ALL"""


@query("t04b_recompute_marked_days", _ARCHIVE_SQL)
def t04b(spark, sf):
    """Days of an archive that is complete after six days, with rows that come later still: each run replaces the days that
    its new rows change, 35 days back at most; what comes later than that is left out."""
    path, day = S.work_folder(spark, "archive"), F.floor(seconds("ts") / 86400)
    late = F.when(F.col("event_id") % 40 == 7, 3).when(F.col("event_id") % 40 == 8, 30).when(F.col("event_id") % 40 == 9, 44).otherwise(0)
    e = table(spark, sf, "events").select("event_id", day.alias("day"), ((day + I.ARCHIVE_DELAY + late) * 86400).alias("arrival"))
    first = e.agg(F.min("day")).first()[0]
    counted = lambda rows: rows.groupBy("day").agg(F.count("*").alias("n"))
    if first is None:
        return counted(e)
    for after in ARCHIVE_RUNS:
        I.recompute_days(spark, path, e, counted, (first + after) * 86400)
    return spark.read.parquet(path).select(F.col("day").cast("long").alias("day"), "n")


#: Seconds before the newest tick that a run looks back, and the age at which a table is due again (fixed values).
LOOKBACK, MAX_AGE = 86400, 86400


def incremental_counts(spark, sf, path):
    """Three runs over trips as they arrive (a trip is known once it has ended): a full one half way, one at the end, which
    replaces the days that late trips touch, and one an hour later, which finds the table fresh. Returns their outcomes."""
    t = trips(spark, sf).withColumn("known_s", F.coalesce("end_s", "start_s"))
    first, last = t.agg(F.min("start_s"), F.max("known_s")).first()
    if first is None:
        return []
    half = (first + last) // 2

    def build(known_by):
        def rows(since):
            seen = t.where(F.col("known_s") <= known_by)
            return R.future_counts(seen if since is None else seen.where(F.col("start_s") >= since))

        return rows

    ends = [(half, half), (last, max(last, half + MAX_AGE + 1)), (last, max(last, half + MAX_AGE + 1) + 3600)]
    return [I.run(spark, path, build(known_by), now, LOOKBACK, MAX_AGE, order=("station_id", "tick")) for known_by, now in ends]


@query("t05_incremental_equals_full", f"WITH {FUTURE_SQL} SELECT * FROM fut")
def t05(spark, sf):
    """A table kept by runs from its watermark holds what a full build over all trips holds."""
    path = S.work_folder(spark, "incremental")
    if not incremental_counts(spark, sf, path):
        return R.future_counts(trips(spark, sf))
    return spark.read.parquet(path).select("station_id", "tick", "count")


@query("t11_retry_queue", "SELECT u.user_id, d.day FROM (SELECT DISTINCT user_id FROM events) u, (SELECT DISTINCT epoch_us(ts) // 86400000000 AS day FROM events) d WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = u.user_id AND epoch_us(e.ts) // 86400000000 = d.day)")
def t11(spark, sf):
    got = table(spark, sf, "events").select("user_id", F.floor(seconds("ts") / 86400).alias("day")).distinct()
    first, last = got.agg(F.min("day"), F.max("day")).first()
    days = F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long")) if first is not None else F.array().cast("array<bigint>")
    planned = got.select("user_id").distinct().withColumn("day", F.explode(days))
    return planned.join(got, ["user_id", "day"], "left_anti")
