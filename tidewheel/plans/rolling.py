"""Queries over trips: moving counts, as-of look-ups, lags and the feature tables built from them."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import rolling as R
from ..sources.files import stored
from .base import forecast, population, query, seconds, stations, stock, table, trips, weather

_SPANS = """c AS (SELECT station_id, greatest(((start_s + 2400) // 1200) * 1200 + 1200, ((end_s + 1199) // 1200) * 1200) AS a, ((start_s + 6000) // 1200) * 1200 AS z FROM trips WHERE end_s IS NOT NULL),
d AS (SELECT station_id, a AS tick FROM c WHERE a <= z UNION SELECT station_id, z + 1200 FROM c WHERE a <= z)"""
CENSORED_SQL = f"""{_SPANS},
cens AS (SELECT d.station_id, d.tick, count(t.event_id)::BIGINT AS count FROM d LEFT JOIN trips t ON t.station_id = d.station_id
  AND t.start_s >= d.tick - 6000 AND t.start_s < d.tick - 2400 AND t.end_s <= d.tick GROUP BY ALL)"""


@query("w01_censored_rolling_counts", f"WITH {CENSORED_SQL} SELECT * FROM cens")
def w01(spark, sf):
    return R.censored_counts(trips(spark, sf))


FUTURE_SQL = """f AS (SELECT station_id, ((start_s - 3600) // 1200) * 1200 + 1200 AS a, (start_s // 1200) * 1200 AS z FROM trips),
g AS (SELECT station_id, a AS tick FROM f UNION SELECT station_id, z + 1200 FROM f),
fut AS (SELECT g.station_id, g.tick, count(t.event_id)::BIGINT AS count FROM g LEFT JOIN trips t ON t.station_id = g.station_id AND t.start_s >= g.tick AND t.start_s < g.tick + 3600 GROUP BY ALL)"""


@query("w02_future_rolling_counts", f"WITH {FUTURE_SQL} SELECT * FROM fut")
def w02(spark, sf):
    return R.future_counts(trips(spark, sf))


@query("w03_bucket_visibility", "SELECT event_id, coalesce(end_s IS NOT NULL AND end_s <= 1705276800 AND (start_s // 300) * 300 + 300 <= 1705276800, false) AS visible FROM trips")
def w03(spark, sf):
    return trips(spark, sf).select("event_id", F.coalesce(R.visible(F.col("start_s"), F.col("end_s"), F.lit(1705276800), 300), F.lit(False)).alias("visible"))


@query("a01_delta_aggregation", f"WITH {_SPANS.split('d AS')[0].rstrip().rstrip(',')} SELECT station_id, tick, sum(delta)::BIGINT AS delta FROM (SELECT station_id, a AS tick, 1 AS delta FROM c WHERE a <= z UNION ALL SELECT station_id, z + 1200, -1 FROM c WHERE a <= z) GROUP BY ALL")
def a01(spark, sf):
    t = trips(spark, sf).where("end_s is not null")
    out = F.col("start_s") + 2400
    spans = t.select("station_id", F.greatest(R.tick_floor(out, 1200) + 1200, R.tick_ceil(F.col("end_s"), 1200)).alias("a"), R.tick_floor(out + 3600, 1200).alias("z")).where("a <= z")
    return spans.select("station_id", F.col("a").alias("tick"), F.lit(1).alias("delta")).unionByName(spans.select("station_id", (F.col("z") + 1200).alias("tick"), F.lit(-1).alias("delta"))).groupBy("station_id", "tick").agg(F.sum("delta").alias("delta"))


def grid(spark, sf, tick=1200):
    """Stations 0..24 (20 on are unknown) x ticks of the trips' days, built from the trips' first and last time."""
    ends = trips(spark, sf).agg(R.tick_floor(F.min("start_s"), 86400).alias("a"), R.tick_floor(F.max("start_s"), tick).alias("z"))
    return ends.select(F.explode(F.sequence("a", "z", F.lit(tick).cast("long"))).alias("tick")).withColumn("station_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(24).cast("long"))))


GRID_SQL = "grid AS (SELECT unnest(range(a, z + 1, 1200)) AS tick, s AS station_id FROM (SELECT (min(start_s) // 86400) * 86400 AS a, (max(start_s) // 1200) * 1200 AS z FROM trips), (SELECT unnest(range(0, 25)) AS s))"


@query("j04_hours_to_ticks", f"WITH {GRID_SQL} SELECT * FROM grid")
def j04(spark, sf):
    return grid(spark, sf)


ASOF_SQL = f"""{CENSORED_SQL}, {GRID_SQL}, seen AS (SELECT g.station_id, g.tick, coalesce(c.count, 0)::BIGINT AS count FROM grid g ASOF LEFT JOIN cens c ON g.station_id = c.station_id AND g.tick >= c.tick)"""


@query("j05_as_of_lookup", f"WITH {ASOF_SQL} SELECT * FROM seen")
def j05(spark, sf):
    return R.as_of(R.censored_counts(trips(spark, sf)), grid(spark, sf))


@query("j06_bounded_forward_fill", """WITH o AS (SELECT grid, obs_s, max(temp) AS temp FROM weather WHERE temp IS NOT NULL GROUP BY ALL), n AS (SELECT *, lead(obs_s) OVER (PARTITION BY grid ORDER BY obs_s) AS nx FROM o),
r AS (SELECT grid, temp, ((obs_s + 1199) // 1200) * 1200 AS a, least(((obs_s + 10800) // 1200) * 1200, coalesce(((nx + 1199) // 1200) * 1200 - 1200, 1152921504606846976)) AS z FROM n)
SELECT grid, unnest(range(a, z + 1, 1200)) AS tick, temp FROM r WHERE a <= z""")
def j06(spark, sf):
    w = weather(spark, sf).where("temp is not null").groupBy("grid", "obs_s").agg(F.max("temp").alias("temp"))
    return R.forward_fill(w, 1200, 10800, "grid", "obs_s", ["temp"])


@query("j08_exact_offset_lag", f"""WITH {FUTURE_SQL} SELECT x.station_id, x.tick, x.count, y.count AS lag_1h FROM fut x LEFT JOIN fut y ON y.station_id = x.station_id AND y.tick = x.tick - 3600""")
def j08(spark, sf):
    return R.exact_lag(R.future_counts(trips(spark, sf)), "count", 3600, "lag_1h")


@query("j09_horizon_shift", f"""WITH {FUTURE_SQL} SELECT x.station_id, x.tick, x.count, h.h AS horizon, y.count AS target_count FROM fut x, (SELECT unnest(range(1, 13))::INTEGER AS h) h JOIN fut y ON y.station_id = x.station_id AND y.tick = x.tick + (h.h - 1) * 3600 WHERE x.tick % 3600 = 0""")
def j09(spark, sf):
    f = R.future_counts(trips(spark, sf))
    return R.horizons(f.where("tick % 3600 = 0"), f)


@query("j23_interval_overlap_count", """WITH a AS (SELECT DISTINCT station_id, (start_s // 3600) * 3600 + 3600 AS anchor FROM trips) SELECT a.station_id, a.anchor, count(t.event_id)::BIGINT AS n FROM a LEFT JOIN trips t
  ON t.station_id = a.station_id AND t.start_s >= a.anchor - 6000 AND t.start_s < a.anchor - 2400 AND t.end_s <= a.anchor GROUP BY ALL""")
def j23(spark, sf):
    t = trips(spark, sf)
    anchors = t.select("station_id", (R.tick_floor(F.col("start_s"), 3600) + 3600).alias("tick")).distinct()
    return R.as_of(R.censored_counts(t, tick=600), anchors).select("station_id", F.col("tick").alias("anchor"), F.col("count").alias("n"))


@query("v23_anchor_thinning", f"WITH {FUTURE_SQL} SELECT * FROM fut WHERE (tick // 60) % 60 = 0")
def v23(spark, sf):
    return R.future_counts(trips(spark, sf)).where("pmod(floor(tick / 60), 60) = 0")


@query("v24_adaptive_anchors", f"""WITH {FUTURE_SQL}, m AS (SELECT *, (tick // 3600) % 24 AS h, (tick // 60) % 60 AS mi, tick // 86400 AS d FROM fut)
SELECT station_id, tick, count FROM m WHERE CASE WHEN h IN (7, 8, 17, 18, 19) THEN mi % 20 = 0 WHEN h < 5 THEN d % 3 = 0 AND mi = 0 ELSE mi = 0 END""")
def v24(spark, sf):
    h, mi, d = F.floor(F.col("tick") / 3600) % 24, F.floor(F.col("tick") / 60) % 60, F.floor(F.col("tick") / 86400)
    keep = F.when(h.isin(7, 8, 17, 18, 19), mi % 20 == 0).when(h < 5, (d % 3 == 0) & (mi == 0)).otherwise(mi == 0)
    return R.future_counts(trips(spark, sf)).where(keep)


def clean_trips(spark, sf):
    """C01: one trip per bike and start, known start stations only, unknown return stations null."""
    t = trips(spark, sf)
    known = t.select("station_id").distinct()
    once = t.groupBy("bike_id", "start_s").agg(F.min(F.struct("event_id", "station_id", "end_station_id", "end_s")).alias("t")).select("bike_id", "start_s", "t.*")
    ret = known.select(F.col("station_id").alias("end_station_id"), F.lit(True).alias("_k"))
    return once.join(known, "station_id").join(ret, "end_station_id", "left").select("event_id", "bike_id", "station_id", "start_s", "end_s", F.when(F.col("_k"), F.col("end_station_id")).alias("end_station_id"))


CLEAN_SQL = "clean AS (SELECT event_id, bike_id, station_id, start_s, end_s, CASE WHEN end_station_id < 20 THEN end_station_id END AS end_station_id FROM (SELECT *, row_number() OVER (PARTITION BY bike_id, start_s ORDER BY event_id) AS rn FROM trips) WHERE rn = 1)"


@query("c01_trip_table", f"WITH {CLEAN_SQL} SELECT * FROM clean")
def c01(spark, sf):
    return clean_trips(spark, sf)


@query("j01_known_station_join", "SELECT t.event_id, t.station_id FROM trips t JOIN (SELECT s_suppkey FROM supplier) ON s_suppkey = t.end_station_id * 10")
def j01(spark, sf):
    master = table(spark, sf, "supplier").select((F.col("s_suppkey")).alias("k"))
    return trips(spark, sf).withColumn("k", F.col("end_station_id") * 10).join(master, "k").select("event_id", "station_id")


@query("j02_left_join_mask", "SELECT event_id, CASE WHEN end_station_id < 20 THEN end_station_id END AS end_station_id FROM trips")
def j02(spark, sf):
    t = trips(spark, sf)
    known = t.select(F.col("station_id").alias("end_station_id"), F.lit(True).alias("_k")).distinct()
    return t.join(known, "end_station_id", "left").select("event_id", F.when(F.col("_k"), F.col("end_station_id")).alias("end_station_id"))


#: Days [first, last) for which targets are built.
TARGET_DAYS = (19730, 19740)


@query("c05_targets", f"""WITH {CLEAN_SQL}, o AS (SELECT station_id, start_s // 3600 * 3600 AS tick, count(*)::BIGINT AS rentals FROM clean GROUP BY ALL),
i AS (SELECT end_station_id AS station_id, end_s // 3600 * 3600 AS tick, count(*)::BIGINT AS returns FROM clean WHERE end_station_id IS NOT NULL AND end_s IS NOT NULL GROUP BY ALL)
SELECT station_id, tick, coalesce(rentals, 0)::BIGINT AS rentals, coalesce(returns, 0)::BIGINT AS returns FROM o FULL JOIN i USING (station_id, tick) WHERE tick >= {TARGET_DAYS[0]} * 86400 AND tick < {TARGET_DAYS[1]} * 86400""")
def c05(spark, sf):
    """Trips lie in partitions of the day they arrived on, up to a day from their start or end: the days before and
    after the range are read too, and the events' own times decide."""
    from ..sources import files as S

    path, (first, last) = S.work_folder(spark, "trips-by-arrival"), TARGET_DAYS
    arrived = F.floor(F.coalesce("end_s", "start_s") / 86400).cast("long")
    S.write_dated(clean_trips(spark, sf).withColumn("arrival_day", arrived), path, "arrival_day", "station_id", "start_s")
    c = spark.read.parquet(path).where(f"arrival_day >= {first - 1} and arrival_day < {last + 1}")
    both = c.select("station_id", "start_s", F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(c.where("end_station_id is not null and end_s is not null").select(F.col("end_station_id").alias("station_id"), F.col("end_s").alias("start_s"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    both = both.where(f"start_s >= {first * 86400} and start_s < {last * 86400}")
    return both.groupBy("station_id", R.tick_floor(F.col("start_s"), 3600).alias("tick")).agg(F.sum("o").alias("rentals"), F.sum("i").alias("returns"))


#: Days since 1970 that are holidays: 2024-01-01 and 2024-01-15 (fixed values).
HOLIDAYS = (19723, 19737)
RETURN_SQL = """rt AS (SELECT end_station_id AS station_id, end_s AS start_s FROM trips WHERE end_s IS NOT NULL), rf AS (SELECT station_id, ((start_s - 3600) // 1200) * 1200 + 1200 AS a, (start_s // 1200) * 1200 AS z FROM rt),
rg AS (SELECT station_id, a AS tick FROM rf UNION SELECT station_id, z + 1200 FROM rf),
ret AS (SELECT rg.station_id, rg.tick, count(t.start_s)::BIGINT AS count FROM rg LEFT JOIN rt t ON t.station_id = rg.station_id AND t.start_s >= rg.tick AND t.start_s < rg.tick + 3600 GROUP BY ALL)"""
_CAL = "(({t} // 60) % 1440)::SMALLINT AS minute, (({t} // 86400 + 3) % 7)::SMALLINT AS dow, (CASE WHEN ({t} // 86400 + 3) % 7 >= 5 OR {t} // 86400 IN (19723, 19737) THEN 1 ELSE 0 END)::SMALLINT AS is_holiday, ({t} // 86400 - 10957)::SMALLINT AS day"
FEATURE_SQL = f"""{FUTURE_SQL}, {CENSORED_SQL}, {RETURN_SQL}, st AS (SELECT user_id % 20 AS station_id, epoch_us(ts) // 3600000000 * 3600 AS tick, arg_min(floor(value)::BIGINT % 40, (epoch_us(ts), event_id)) AS bikes FROM events GROUP BY ALL),
we AS (SELECT grid, obs_s // 3600 * 3600 AS at, max(temp) AS temp, max(precip) AS precip FROM weather WHERE temp IS NOT NULL GROUP BY ALL),
pp AS (SELECT cell, day, hour, max(spop) AS pop FROM population GROUP BY ALL),
h AS (SELECT * FROM fut WHERE tick % 3600 = 0),
h1 AS (SELECT h.*, c.count AS recent FROM h ASOF LEFT JOIN cens c ON c.station_id = h.station_id AND h.tick >= c.tick),
h2 AS (SELECT h1.*, r.count AS returns FROM h1 ASOF LEFT JOIN ret r ON r.station_id = h1.station_id AND h1.tick >= r.tick),
h3 AS (SELECT h2.*, h2.tick - 3600 AS lag_tick FROM h2),
h4 AS (SELECT h3.*, r.count AS return_lag FROM h3 ASOF LEFT JOIN ret r ON r.station_id = h3.station_id AND h3.lag_tick >= r.tick),
h5 AS (SELECT h4.*, h4.station_id % 34 AS grid FROM h4),
h6 AS (SELECT h5.*, CASE WHEN h5.tick - w.at <= 10800 THEN w.temp END AS temp, CASE WHEN h5.tick - w.at <= 10800 THEN w.precip END AS precip FROM h5 ASOF LEFT JOIN we w ON w.grid = h5.grid AND h5.tick >= w.at),
feat AS (SELECT h.station_id, h.tick, s.capacity, s.lat, s.lon, h.temp, h.precip, pp.pop AS pop_total, {_CAL.format(t="h.tick")},
  h.count AS rental_count, coalesce(h.returns, 0)::BIGINT AS return_count, coalesce(h.recent, 0)::INTEGER AS rental_lag_1h, coalesce(h.return_lag, 0)::INTEGER AS return_lag_1h, b.count AS lag_24h, CASE WHEN st.bikes <= 0 THEN 0.05 ELSE 1.0 END::DOUBLE AS exposure
  FROM h6 h LEFT JOIN fut b ON b.station_id = h.station_id AND b.tick = h.tick - 86400 LEFT JOIN st ON st.station_id = h.station_id AND st.tick = h.tick LEFT JOIN stations s ON s.station_id = h.station_id
  LEFT JOIN pp ON pp.cell = h.station_id % 25 AND pp.day = h.tick // 86400 AND pp.hour = (h.tick // 3600) % 24)"""


def hourly_stock(spark, sf):
    """C02: the first stock row of each station and hour."""
    s = table(spark, sf, "events").select((F.col("user_id") % 20).alias("station_id"), R.tick_floor(seconds("ts"), 3600).alias("tick"), F.col("ts"), "event_id", (F.floor("value") % 40).alias("bikes"))
    return s.groupBy("station_id", "tick").agg(F.min_by("bikes", F.struct("ts", "event_id")).alias("bikes"))


def calendar(t):
    """minute of the day, dow (Monday 0), is_holiday and day (since 2000-01-01) of epoch seconds, as small integers."""
    day, dow = F.floor(t / 86400), (F.floor(t / 86400) + 3) % 7
    off = F.when((dow >= 5) | day.isin(*HOLIDAYS), 1).otherwise(0)
    return [c.cast("smallint").alias(n) for n, c in (("minute", F.floor(t / 60) % 1440), ("dow", dow), ("is_holiday", off), ("day", day - 10957))]


def hourly_weather(spark, sf):
    """Weather on the hour grid: an observation holds for three hours at most."""
    w = weather(spark, sf).where("temp is not null").groupBy("grid", R.tick_floor(F.col("obs_s"), 3600).alias("at")).agg(F.max("temp").alias("temp"), F.max("precip").alias("precip"))
    return R.forward_fill(w, 3600, 10800, "grid", "at", ["temp", "precip"])


def features(spark, sf):
    """The feature table: station constants, weather, population, calendar, both targets, point-in-time lags, exposure.

    All counts come from one pass over the trips. Their step functions, moved to the tick at which they are asked for (an
    hour and a day later for lags), and the stock meet in one row per station and tick; one window gives what held
    at each tick."""
    steps = R.count_steps(trips(spark, sf))
    #: column -> (step function, seconds by which it is moved)
    asked = {"rental_count": ("rental", 0), "lag_24h": ("rental", 86400), "returned": ("returned", 0), "returned_before": ("returned", 3600), "recent": ("recent", 0)}
    none = F.lit(None).cast("long")
    moved = [F.when(F.col("fn") == fn, F.struct((F.col("tick") + by).alias("tick"), *[(F.col("count") if c == name else none).alias(c) for c in asked])) for name, (fn, by) in asked.items()]
    rows = steps.select("station_id", F.inline(F.array_compact(F.array(*moved)))).unionByName(hourly_stock(spark, sf), allowMissingColumns=True)
    per = rows.groupBy("station_id", "tick").agg(*[F.max(c).alias(c) for c in (*asked, "bikes")])
    w = W.partitionBy("station_id").orderBy("tick").rowsBetween(W.unboundedPreceding, 0)
    held = {c: F.coalesce(F.last(c, ignorenulls=True).over(w), F.lit(0).cast("long")) for c in ("returned", "returned_before", "recent")}
    out = per.withColumns(held).where("rental_count is not null and tick % 3600 = 0")
    pop = population(spark, sf).groupBy("cell", (F.col("day") * 86400 + F.col("hour") * 3600).alias("tick")).agg(F.max("spop").alias("pop_total"))
    out = out.withColumns({"grid": F.col("station_id") % 34, "cell": F.col("station_id") % 25}).join(hourly_weather(spark, sf), ["grid", "tick"], "left").join(pop, ["cell", "tick"], "left")
    out = out.join(stations(spark, sf).select("station_id", "capacity", "lat", "lon"), "station_id", "left")
    lags = [F.col("recent").cast("int").alias("rental_lag_1h"), F.col("returned_before").cast("int").alias("return_lag_1h"), F.col("lag_24h")]
    exposure = F.when(F.col("bikes") <= 0, 0.05).otherwise(1.0).alias("exposure")
    fixed = ("station_id", "tick", "capacity", "lat", "lon", "temp", "precip", "pop_total")
    return out.select(*fixed, *calendar(F.col("tick")), "rental_count", F.col("returned").alias("return_count"), *lags, exposure)


@query("c06_feature_table", f"WITH {FEATURE_SQL} SELECT * FROM feat")
def c06(spark, sf):
    return features(spark, sf)


_AT_TARGET = ("temp", "precip", "pop_total", "minute", "dow", "is_holiday", "day", "exposure", "rental_count", "return_count")


@query("c07_multi_horizon_table", f"WITH {FEATURE_SQL}, hh AS (SELECT unnest(range(1, 13))::INTEGER AS horizon) SELECT x.station_id, x.tick, x.capacity, x.lat, x.lon, x.rental_lag_1h, x.return_lag_1h, hh.horizon, {', '.join(f'y.{c} AS target_{c}' for c in _AT_TARGET)} FROM feat x, hh JOIN feat y ON y.station_id = x.station_id AND y.tick = x.tick + (hh.horizon - 1) * 3600")
def c07(spark, sf):
    f = stored(features(spark, sf), "features")  # both sides of the join read the same table
    anchors = f.select("station_id", "tick", "capacity", "lat", "lon", "rental_lag_1h", "return_lag_1h")
    return R.horizons(anchors, f, values=_AT_TARGET)


#: The inference anchor (2024-01-20 00:00).
ANCHOR = 1705708800


def _c20_sql():
    from .dispatch import FC_SQL

    return f"""WITH {CENSORED_SQL}, {FUTURE_SQL}, {FC_SQL}, l AS (SELECT station_id, arg_max(bikes, (tick, event_id)) AS bikes FROM stock WHERE tick <= {ANCHOR} GROUP BY ALL),
seen AS (SELECT grid, arg_max(temp, (obs_s, event_id)) AS temp FROM weather WHERE temp IS NOT NULL AND obs_s <= {ANCHOR} GROUP BY ALL),
live AS (SELECT cell, day, hour, max(spop) AS pop FROM population WHERE estimated GROUP BY ALL), prof AS (SELECT cell, hour, max(spop) AS pop FROM population WHERE day < {ANCHOR // 86400} GROUP BY ALL),
lg AS (SELECT station_id, arg_max(count, tick) AS n FROM cens WHERE tick <= {ANCHOR} GROUP BY ALL), lp AS (SELECT station_id, (tick // 3600) % 24 AS hour, max(count) AS n FROM fut WHERE tick % 3600 = 0 AND tick < {ANCHOR} GROUP BY ALL),
x AS (SELECT station_id, horizon, {ANCHOR} + horizon * 3600 AS t FROM forecast)
SELECT x.station_id, x.horizon, {_CAL.format(t="x.t")}, round_even(coalesce(p.temp, seen.temp), 6) AS temp, CASE WHEN p.temp IS NOT NULL THEN 'forecast' WHEN seen.temp IS NOT NULL THEN 'observed' ELSE 'missing' END AS temp_from,
  coalesce(live.pop, prof.pop) AS pop_total, CASE WHEN live.pop IS NOT NULL THEN 'live' WHEN prof.pop IS NOT NULL THEN 'profile' ELSE 'missing' END AS pop_from, coalesce(lg.n, lp.n, 0)::BIGINT AS rental_lag_1h, lg.n IS NULL AS lag_fallback, CASE WHEN l.bikes <= 0 THEN 0.05 ELSE 1.0 END::DOUBLE AS exposure
FROM x LEFT JOIN l USING (station_id) LEFT JOIN pick p ON p.grid = x.station_id % 34 AND p.h = x.t // 3600 LEFT JOIN seen ON seen.grid = x.station_id % 34
LEFT JOIN live ON live.cell = x.station_id % 25 AND live.day = x.t // 86400 AND live.hour = (x.t // 3600) % 24 LEFT JOIN prof ON prof.cell = x.station_id % 25 AND prof.hour = (x.t // 3600) % 24
LEFT JOIN lg ON lg.station_id = x.station_id LEFT JOIN lp ON lp.station_id = x.station_id AND lp.hour = ({ANCHOR} // 3600) % 24"""


@query("c20_inference_features", _c20_sql())
def c20(spark, sf):
    """Station x horizon at one anchor: weather of the target hour from the forecast, else the last observation; population
    of the target hour as published, else its profile before the anchor; the censored count at the anchor, else the
    station's profile of the hour, each with the source it came from; exposure from the last stock."""
    from .dispatch import forecast_hours

    x = forecast(spark, sf).select("station_id", "horizon", (ANCHOR + F.col("horizon") * 3600).alias("t"))
    x = x.withColumns({"grid": F.col("station_id") % 34, "cell": F.col("station_id") % 25, "h": F.floor(F.col("t") / 3600), "day_": F.floor(F.col("t") / 86400), "hour": F.floor(F.col("t") / 3600) % 24})
    picked = forecast_hours(spark, sf).select("grid", "h", F.col("temp").alias("ahead"))
    seen = weather(spark, sf).where(f"temp is not null and obs_s <= {ANCHOR}").groupBy("grid").agg(F.max_by("temp", F.struct("obs_s", "event_id")).alias("seen"))
    p = population(spark, sf)
    live = p.where("estimated").groupBy("cell", F.col("day").alias("day_"), "hour").agg(F.max("spop").alias("live"))
    prof = p.where(f"day < {ANCHOR // 86400}").groupBy("cell", "hour").agg(F.max("spop").alias("prof"))
    t = trips(spark, sf)
    lag = R.censored_counts(t).where(f"tick <= {ANCHOR}").groupBy("station_id").agg(F.max_by("count", "tick").alias("lag"))
    usual = R.future_counts(t).where(f"tick % 3600 = 0 and tick < {ANCHOR} and floor(tick / 3600) % 24 = {ANCHOR // 3600 % 24}").groupBy("station_id").agg(F.max("count").alias("usual"))
    bikes = stock(spark, sf).where(f"tick <= {ANCHOR}").groupBy("station_id").agg(F.max_by("bikes", F.struct("tick", "event_id")).alias("bikes"))
    out = x.join(picked, ["grid", "h"], "left").join(seen, "grid", "left").join(live, ["cell", "day_", "hour"], "left").join(prof, ["cell", "hour"], "left")
    for by in (lag, usual, bikes):
        out = out.join(by, "station_id", "left")
    first = lambda a, b, na, nb: F.when(F.col(a).isNotNull(), na).when(F.col(b).isNotNull(), nb).otherwise("missing")
    return out.select(
        "station_id",
        "horizon",
        *calendar(F.col("t")),
        F.bround(F.coalesce("ahead", "seen"), 6).alias("temp"),
        first("ahead", "seen", "forecast", "observed").alias("temp_from"),
        F.coalesce("live", "prof").alias("pop_total"),
        first("live", "prof", "live", "profile").alias("pop_from"),
        F.coalesce("lag", "usual", F.lit(0).cast("long")).alias("rental_lag_1h"),
        F.col("lag").isNull().alias("lag_fallback"),
        F.when(F.col("bikes") <= 0, 0.05).otherwise(1.0).alias("exposure"),
    )


@query("p26_exposure", "SELECT event_id, CASE WHEN bikes <= 0 THEN 0.05 ELSE 1.0 END::DOUBLE AS exposure FROM stock")
def p26(spark, sf):
    return stock(spark, sf).select("event_id", F.when(F.col("bikes") <= 0, 0.05).otherwise(1.0).alias("exposure"))


@query("w04_first_row_per_hour", "SELECT station_id, hour_s, event_id, bikes FROM (SELECT *, tick // 3600 * 3600 AS hour_s, row_number() OVER (PARTITION BY station_id, tick // 3600 ORDER BY tick, event_id) AS rn FROM stock) WHERE rn = 1")
def w04(spark, sf):
    s = stock(spark, sf).withColumn("hour_s", R.tick_floor(F.col("tick"), 3600))
    return s.groupBy("station_id", "hour_s").agg(F.min(F.struct("tick", "event_id", "bikes")).alias("x")).select("station_id", "hour_s", "x.event_id", "x.bikes")


@query("c02_hourly_stock_snapshot", "SELECT station_id, hour_s, bikes, bikes <= 0 AS stock_out FROM (SELECT *, tick // 3600 * 3600 AS hour_s, row_number() OVER (PARTITION BY station_id, tick // 3600 ORDER BY tick, event_id) AS rn FROM stock) WHERE rn = 1")
def c02(spark, sf):
    return w04(spark, sf).select("station_id", "hour_s", "bikes", (F.col("bikes") <= 0).alias("stock_out"))


@query("c21_bulk_censored_count", """WITH s AS (SELECT DISTINCT station_id FROM trips UNION SELECT unnest([22, 23])), n AS (SELECT station_id, count(*) FILTER (WHERE start_s >= 1705276800 - 6000 AND start_s < 1705276800 - 2400 AND end_s <= 1705276800)::BIGINT AS n FROM trips GROUP BY ALL)
SELECT s.station_id::BIGINT AS station_id, n.n FROM s LEFT JOIN n USING (station_id)""")
def c21(spark, sf):
    t = trips(spark, sf)
    ids = t.select("station_id").union(t.select((F.col("station_id") % 2 + 22).alias("station_id"))).distinct()
    n = t.groupBy("station_id").agg(F.count_if((F.col("start_s") >= 1705276800 - 6000) & (F.col("start_s") < 1705276800 - 2400) & (F.col("end_s") <= 1705276800)).alias("n"))
    return ids.join(n, "station_id", "left")


@query("c22_returns_last_hour", "SELECT end_station_id AS station_id, count(*)::BIGINT AS returns FROM trips WHERE end_s >= 1705276800 - 3600 AND end_s < 1705276800 GROUP BY ALL")
def c22(spark, sf):
    return trips(spark, sf).where("end_s >= 1705276800 - 3600 and end_s < 1705276800").groupBy(F.col("end_station_id").alias("station_id")).agg(F.count("*").alias("returns"))


@query("a18_interval_flows", "SELECT station_id, b, sum(o)::BIGINT AS rented, sum(i)::BIGINT AS returned FROM (SELECT station_id, start_s // 300 AS b, 1 AS o, 0 AS i FROM trips UNION ALL SELECT end_station_id, end_s // 300, 0, 1 FROM trips WHERE end_s IS NOT NULL) GROUP BY ALL")
def a18(spark, sf):
    t = trips(spark, sf)
    both = t.select("station_id", F.floor(F.col("start_s") / 300).alias("b"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(t.where("end_s is not null").select(F.col("end_station_id").alias("station_id"), F.floor(F.col("end_s") / 300).alias("b"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return both.groupBy("station_id", "b").agg(F.sum("o").alias("rented"), F.sum("i").alias("returned"))


@query("w19_consecutive_trip_relocation", """SELECT event_id, bike_id, prev_end, station_id FROM (SELECT *, lag(end_station_id) OVER w AS prev_end, lag(end_s) OVER w AS prev_end_s FROM trips WINDOW w AS (PARTITION BY bike_id ORDER BY start_s, event_id))
WHERE prev_end <> station_id AND start_s - prev_end_s BETWEEN 0 AND 172800""")
def w19(spark, sf):
    from pyspark.sql import Window as W

    w = W.partitionBy("bike_id").orderBy("start_s", "event_id")
    t = trips(spark, sf).withColumns({"prev_end": F.lag("end_station_id").over(w), "prev_end_s": F.lag("end_s").over(w)})
    return t.where("prev_end <> station_id and start_s - prev_end_s between 0 and 172800").select("event_id", "bike_id", "prev_end", "station_id")
