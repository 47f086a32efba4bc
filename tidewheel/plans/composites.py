"""Composite table operators: station dimension, demand projection and serving."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import serving as SV
from ..operators import station_table as ST
from ..sources import incremental as I
from ..sources.files import work_folder
from .base import centers, forecast, query, seconds, stations, stock, table, weather
from .scalar import hav_sql
from .space import nearest


def ev(spark, sf):
    return table(spark, sf, "events").withColumn("s", seconds("ts"))


@query("c03_weather_by_availability", "WITH a AS (SELECT *, CASE WHEN event_id % 2 = 0 THEN obs_s // 3600 * 3600 + 2400 ELSE base_s END AS avail FROM weather), r AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY grid, obs_s // 3600 ORDER BY base_s DESC, event_id) = 1) SELECT avail // 600 AS slot, grid, max(temp) AS temp FROM r WHERE temp IS NOT NULL GROUP BY ALL")
def c03(spark, sf):
    w = weather(spark, sf).withColumn("avail", F.when(F.col("event_id") % 2 == 0, F.floor(F.col("obs_s") / 3600) * 3600 + 2400).otherwise(F.col("base_s")))
    best = w.groupBy("grid", F.floor(F.col("obs_s") / 3600).alias("h")).agg(F.min(F.struct((-F.col("base_s")).alias("r"), "event_id", "temp", "avail")).alias("x"))
    return best.where("x.temp is not null").groupBy(F.floor(F.col("x.avail") / 600).alias("slot"), "grid").agg(F.max("x.temp").alias("temp"))


_K = geo.lambert_constants()


def _cell_sql(lat, lon):
    ra = f"({_K['re'] * _K['sf']!r} / pow(tan(pi() / 4 + radians({lat}) / 2), {_K['sn']!r}))"
    th = f"((radians({lon}) - {_K['olon']!r}) * {_K['sn']!r})"
    return f"floor({ra} * sin({th}) + 43.5)::BIGINT || '_' || floor({_K['ro']!r} - {ra} * cos({th}) + 136.5)::BIGINT"


def _between(a, b):
    return hav_sql("a", "b").replace("a.", a).replace("b.", b)


_C14 = f"""
WITH live AS (
  SELECT s_suppkey AS station_id, s_suppkey % 25 + 5 AS capacity, CASE WHEN s_suppkey % 6 <> 0 THEN 37.5 + s_suppkey / 10000.0 END AS lat,
    CASE WHEN s_suppkey % 9 <> 0 THEN 126.9 + s_suppkey / 10000.0 END AS lon
  FROM supplier WHERE s_suppkey % 3 = 0),
m AS (SELECT station_id, capacity, CASE WHEN station_id % 50 <> 6 THEN lat END AS lat, lon FROM stations),
e AS (
  SELECT m.station_id, coalesce(l.capacity, m.capacity)::BIGINT AS capacity, l.lat IS NOT NULL AND l.lon IS NOT NULL AS live, m.lat IS NOT NULL AS placed,
    CASE WHEN l.lat IS NOT NULL AND l.lon IS NOT NULL THEN l.lat ELSE m.lat END AS lat,
    CASE WHEN l.lat IS NOT NULL AND l.lon IS NOT NULL THEN l.lon WHEN m.lat IS NOT NULL THEN m.lon END AS lon
  FROM m LEFT JOIN live l USING (station_id)),
known AS (SELECT DISTINCT {_cell_sql('lat', 'lon')} AS weather_cell FROM stations WHERE station_id % 97 <> 1)
SELECT station_id, capacity, lat, lon, CASE WHEN live THEN 'live' WHEN placed THEN 'master' END AS place_source, weather_cell
FROM e LEFT JOIN known ON weather_cell = {_cell_sql('e.lat', 'e.lon')}"""


@query("c14_station_enrichment", _C14)
def c14(spark, sf):
    """Live values over the master table, whole places only, and the weather cell; fails below 95 % of mapped stations."""
    k = F.col("s_suppkey")
    live = table(spark, sf, "supplier").where("s_suppkey % 3 = 0")
    live = live.select(k.alias("station_id"), (k % 25 + 5).alias("capacity"), F.when(k % 6 != 0, 37.5 + k / 10000.0).alias("lat"), F.when(k % 9 != 0, 126.9 + k / 10000.0).alias("lon"))
    s = stations(spark, sf)
    master = s.select("station_id", "capacity", F.when(F.col("station_id") % 50 != 6, F.col("lat")).alias("lat"), "lon")
    cells = s.where("station_id % 97 <> 1").select(ST.weather_cell(F.col("lat"), F.col("lon")).alias("weather_cell")).distinct()
    return ST.enrich(master, live, cells)


_C15 = f"""
WITH m AS (
  SELECT station_id, CASE WHEN station_id % 19 <> 3 THEN 'road ' || station_id END AS address, CASE WHEN station_id % 23 <> 5 THEN lat + CASE WHEN station_id % 8 = 2 THEN 0.01 ELSE 0 END END AS lat, lon
  FROM stations WHERE station_id % 17 <> 4),
w AS (
  SELECT station_id, no, CASE WHEN (station_id + no) % 6 <> 0 THEN 'name ' || station_id END AS name, capacity + no % 2 AS capacity,
    CASE WHEN station_id % 29 <> 7 THEN lat + CASE WHEN station_id % 31 = 9 THEN 0.02 ELSE 0 END END AS lat, lon, 1706659200 - (no - 1) * 300 AS seen_s
  FROM stations, (SELECT unnest(range(1, 4)) AS no) WHERE (station_id // 7 + no) % 5 <> 0 AND station_id % 37 <> 11),
p AS (
  SELECT station_id, 'old ' || station_id AS name, 'road ' || station_id AS address, capacity, lat, lon, 'master' AS source, 1706000000 AS base_s, 1706659200 - 900 AS seen_s, station_id % 3 <> 0 AS active
  FROM stations WHERE station_id % 11 <> 0),
f AS (SELECT station_id, max(CASE WHEN no = 1 THEN 1 END) IS NOT NULL AS listed, coalesce(min(no) FILTER (WHERE name IS NOT NULL), 4) - 1 AS streak FROM w GROUP BY ALL),
j AS (
  SELECT s.station_id, p.station_id IS NOT NULL AS had, p.name AS p_name, p.address AS p_address, p.capacity AS p_capacity, p.lat AS p_lat, p.lon AS p_lon, p.base_s AS p_base, p.seen_s AS p_seen, coalesce(p.active, false) AS was,
    m.address, m.lat AS m_lat, m.lon AS m_lon, w.name, w.capacity, w.lat AS w_lat, w.lon AS w_lon, w.seen_s, w.name IS NOT NULL AS valid, coalesce(f.streak, 3) AS streak, s.station_id % 16 = 2 AS approved, s.station_id % 4 = 0 AS ready
  FROM stations s LEFT JOIN p USING (station_id) LEFT JOIN m USING (station_id) LEFT JOIN w ON w.station_id = s.station_id AND w.no = 1 LEFT JOIN f ON f.station_id = s.station_id
  WHERE p.station_id IS NOT NULL OR w.name IS NOT NULL),
d AS (
  SELECT *, coalesce(p_lat IS NOT NULL AND {_between('m_', 'p_')} > 100, false) AS far_p,
    coalesce(w_lat IS NOT NULL AND {_between('m_', 'w_')} > 100, false) AS far_w
  FROM j),
c AS (
  SELECT *, CASE WHEN address IS NULL THEN 'previous' WHEN m_lat IS NULL AND had THEN 'previous' WHEN m_lat IS NULL THEN 'realtime' WHEN (far_p OR far_w) AND NOT approved THEN 'previous' ELSE 'master' END AS choice
  FROM d),
o AS (
  SELECT *, CASE choice WHEN 'master' THEN m_lat WHEN 'realtime' THEN w_lat ELSE p_lat END AS lat, CASE choice WHEN 'master' THEN m_lon WHEN 'realtime' THEN w_lon ELSE p_lon END AS lon,
    CASE WHEN valid THEN was OR ready ELSE was AND streak < 3 END AS active,
    CASE WHEN valid THEN name ELSE p_name END AS o_name, CASE WHEN valid THEN capacity ELSE p_capacity END AS o_capacity, CASE WHEN choice <> 'previous' THEN address ELSE p_address END AS o_address
  FROM c),
k AS (SELECT * FROM o WHERE lat IS NOT NULL AND (had OR choice <> 'previous')),
near AS (SELECT k.station_id, c.center_id, row_number() OVER (PARTITION BY k.station_id ORDER BY {hav_sql('k', 'c')}, c.center_id) AS rn FROM k, centers c)
SELECT station_id, o_name AS name, o_address AS address, o_capacity::BIGINT AS capacity, lat, lon, CASE WHEN choice = 'previous' THEN 'master' ELSE choice END AS source,
  CASE WHEN choice <> 'previous' THEN 1706600000 ELSE p_base END::BIGINT AS base_s, coalesce(seen_s, p_seen)::BIGINT AS seen_s, active, choice = 'previous' AS kept,
  CASE WHEN NOT had THEN 'insert' WHEN active AND NOT was THEN 'activate' WHEN NOT active AND was THEN 'deactivate' WHEN lat <> p_lat OR lon <> p_lon THEN 'move'
    WHEN o_name IS DISTINCT FROM p_name OR o_capacity IS DISTINCT FROM p_capacity OR o_address IS DISTINCT FROM p_address THEN 'update' ELSE 'same' END AS change,
  center_id, {_cell_sql('lat', 'lon')} AS weather_cell
FROM k JOIN near USING (station_id) WHERE rn = 1"""


def station_inputs(spark, sf):
    """A master snapshot, three windows, the previous table, ready stations and approvals, all made from the stations."""
    s, i = stations(spark, sf), F.col("station_id")
    far = F.when(i % 8 == 2, 0.01).otherwise(0.0)
    master = s.where("station_id % 17 <> 4").select("station_id", F.when(i % 19 != 3, F.concat(F.lit("road "), i)).alias("address"), F.when(i % 23 != 5, F.col("lat") + far).alias("lat"), "lon")
    no = F.explode(F.sequence(F.lit(1), F.lit(3)))
    w = s.withColumn("no", no).where("(floor(station_id / 7) + no) % 5 <> 0 and station_id % 37 <> 11")
    moved = F.when(i % 31 == 9, 0.02).otherwise(0.0)
    windows = w.select(
        "station_id",
        "no",
        F.when((i + F.col("no")) % 6 != 0, F.concat(F.lit("name "), i)).alias("name"),
        (F.col("capacity") + F.col("no") % 2).alias("capacity"),
        F.when(i % 29 != 7, F.col("lat") + moved).alias("lat"),
        "lon",
        (1706659200 - (F.col("no") - 1) * 300).cast("long").alias("seen_s"),
    )
    old = {"name": F.concat(F.lit("old "), i), "address": F.concat(F.lit("road "), i), "source": F.lit("master"), "base_s": F.lit(1706000000).cast("long"), "seen_s": F.lit(1706659200 - 900).cast("long"), "active": i % 3 != 0}
    previous = s.where("station_id % 11 <> 0").select("station_id", "capacity", "lat", "lon", *[v.alias(k) for k, v in old.items()])
    approvals = master.where("station_id % 16 = 2").select("station_id", F.explode(F.array(F.lit("previous"), F.lit("realtime"))).alias("comparison"), "lat", "lon")
    return master, windows, previous, s.where("station_id % 4 = 0").select("station_id"), approvals


@query("c15_station_dimension", _C15)
def c15(spark, sf):
    """The next station table from a master snapshot, the last three windows and the table before, with centre and weather cell."""
    master, windows, previous, ready, approvals = station_inputs(spark, sf)
    out = ST.project(master, windows, previous, ready, approvals, 1706600000).drop("used")
    return nearest(out, centers(spark, sf)).drop("m").withColumn("weather_cell", ST.weather_cell(F.col("lat"), F.col("lon")))


#: Hours of forecast that a station's cell needs, from the hour after the anchor on (fixed value).
FORECAST_HOURS = 13

_C16 = f"""
WITH f AS (SELECT grid, obs_s // 3600 + unnest(range(1, 7 + event_id % 12)) AS h FROM weather WHERE temp IS NOT NULL),
span AS (SELECT max(obs_s // 3600) - 40 AS h0 FROM weather),
full_cells AS (SELECT grid FROM f, span WHERE h > h0 AND h <= h0 + {FORECAST_HOURS} GROUP BY grid HAVING count(DISTINCT h) = {FORECAST_HOURS}),
anchored AS (SELECT DISTINCT station_id FROM stock, span WHERE tick // 3600 = h0)
SELECT station_id FROM anchored WHERE station_id % 34 IN (SELECT grid FROM full_cells)"""


@query("c16_activation_readiness", _C16)
def c16(spark, sf):
    """Stations with stock in the anchor's hour whose weather cell has all 13 forecast hours after it.

    A weather row is a forecast for the 6 to 17 hours after its own; the hours of a cell's rows add up."""
    h = F.floor(F.col("obs_s") / 3600)
    w = weather(spark, sf)
    anchor = F.broadcast(w.agg((F.max(h) - 40).alias("h0")))  # one row
    ahead = w.where("temp is not null").select("grid", F.explode(F.sequence(h + 1, h + 6 + F.col("event_id") % 12)).alias("h"))
    hours = ahead.join(anchor).where("h > h0").where(F.col("h") <= F.col("h0") + FORECAST_HOURS).select("grid", "h").distinct()
    full = hours.groupBy("grid").count().where(F.col("count") == FORECAST_HOURS).select("grid")
    here = stock(spark, sf).join(anchor).where(F.floor(F.col("tick") / 3600) == F.col("h0")).select("station_id").distinct()
    return here.withColumn("grid", F.col("station_id") % 34).join(full, "grid", "left_semi").select("station_id")


@query("c23_demand_projection", "SELECT station_id, horizon, 1706659200 + horizon * 3600 AS target_s, round_even(rent, 0)::BIGINT AS rent, round_even(ret, 0)::BIGINT AS ret FROM forecast")
def c23(spark, sf):
    return forecast(spark, sf).select("station_id", "horizon", (1706659200 + F.col("horizon") * 3600).alias("target_s"), F.bround("rent", 0).cast("long").alias("rent"), F.bround("ret", 0).cast("long").alias("ret"))


@query("c29_station_list", "WITH l AS (SELECT station_id, arg_max(bikes, (tick, event_id)) AS bikes, max(tick) AS tick FROM stock GROUP BY ALL) SELECT s.station_id, l.bikes, CASE WHEN l.tick IS NULL THEN 'missing' WHEN 1706659200 - l.tick <= 7200 THEN 'ready' ELSE 'stale' END AS state FROM stations s LEFT JOIN l USING (station_id)")
def c29(spark, sf):
    l = stock(spark, sf).groupBy("station_id").agg(F.max(F.struct("tick", "event_id", "bikes")).alias("x"))
    age = 1706659200 - F.col("x.tick")
    return stations(spark, sf).join(l, "station_id", "left").select("station_id", "x.bikes", F.when(age.isNull(), "missing").when(age <= 7200, "ready").otherwise("stale").alias("state"))


_STATE = "CASE WHEN {x} IS NULL THEN 'missing' WHEN {x} BETWEEN now - {f} AND now + 300 THEN 'ready' {e}ELSE 'stale' END"


def _state_sql(x, fresh, expired):
    return _STATE.format(x=x, f=fresh, e=f"WHEN now - {x} > {expired} THEN 'expired' " if expired else "")


_TOLD = "CASE {s} WHEN 'missing' THEN 'not_published' WHEN 'ready' THEN 'fresh' WHEN 'expired' THEN 'publication_expired' ELSE 'publication_stale' END"
_ORDER = "list_position(['missing', 'expired', 'misaligned', 'stale', 'ready'], {s})"

_C30 = f"""
WITH e AS (SELECT user_id % 10 AS k, epoch_us(ts) // 1000000 AS s, epoch_us(ts) // 86400000000 AS day FROM events),
anchors AS (SELECT DISTINCT day, (day + 1) * 86400 AS now FROM e),
daily AS (SELECT day, k, max(s) // 600 * 600 AS logical, count(*) AS n FROM e WHERE k < 9 GROUP BY ALL),
st AS (SELECT a.now, d.k, max(d.logical) AS logical, arg_max(d.n, d.day) AS n FROM anchors a JOIN daily d ON d.day <= a.day AND d.day > a.day - 4 GROUP BY ALL),
wt AS (
  SELECT (obs_s // 86400 + 1) * 86400 AS now, count(DISTINCT (grid, obs_s // 3600)) AS n, bool_and(base_s >= (obs_s // 86400 + 1) * 86400 - 7200) AS fresh, min(base_s) AS oldest
  FROM weather WHERE temp IS NOT NULL AND obs_s % 86400 >= 79200 GROUP BY ALL),
we AS (SELECT (obs_s // 86400 + 1) * 86400 AS now, 2 * count(DISTINCT grid) AS expected FROM weather GROUP BY ALL),
p AS (
  SELECT a.now, {', '.join(f"max(logical) FILTER (WHERE k = {i}) AS l{i}" for i in range(9))}, max(st.n) FILTER (WHERE k = 0) AS n0
  FROM anchors a LEFT JOIN st ON st.now = a.now GROUP BY a.now),
q AS (
  SELECT p.*, wt.n AS wn, we.expected, wt.fresh, wt.oldest, {_state_sql('l2', 600, 3600)} AS stock0, {_state_sql('l3', 600, 3600)} AS demand0, {_state_sql('l4', 600, 3600)} AS urgency0,
    {_state_sql('l5', 600, 3600)} AS routes0, {_state_sql('l6', 600, 3600)} AS weather0, {_state_sql('l7', 129600, None)} AS one, {_state_sql('l8', 129600, None)} AS two
  FROM p LEFT JOIN wt USING (now) LEFT JOIN we USING (now)),
r AS (SELECT *, CASE WHEN l1 IS NULL THEN 'missing' WHEN stock0 NOT IN ('missing', 'expired') AND l1 <> l2 THEN 'misaligned' ELSE stock0 END AS stock1 FROM q),
t AS (
  SELECT *, stock1 = 'ready' AND demand0 = 'ready' AND urgency0 = 'ready' AND routes0 = 'ready' AS all_ready, coalesce(l2 = l3 AND l3 = l4 AND l4 = l5, false) AS same,
    weather0 = 'ready' AND coalesce(wn <> expected, true) AS short, weather0 = 'ready' AND NOT coalesce(fresh, false) AS old
  FROM r),
u AS (
  SELECT now, all_ready AND same AS can_dispatch, c.* FROM t, LATERAL (VALUES
    ('stock', CASE WHEN all_ready AND NOT same THEN 'misaligned' ELSE stock1 END, CASE WHEN all_ready AND NOT same THEN 'operational_anchor_mismatch' WHEN stock1 = 'misaligned' THEN 'station_stock_anchor_mismatch' ELSE {_TOLD.format(s='stock1')} END, CASE WHEN stock1 <> 'missing' THEN l2 END),
    ('demand', CASE WHEN all_ready AND NOT same THEN 'misaligned' ELSE demand0 END, CASE WHEN all_ready AND NOT same THEN 'operational_anchor_mismatch' ELSE {_TOLD.format(s='demand0')} END, l3),
    ('urgency', CASE WHEN all_ready AND NOT same THEN 'misaligned' ELSE urgency0 END, CASE WHEN all_ready AND NOT same THEN 'operational_anchor_mismatch' ELSE {_TOLD.format(s='urgency0')} END, l4),
    ('routes', CASE WHEN all_ready AND NOT same THEN 'misaligned' ELSE routes0 END, CASE WHEN all_ready AND NOT same THEN 'operational_anchor_mismatch' ELSE {_TOLD.format(s='routes0')} END, l5),
    ('weather', CASE WHEN short THEN 'misaligned' WHEN old THEN 'stale' ELSE weather0 END, CASE WHEN short THEN 'weather_horizon_incomplete' WHEN old THEN 'weather_issue_stale' ELSE {_TOLD.format(s='weather0')} END, CASE WHEN weather0 <> 'missing' THEN oldest END),
    ('events', CASE WHEN {_ORDER.format(s='two')} < {_ORDER.format(s='one')} THEN two ELSE one END, CASE WHEN l7 IS NULL AND l8 IS NULL THEN 'not_published' WHEN one = 'ready' AND two = 'ready' THEN 'fresh' ELSE 'event_source_incomplete' END, least(l7, l8)),
    ('regions', CASE WHEN coalesce(n0, 0) > 0 THEN 'ready' ELSE 'missing' END, CASE WHEN coalesce(n0, 0) > 0 THEN 'fresh' ELSE 'not_published' END, l0)) AS c(component, state, reason, data_s)),
o AS (
  SELECT now, CASE WHEN bool_or(component IN ('stock', 'demand') AND state IN ('missing', 'expired')) THEN 'unavailable' WHEN bool_and(state = 'ready') THEN 'healthy' ELSE 'degraded' END AS overall
  FROM u GROUP BY now)
SELECT now, component, state, reason, data_s, CASE WHEN data_s IS NOT NULL THEN round_even(greatest(0, now - data_s) / 60.0, 1) END AS age_min, can_dispatch, overall FROM u JOIN o USING (now)"""


@query("c30_serving_health", _C30)
def c30(spark, sf):
    """Health at the end of each day: a publication's newest data of the last four days, and the day's last two hours of weather."""
    e = ev(spark, sf).select((F.col("user_id") % 10).alias("k"), "s", F.floor(F.col("s") / 86400).alias("day"))
    end = lambda day: ((day + 1) * 86400).alias("now")
    daily = e.where("k < 9").groupBy("day", "k").agg((F.floor(F.max("s") / 600) * 600).alias("logical_s"), F.count("*").alias("n"))
    later = daily.withColumn("_later", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("at", F.col("day") + F.col("_later"))
    newest = later.groupBy("at", "k").agg(F.max("logical_s").alias("logical_s"), F.max_by("n", "day").alias("n"))
    anchors = e.select(end(F.col("day"))).distinct()
    names = F.array(*map(F.lit, SV.KEYS))
    states = newest.select(end(F.col("at")), F.get(names, F.col("k").cast("int")).alias("key"), "logical_s", "n")
    w = weather(spark, sf).withColumn("now", (F.floor(F.col("obs_s") / 86400) + 1) * 86400)
    cells = w.select("now", "grid").distinct().groupBy("now").agg((2 * F.count("*")).alias("expected"))
    late = w.where("temp is not null and obs_s % 86400 >= 79200")
    rows = late.groupBy("now").agg(F.count_distinct("grid", F.floor(F.col("obs_s") / 3600)).alias("n"), F.bool_and(F.col("base_s") >= F.col("now") - 7200).alias("fresh"), F.min("base_s").alias("oldest_s"))
    return SV.health(anchors, states, cells.join(rows, "now", "left"))


_C29B = """
WITH span AS (SELECT max(tick) // 300 * 300 - 3600 AS now FROM stock),
l AS (SELECT station_id, max(tick) // 300 * 300 AS base_s, arg_max(bikes, (tick, event_id)) AS bikes FROM stock, span WHERE tick < now + 300 GROUP BY ALL),
s AS (SELECT s.station_id, CASE WHEN s.station_id % 9 <> 4 THEN now ELSE now - 300 END AS seen_s, now FROM stations s, span WHERE s.station_id % 7 <> 3),
k AS (SELECT l.station_id, CASE WHEN l.station_id % 5 <> 1 THEN now ELSE base_s END AS base_s, bikes FROM l, span),
f AS (SELECT station_id, now AS base_s, now + horizon * 3600 AS target_s, now FROM forecast, span WHERE station_id % 6 <> 2 AND NOT (station_id % 8 = 5 AND horizon = 4)),
g AS (SELECT station_id, count(*) AS n, count(DISTINCT target_s) AS times, min(target_s) AS a, max(target_s) AS z FROM f GROUP BY ALL)
SELECT station_id, CASE WHEN s.station_id IS NULL THEN 'station_not_found' WHEN g.n IS NULL THEN 'forecast_not_available' WHEN g.n <> 12 OR g.times <> 12 THEN 'forecast_not_ready'
    WHEN coalesce(k.base_s = s.now AND s.seen_s = k.base_s, false) THEN 'ready' ELSE 'stock_not_aligned' END AS state,
  CASE WHEN s.station_id IS NOT NULL AND g.n = 12 AND coalesce(k.base_s = s.now AND s.seen_s = k.base_s, false) THEN 12 END::INTEGER AS points
FROM s FULL JOIN g USING (station_id) LEFT JOIN k USING (station_id)"""


def serving_inputs(spark, sf):
    """Stations with the time they were last seen, their newest stock, and the forecast panel of one anchor."""
    st = stock(spark, sf)
    newest = st.agg(F.max("tick")).first()[0]
    now = (newest or 0) // 300 * 300 - 3600
    i = F.col("station_id")
    last = st.where(F.col("tick") < now + 300).groupBy("station_id").agg(F.max(F.struct("tick", "event_id", "bikes")).alias("x"))
    here = last.select("station_id", F.when(i % 5 != 1, F.lit(now)).otherwise(F.floor(F.col("x.tick") / 300) * 300).cast("long").alias("base_s"), "x.bikes")
    seen = stations(spark, sf).select("station_id", "region", "capacity", F.when(i % 9 != 4, now).otherwise(now - 300).cast("long").alias("seen_s"), (i % 7 != 3).alias("active"))
    panel = forecast(spark, sf).where("station_id % 6 <> 2 and not (station_id % 8 = 5 and horizon = 4)")
    panel = panel.select("station_id", F.lit(now).cast("long").alias("base_s"), (now + F.col("horizon") * 3600).cast("long").alias("target_s"), "rent", "ret")
    return seen, here, panel, now


@query("c29b_forecast_alignment", _C29B)
def c29b(spark, sf):
    """The state of each station's forecast, and its number of points where it is ready."""
    seen, here, panel, now = serving_inputs(spark, sf)
    return SV.forecast_states(seen, panel, here, now).select("station_id", "state", F.when(F.col("points").isNotNull(), F.size("points")).alias("points"))


_C29C = """
WITH span AS (SELECT max(tick) // 300 * 300 - 3600 AS now FROM stock),
l AS (SELECT station_id, max(tick) // 300 * 300 AS base_s, arg_max(bikes, (tick, event_id)) AS bikes FROM stock, span WHERE tick < now + 300 GROUP BY ALL)
SELECT s.station_id, region, capacity, CASE WHEN s.station_id % 9 <> 4 THEN now ELSE now - 300 END AS seen_s, bikes
FROM stations s JOIN l USING (station_id), span
WHERE s.station_id % 7 <> 3 AND CASE WHEN s.station_id % 9 <> 4 THEN now ELSE now - 300 END = CASE WHEN s.station_id % 5 <> 1 THEN now ELSE base_s END"""


@query("c29c_station_detail", _C29C)
def c29c(spark, sf):
    """Active stations with the stock of the very time they were last seen."""
    seen, here, _, now = serving_inputs(spark, sf)
    return SV.station_rows(seen, here, now).select("station_id", "region", "capacity", "seen_s", "bikes")


_C32 = """
WITH r AS (
  SELECT o_orderkey AS route_id, o_custkey % 11 AS center_id, CASE o_orderstatus WHEN 'O' THEN 'proposed' WHEN 'P' THEN 'dispatched' ELSE 'completed' END AS status,
    epoch_us(o_orderdate) // 1000000 AS proposed_s, CASE WHEN o_orderstatus <> 'O' THEN epoch_us(o_orderdate) // 1000000 + o_orderkey % 7 * 600 END AS dispatched_s FROM orders),
st AS (SELECT l_orderkey AS route_id, l_linenumber AS visit, l_suppkey AS station_id, CASE WHEN l_returnflag = 'R' THEN 'dropoff' ELSE 'pickup' END AS action, l_quantity::BIGINT AS bikes, l_partkey FROM lineitem),
n AS (
  SELECT route_id, '[' || string_agg('{"visit":' || visit || ',"station_id":' || station_id || ',"action":"' || action || '","bikes":' || bikes || '}', ',' ORDER BY visit, station_id, action, bikes) || ']' AS stops,
    arg_min(station_id, (visit, station_id)) FILTER (WHERE action = 'dropoff') AS anchor
  FROM st GROUP BY ALL),
w AS (SELECT route_id, row_number() OVER (PARTITION BY center_id, dispatched_s // 86400 ORDER BY dispatched_s, route_id) AS work_no FROM r WHERE dispatched_s IS NOT NULL),
k AS (
  SELECT route_id, dense_rank() OVER (PARTITION BY center_id, proposed_s ORDER BY s_acctbal DESC, anchor) AS priority
  FROM r JOIN n USING (route_id) JOIN supplier ON s_suppkey = anchor WHERE status = 'proposed' AND s_suppkey % 10 <> 0)
SELECT route_id, center_id, status, work_no, priority, anchor, coalesce(stops, '[]') AS stops FROM r LEFT JOIN n USING (route_id) LEFT JOIN w USING (route_id) LEFT JOIN k USING (route_id)"""


@query("c32_route_aggregate", _C32)
def c32(spark, sf):
    """Orders as routes: numbers of dispatched ones, ranks of proposed ones by their first drop-off, and nested stops."""
    o, day = table(spark, sf, "orders"), seconds("o_orderdate")
    status = F.when(F.col("o_orderstatus") == "O", "proposed").when(F.col("o_orderstatus") == "P", "dispatched").otherwise("completed")
    sent = F.when(F.col("o_orderstatus") != "O", day + F.col("o_orderkey") % 7 * 600)
    routes = o.select(F.col("o_orderkey").alias("route_id"), (F.col("o_custkey") % 11).alias("center_id"), status.alias("status"), day.alias("proposed_s"), sent.alias("dispatched_s"))
    action = F.when(F.col("l_returnflag") == "R", "dropoff").otherwise("pickup")
    l = table(spark, sf, "lineitem")
    stops = l.select(F.col("l_orderkey").alias("route_id"), F.col("l_linenumber").cast("long").alias("visit"), F.col("l_suppkey").alias("station_id"), action.alias("action"), F.col("l_quantity").cast("long").alias("bikes"))
    score = table(spark, sf, "supplier").where("s_suppkey % 10 <> 0").select(F.col("s_suppkey").alias("station_id"), F.col("s_acctbal").alias("score"))
    asked = routes.where("status = 'proposed'").select("route_id", F.col("proposed_s").alias("base_s"))
    times = stops.join(asked, "route_id").select("station_id", "base_s").distinct()
    return SV.route_rows(routes, stops, times.join(score, "station_id")).withColumn("stops", F.to_json("stops"))


_RANK = "CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 END"


@query("c33_state_transitions", f"WITH t AS (SELECT user_id, event_id, {_RANK} AS r, max({_RANK}) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events) SELECT user_id, max(r)::BIGINT AS state, count(*) FILTER (WHERE r > coalesce(before, 0))::BIGINT AS accepted, count(*) FILTER (WHERE r <= coalesce(before, 0))::BIGINT AS rejected FROM t WHERE r IS NOT NULL GROUP BY ALL")
def c33(spark, sf):
    """A transition is legal if it goes beyond every earlier state; the log folds to the newest legal one."""
    r = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", 2).when(F.col("event_type") == "purchase", 3)
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, -1)
    t = table(spark, sf, "events").withColumn("r", r).where("r is not null")
    t = t.withColumn("before", F.coalesce(F.max("r").over(w), F.lit(0)))
    return t.groupBy("user_id").agg(F.max("r").cast("long").alias("state"), F.count_if(F.col("r") > F.col("before")).alias("accepted"), F.count_if(F.col("r") <= F.col("before")).alias("rejected"))


@query("c34_publication_class", "WITH cur AS (SELECT user_id, max(epoch_us(ts) // 3600000000) AS v, arg_max(event_type, (ts, event_id)) AS h FROM events WHERE event_id % 2 = 0 GROUP BY ALL) SELECT e.event_id, CASE WHEN c.v IS NULL OR epoch_us(e.ts) // 3600000000 > c.v THEN 'publish' WHEN epoch_us(e.ts) // 3600000000 < c.v THEN 'stale' WHEN e.event_type = c.h THEN 'replay' ELSE 'conflict' END AS class FROM events e LEFT JOIN cur c USING (user_id) WHERE e.event_id % 2 = 1")
def c34(spark, sf):
    e = ev(spark, sf).withColumn("v", F.floor(F.col("s") / 3600))
    cur = e.where("event_id % 2 = 0").groupBy("user_id").agg(F.max("v").alias("cv"), F.max_by("event_type", F.struct("ts", "event_id")).alias("h"))
    out = e.where("event_id % 2 = 1").join(cur, "user_id", "left")
    return out.select("event_id", F.when(F.col("cv").isNull() | (F.col("v") > F.col("cv")), "publish").when(F.col("v") < F.col("cv"), "stale").when(F.col("event_type") == F.col("h"), "replay").otherwise("conflict").alias("class"))


_C35 = """
WITH e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) // 1000000 AS s FROM events),
r AS (
  SELECT *, s // 86400 + CASE WHEN event_id % 41 = 5 THEN 1 ELSE 0 END AS day FROM e
  UNION ALL SELECT *, s // 86400 FROM e WHERE event_id % 19 = 2),
k AS (SELECT *, CASE WHEN NOT (event_type <> 'error' AND value BETWEEN 1 AND 99) THEN 'invalid' WHEN s // 86400 <> day THEN 'out_of_day' ELSE 'ok' END AS kind FROM r),
w AS (SELECT day, count(*) AS written, count(DISTINCT s // 3600) AS hours FROM (SELECT DISTINCT event_id, user_id, s, day FROM k WHERE kind = 'ok') GROUP BY ALL),
n AS (SELECT day, count(*) AS fetched, count(*) FILTER (WHERE kind = 'invalid') AS invalid, count(*) FILTER (WHERE kind = 'out_of_day') AS out_of_day FROM k GROUP BY ALL)
SELECT day, fetched, invalid, out_of_day, fetched - invalid - out_of_day - coalesce(written, 0) AS repeated, coalesce(written, 0) AS written, coalesce(hours, 0) AS hours FROM n LEFT JOIN w USING (day)"""


@query("c35_archive_load", _C35)
def c35(spark, sf):
    """Day files of events, some rows filed a day late and some twice, loaded as hourly partitions with statistics per file."""
    e = ev(spark, sf).select("event_id", "user_id", "event_type", "value", "s")
    late = F.when(F.col("event_id") % 41 == 5, 1).otherwise(0)
    rows = e.withColumn("file_day", F.floor(F.col("s") / 86400) + late).unionByName(e.where("event_id % 19 = 2").withColumn("file_day", F.floor(F.col("s") / 86400)))
    valid = (F.col("event_type") != "error") & F.col("value").between(1, 99)
    return I.load_archive(rows, work_folder(spark, "archive"), ["event_id", "user_id", "s"], valid)


@query("c37_quality_cache", "SELECT epoch_us(ts) // 86400000000 AS day, count(*)::BIGINT AS n, round_even(sum(pow(event_id * 7 % 11 - value / 10, 2)), 3) AS sq FROM events GROUP BY ALL")
def c37(spark, sf):
    """Two runs over a stored cache: the first evaluates the days before its date, the second only days that the cache
    lacks, which it adds."""
    from ..sources import files as S
    from .measures import errors

    e, path = errors(spark, sf).withColumn("q", F.pow(F.col("y") - F.col("mu"), 2)), S.work_folder(spark, "quality")
    state = lambda df: df.groupBy("day").agg(F.count("*").alias("n"), F.sum("q").alias("sq"))
    state(e.where("day < 19738")).write.parquet(path)
    cached = spark.read.parquet(path)
    state(e.join(cached.select("day"), "day", "left_anti")).write.mode("append").parquet(path)
    return spark.read.parquet(path).select("day", "n", F.bround("sq", 3).alias("sq"))
