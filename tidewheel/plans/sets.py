"""Joins, set operations and deduplication."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo
from ..sources import files as S
from .base import centers, population, query, seconds, stations, stock, table, trips, weather
from .scalar import hav_sql


def ev(spark, sf):
    return table(spark, sf, "events").withColumn("s", seconds("ts"))


@query("j03_active_semi_join", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT station_id FROM trips UNION SELECT end_station_id FROM trips UNION SELECT bike_id FROM trips)")
def j03(spark, sf):
    t = trips(spark, sf)
    ids = t.select(F.explode(F.array("station_id", "end_station_id", "bike_id")).alias("c_custkey")).distinct()
    return table(spark, sf, "customer").join(ids, "c_custkey", "left_semi").select("c_custkey")


@query("j07_star_join", """WITH r AS (SELECT station_id, start_s // 3600 AS h, count(*)::BIGINT AS rentals FROM trips GROUP BY ALL), w AS (SELECT grid, obs_s // 3600 AS h, max(temp) AS temp FROM weather GROUP BY ALL), p AS (SELECT cell, day * 24 + hour AS h, max(spop) AS spop FROM population GROUP BY ALL)
SELECT r.station_id, r.h, r.rentals, m.capacity::BIGINT AS capacity, w.temp, coalesce(p.spop, 0.0) AS spop FROM r LEFT JOIN stations m ON m.station_id = r.station_id LEFT JOIN w ON w.grid = r.station_id % 34 AND w.h = r.h LEFT JOIN p ON p.cell = r.station_id % 25 AND p.h = r.h""")
def j07(spark, sf):
    r = trips(spark, sf).groupBy("station_id", F.floor(F.col("start_s") / 3600).alias("h")).agg(F.count("*").alias("rentals"))
    w = weather(spark, sf).groupBy("grid", F.floor(F.col("obs_s") / 3600).alias("h")).agg(F.max("temp").alias("temp"))
    p = population(spark, sf).groupBy("cell", (F.col("day") * 24 + F.col("hour")).alias("h")).agg(F.max("spop").alias("spop"))
    out = r.join(stations(spark, sf).select("station_id", "capacity"), "station_id", "left").withColumns({"grid": F.col("station_id") % 34, "cell": F.col("station_id") % 25})
    return out.join(w, ["grid", "h"], "left").join(p, ["cell", "h"], "left").select("station_id", "h", "rentals", "capacity", "temp", F.coalesce("spop", F.lit(0.0)).alias("spop"))


@query("j10_name_then_number", """SELECT l_orderkey, l_linenumber, coalesce(a.s_suppkey, b.s_suppkey) AS station FROM lineitem LEFT JOIN supplier a ON l_orderkey % 3 = 0 AND a.s_name = 'Supplier#' || lpad((l_partkey % 120)::VARCHAR, 9, '0') LEFT JOIN supplier b ON b.s_suppkey = l_suppkey + 5""")
def j10(spark, sf):
    s = table(spark, sf, "supplier")
    name = F.when(F.col("l_orderkey") % 3 == 0, F.concat(F.lit("Supplier#"), F.lpad((F.col("l_partkey") % 120).cast("string"), 9, "0")))
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", name.alias("name"), (F.col("l_suppkey") + 5).alias("number"))
    by_name = s.select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("a"))
    by_number = s.select(F.col("s_suppkey").alias("number"), F.col("s_suppkey").alias("b"))
    return l.join(by_name, "name", "left").join(by_number, "number", "left").select("l_orderkey", "l_linenumber", F.coalesce("a", "b").alias("station"))


@query("j11_week_alignment", """SELECT cell, dong, hour, max(spop) FILTER (WHERE day // 7 % 4 = 0) AS w0, max(spop) FILTER (WHERE day // 7 % 4 = 1) AS w1, max(spop) FILTER (WHERE day // 7 % 4 = 2) AS w2, max(spop) FILTER (WHERE day // 7 % 4 = 3) AS w3 FROM population GROUP BY ALL""")
def j11(spark, sf):
    """Outer alignment of four weeks on (cell, district, hour): one conditional aggregation instead of three full joins."""
    week = F.floor(F.col("day") / 7) % 4
    return population(spark, sf).groupBy("cell", "dong", "hour").agg(*[F.max(F.when(week == k, F.col("spop"))).alias(f"w{k}") for k in range(4)])


@query("j16_time_aligned_join", "SELECT s.station_id, s.tick, s.bikes, l.anchor IS NOT NULL AS aligned FROM stock s LEFT JOIN (SELECT station_id, max(tick) AS anchor FROM stock GROUP BY ALL) l ON l.station_id = s.station_id AND l.anchor = s.tick")
def j16(spark, sf):
    s = stock(spark, sf)
    last = s.groupBy("station_id").agg(F.max("tick").alias("tick")).withColumn("aligned", F.lit(True))
    return s.join(last, ["station_id", "tick"], "left").select("station_id", "tick", "bikes", F.coalesce("aligned", F.lit(False)).alias("aligned"))


@query("j17_lateral_first_match", "SELECT o_orderkey, x.l_linenumber, x.l_partkey FROM orders LEFT JOIN LATERAL (SELECT l_linenumber, l_partkey FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' ORDER BY l_linenumber, l_partkey, l_suppkey LIMIT 1) x ON true")
def j17(spark, sf):
    first = table(spark, sf, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey")).alias("x"))
    return table(spark, sf, "orders").join(first, "o_orderkey", "left").select("o_orderkey", "x.l_linenumber", "x.l_partkey")


@query("j18_anti_filter", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def j18(spark, sf):
    r = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").join(r, "o_orderkey", "left_anti").select("o_orderkey")


@query("j19_desired_keys", "SELECT d.k, count(o_orderkey)::BIGINT AS n, CASE WHEN count(o_orderkey) = 0 THEN 'missing' ELSE 'present' END AS state FROM (VALUES ('F'), ('O'), ('P'), ('X')) d(k) LEFT JOIN orders ON o_orderstatus = d.k GROUP BY ALL")
def j19(spark, sf):
    d = spark.createDataFrame([("F",), ("O",), ("P",), ("X",)], "k string")
    n = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("k")).agg(F.count("*").alias("n"))
    return F.broadcast(d).join(n, "k", "left").select("k", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.when(F.col("n").isNull(), "missing").otherwise("present").alias("state"))


_FC = "fc AS (SELECT event_id, grid, base_s, base_s + (event_id % 8) * 1800 AS target_s, temp FROM weather WHERE temp IS NOT NULL)"


@query("j20_nearest_forecast", f"""WITH {_FC}, q AS (SELECT DISTINCT grid, obs_s // 3600 * 3600 AS at_s FROM weather), c AS (SELECT q.*, fc.*, row_number() OVER (PARTITION BY q.grid, q.at_s ORDER BY base_s DESC, abs(target_s - q.at_s), fc.event_id) AS rn FROM q JOIN fc ON fc.grid = q.grid AND fc.base_s <= q.at_s AND fc.base_s > q.at_s - 21600 AND abs(fc.target_s - q.at_s) <= 3600) SELECT grid, at_s, event_id, temp FROM c WHERE rn = 1""")
def j20(spark, sf):
    """Latest issue within 6 h whose target is within 1 h: issues are bucketed by 6 h, so the range join is an equi join on two buckets."""
    w = weather(spark, sf)
    fc = w.where("temp is not null").select("event_id", "grid", "base_s", (F.col("base_s") + (F.col("event_id") % 8) * 1800).alias("target_s"), "temp", F.floor(F.col("base_s") / 21600).alias("b"))
    q = w.select("grid", (F.floor(F.col("obs_s") / 3600) * 3600).alias("at_s")).distinct()
    q = q.withColumn("b", F.explode(F.array(F.floor(F.col("at_s") / 21600), F.floor(F.col("at_s") / 21600) - 1)))
    c = q.join(fc, ["grid", "b"]).where("base_s <= at_s and base_s > at_s - 21600 and abs(target_s - at_s) <= 3600")
    best = c.groupBy("grid", "at_s").agg(F.min(F.struct((-F.col("base_s")).alias("r"), F.abs(F.col("target_s") - F.col("at_s")).alias("d"), "event_id", "temp")).alias("x"))
    return best.select("grid", "at_s", "x.event_id", "x.temp")


@query("j21_latest_published", "WITH o AS (SELECT grid, obs_s, max(event_id) AS event_id FROM weather GROUP BY ALL), q AS (SELECT DISTINCT grid, obs_s // 3600 * 3600 + 3600 AS at FROM weather) SELECT q.grid, q.at, o.event_id FROM q ASOF LEFT JOIN o ON o.grid = q.grid AND q.at - 2400 >= o.obs_s")
def j21(spark, sf):
    w = weather(spark, sf)
    o = w.groupBy("grid", "obs_s").agg(F.max("event_id").alias("event_id")).select("grid", F.col("obs_s").alias("t"), F.lit(0).alias("k"), "event_id", F.lit(None).cast("long").alias("at"))
    q = w.select("grid", (F.floor(F.col("obs_s") / 3600) * 3600 + 3600).alias("at")).distinct().select("grid", (F.col("at") - 2400).alias("t"), F.lit(1).alias("k"), F.lit(None).cast("long").alias("event_id"), "at")
    # within a day by a window, across days by each day's last row: no task passes over all rows of a grid
    both = o.unionByName(q).withColumn("_day", F.floor(F.col("t") / 86400))
    inside, days = W.partitionBy("grid", "_day").orderBy("t", "k").rowsBetween(W.unboundedPreceding, 0), W.partitionBy("grid").orderBy("_day")
    per = both.groupBy("grid", "_day").agg(F.max_by("event_id", F.when(F.col("k") == 0, F.col("t"))).alias("_own"))
    per = per.select("grid", "_day", F.last("_own", ignorenulls=True).over(days.rowsBetween(W.unboundedPreceding, -1)).alias("_before"))
    seen = both.withColumn("_in", F.last("event_id", ignorenulls=True).over(inside)).where("k = 1").join(per, ["grid", "_day"])
    return seen.select("grid", "at", F.coalesce("_in", "_before").alias("event_id"))


@query("j22_three_way_intersection", "SELECT DISTINCT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase' INTERSECT SELECT user_id FROM events WHERE event_type = 'error'")
def j22(spark, sf):
    e = table(spark, sf, "events")
    a = e.where("event_type = 'click'").select("user_id").distinct()
    return a.join(e.where("event_type = 'purchase'").select("user_id"), "user_id", "left_semi").join(e.where("event_type = 'error'").select("user_id"), "user_id", "left_semi")


@query("u01_union_by_name", "SELECT 'out' AS kind, station_id, start_s AS t FROM trips UNION ALL SELECT 'in', end_station_id, end_s FROM trips WHERE end_s IS NOT NULL")
def u01(spark, sf):
    t = trips(spark, sf)
    back = t.where("end_s is not null").select(F.col("end_s").alias("t"), F.lit("in").alias("kind"), F.col("end_station_id").alias("station_id"))
    return t.select(F.lit("out").alias("kind"), "station_id", F.col("start_s").alias("t")).unionByName(back)


@query("u02_union_of_many", "SELECT h, event_id FROM events, (SELECT unnest(range(1, 13)) AS h) WHERE event_id % 12 < h")
def u02(spark, sf):
    """Twelve shifted copies: one explode, so the plan does not grow with their number."""
    e = table(spark, sf, "events")
    return e.select(F.explode(F.sequence(F.lit(1).cast("long"), F.lit(12).cast("long"))).alias("h"), "event_id").where("event_id % 12 < h")


@query("u03_distinct_union", "SELECT station_id FROM trips UNION SELECT end_station_id FROM trips")
def u03(spark, sf):
    t = trips(spark, sf)
    return t.select("station_id").union(t.select("end_station_id")).distinct()


_IDS = "a AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_returnflag = 'R')"


def _ids(spark, sf, flag):
    return table(spark, sf, "lineitem").where(f"l_returnflag = '{flag}'").select(F.col("l_orderkey").alias("id")).distinct()


@query("u04_support_intersection", f"WITH {_IDS} SELECT id FROM a INTERSECT SELECT id FROM b")
def u04(spark, sf):
    return _ids(spark, sf, "A").intersect(_ids(spark, sf, "R"))


@query("u05_new_and_resolved", f"WITH {_IDS} SELECT 'new' AS change, id FROM (SELECT id FROM b EXCEPT SELECT id FROM a) UNION ALL SELECT 'resolved', id FROM (SELECT id FROM a EXCEPT SELECT id FROM b)")
def u05(spark, sf):
    both = _ids(spark, sf, "A").withColumn("x", F.lit(1)).join(_ids(spark, sf, "R").withColumn("y", F.lit(1)), "id", "full")
    return both.where("x is null or y is null").select(F.when(F.col("x").isNull(), "new").otherwise("resolved").alias("change"), "id")


@query("u06_trained_but_inactive", "SELECT o_orderkey AS id FROM orders EXCEPT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A'")
def u06(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id")).subtract(_ids(spark, sf, "A"))


_SNAP = "p AS (SELECT station_id, region, lat, lon FROM stations WHERE station_id % 11 <> 0), n AS (SELECT station_id, CASE WHEN station_id % 50 = 1 THEN region + 1 ELSE region END AS region, CASE WHEN station_id % 40 = 2 THEN lat + 0.01 ELSE lat END AS lat, lon FROM stations WHERE station_id % 13 <> 0)"


@query("u07_station_changes", f"WITH {_SNAP} SELECT station_id, CASE WHEN n.region IS NULL THEN 'deactivated' WHEN p.region IS NULL THEN 'added' WHEN abs(p.lat - n.lat) > 0.001 THEN 'moved' ELSE 'recentred' END AS change FROM p FULL JOIN n USING (station_id) WHERE n.region IS NULL OR p.region IS NULL OR abs(p.lat - n.lat) > 0.001 OR p.region <> n.region")
def u07(spark, sf):
    s = stations(spark, sf)
    p = s.where("station_id % 11 <> 0").select("station_id", F.col("region").alias("r0"), F.col("lat").alias("lat0"))
    n = s.where("station_id % 13 <> 0").select("station_id", F.when(F.col("station_id") % 50 == 1, F.col("region") + 1).otherwise(F.col("region")).alias("r1"), F.when(F.col("station_id") % 40 == 2, F.col("lat") + 0.01).otherwise(F.col("lat")).alias("lat1"))
    moved = F.abs(F.col("lat0") - F.col("lat1")) > 0.001
    change = F.when(F.col("r1").isNull(), "deactivated").when(F.col("r0").isNull(), "added").when(moved, "moved").when(F.col("r0") != F.col("r1"), "recentred")
    return p.join(n, "station_id", "full").select("station_id", change.alias("change")).where("change is not null")


@query("d01_business_key_dedupe", "SELECT user_id, h, min(event_id) AS event_id FROM (SELECT *, epoch_us(ts) // 3600000000 AS h FROM events) GROUP BY ALL")
def d01(spark, sf):
    return ev(spark, sf).groupBy("user_id", F.floor(F.col("s") / 3600).alias("h")).agg(F.min("event_id").alias("event_id"))


@query("d02_window_duplicates", "SELECT user_id, event_type, round_even(value, 0)::BIGINT AS v, min(epoch_us(ts) // 1000000) AS first_s FROM events GROUP BY ALL")
def d02(spark, sf):
    return ev(spark, sf).groupBy("user_id", "event_type", F.bround("value", 0).cast("long").alias("v")).agg(F.min("s").alias("first_s"))


@query("d03_exact_rows", "SELECT DISTINCT user_id, event_type FROM events")
def d03(spark, sf):
    return table(spark, sf, "events").select("user_id", "event_type").distinct()


@query("d04_newest_issue", "SELECT grid, target, arg_max(event_id, (base_s, event_id)) AS event_id, count(*) FILTER (WHERE base_s = mb) > 1 AS conflict FROM (SELECT *, obs_s // 3600 AS target, max(base_s) OVER (PARTITION BY grid, obs_s // 3600) AS mb FROM weather) GROUP BY ALL")
def d04(spark, sf):
    w = weather(spark, sf).withColumn("target", F.floor(F.col("obs_s") / 3600))
    per_issue = w.groupBy("grid", "target", "base_s").agg(F.max("event_id").alias("event_id"), F.count("*").alias("n"))
    return per_issue.groupBy("grid", "target").agg(F.max(F.struct("base_s", "event_id", "n")).alias("x")).select("grid", "target", "x.event_id", (F.col("x.n") > 1).alias("conflict"))


@query("d05_row_fallback", "WITH u AS (SELECT grid, obs_s // 3600 AS h, max(event_id) AS u FROM weather WHERE temp IS NOT NULL AND event_id % 3 = 0 GROUP BY ALL), s AS (SELECT grid, obs_s // 3600 AS h, max(event_id) AS s FROM weather WHERE event_id % 3 <> 0 GROUP BY ALL) SELECT grid, h, coalesce(u, s) AS event_id, CASE WHEN u IS NOT NULL THEN 'ultra' ELSE 'short' END AS product FROM u FULL JOIN s USING (grid, h)")
def d05(spark, sf):
    w = weather(spark, sf).withColumn("h", F.floor(F.col("obs_s") / 3600))
    u, s = (F.max(F.when(c, F.col("event_id"))) for c in (F.col("temp").isNotNull() & (F.col("event_id") % 3 == 0), F.col("event_id") % 3 != 0))
    out = w.groupBy("grid", "h").agg(u.alias("u"), s.alias("s")).where("u is not null or s is not null")
    return out.select("grid", "h", F.coalesce("u", "s").alias("event_id"), F.when(F.col("u").isNotNull(), "ultra").otherwise("short").alias("product"))


def collapse_or_fail(df, keys):
    """Rows that repeat as a whole become one; fails if a key still has unequal rows. The key check is one aggregation."""
    once = df.distinct()
    odd = once.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    found = odd.limit(1).collect()
    if found:
        raise ValueError(f"unequal rows for {found[0].asDict()}")
    return once


@query("d06_equal_duplicates_collapse", "SELECT event_id, user_id, event_type, count(*)::BIGINT AS n FROM (SELECT DISTINCT event_id, user_id, event_type FROM events) GROUP BY ALL")
def d06(spark, sf):
    """Two overlapping deliveries of the events: what both have collapses; a changed row would fail the batch."""
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    twice = e.where("event_id % 3 < 2").unionByName(e.where("event_id % 3 > 0"))
    return collapse_or_fail(twice, ["event_id"]).withColumn("n", F.lit(1).cast("long"))


@query("d07_latest_per_key", "SELECT grid, arg_max(event_id, (obs_s, event_id)) AS event_id FROM weather GROUP BY ALL")
def d07(spark, sf):
    return weather(spark, sf).groupBy("grid").agg(F.max_by("event_id", F.struct("obs_s", "event_id")).alias("event_id"))


@query("d08_snapshot_selection", """WITH c AS (SELECT user_id, epoch_us(ts) // 1000000 AS s, event_id, CASE WHEN epoch_us(ts) // 3600000000 = 473688 THEN 0 WHEN event_type = 'view' AND epoch_us(ts) // 1000000 <= 1705276800 THEN 1 WHEN epoch_us(ts) // 1000000 BETWEEN 1705276800 - 86400 AND 1705276800 THEN 2 END AS rank FROM events)
SELECT user_id, arg_min(event_id, (rank, -s, event_id)) AS event_id, CASE min(rank) WHEN 0 THEN 'exact' WHEN 1 THEN 'partial' ELSE 'lookback' END AS state FROM c WHERE rank IS NOT NULL GROUP BY ALL""")
def d08(spark, sf):
    s = F.col("s")
    rank = F.when(F.floor(s / 3600) == 473688, 0).when((F.col("event_type") == "view") & (s <= 1705276800), 1).when(s.between(1705276800 - 86400, 1705276800), 2)
    best = ev(spark, sf).withColumn("rank", rank).where("rank is not null").groupBy("user_id").agg(F.min(F.struct("rank", (-s).alias("r"), "event_id")).alias("x"))
    return best.select("user_id", "x.event_id", F.when(F.col("x.rank") == 0, "exact").when(F.col("x.rank") == 1, "partial").otherwise("lookback").alias("state"))


@query("d09_priority_order", "SELECT s_suppkey, row_number() OVER (ORDER BY floor(s_acctbal / 500) DESC, s_suppkey) AS place FROM supplier")
def d09(spark, sf):
    """Deterministic order, score down and id up: range partitions and prefix sums of their sizes."""
    s = table(spark, sf, "supplier").select("s_suppkey", (-F.floor(F.col("s_acctbal") / 500)).alias("score"))
    return S.placed(s, ["score", "s_suppkey"]).select("s_suppkey", (F.col("place") + 1).alias("place"))


_ANCHORS = "anchor AS (SELECT region, arg_max(station_id, (station_id % 97, -station_id)) AS anchor FROM stations GROUP BY ALL)"

_D10 = f"""
WITH {_ANCHORS},
x AS (SELECT s.*, s.station_id % 97 AS score, round_even({hav_sql('n', 's')} / 1000, 9) AS km FROM stations s JOIN anchor a USING (region) JOIN stations n ON n.station_id = a.anchor)
SELECT station_id, region, row_number() OVER (PARTITION BY region ORDER BY round_even((score + 1) / (km + 1), 9) DESC, score DESC, km, station_id) AS place FROM x"""


def anchored(spark, sf):
    """Stations with the place of their region's most urgent station."""
    s = stations(spark, sf).withColumn("score", F.col("station_id") % 97)
    a = s.groupBy("region").agg(F.max(F.struct("score", (-F.col("station_id")).alias("i"), "lat", "lon")).alias("a"))
    return s.join(a.select("region", F.col("a.lat").alias("alat"), F.col("a.lon").alias("alon")), "region")


@query("d10_efficiency_order", _D10)
def d10(spark, sf):
    """A region's stations by (urgency + 1) / (km + 1) round its most urgent one; then urgency, distance, id."""
    km = F.bround(geo.haversine(F.col("alat"), F.col("alon"), F.col("lat"), F.col("lon")) / 1000, 9)
    x = anchored(spark, sf).withColumn("km", km)
    gain = F.bround((F.col("score") + 1) / (F.col("km") + 1), 9)
    w = W.partitionBy("region").orderBy(gain.desc(), F.desc("score"), "km", "station_id")
    return x.select("station_id", "region", F.row_number().over(w).cast("long").alias("place"))


_D11 = f"""
WITH {_ANCHORS},
x AS (
  SELECT s.*, s.station_id % 97 AS score, round_even({hav_sql('c', 's')} / 1000, 9) AS from_center, round_even({hav_sql('s', 'n')} / 1000, 9) AS to_anchor
  FROM stations s JOIN anchor a USING (region) JOIN stations n ON n.station_id = a.anchor JOIN centers c ON c.center_id = s.region % 11)
SELECT station_id, region, row_number() OVER (PARTITION BY region ORDER BY round_even(from_center + to_anchor, 9), from_center, score DESC, to_anchor, station_id) AS place FROM x"""


@query("d11_donor_order", _D11)
def d11(spark, sf):
    """Donors by the way from the centre over the donor to the anchor; then the way to the donor, urgency, the rest of the way, id."""
    c = centers(spark, sf).select("center_id", F.col("lat").alias("clat"), F.col("lon").alias("clon"))
    x = anchored(spark, sf).withColumn("center_id", F.col("region").cast("long") % 11).join(F.broadcast(c), "center_id")  # 11 centres
    here = (F.col("lat"), F.col("lon"))
    first, rest = (F.bround(d / 1000, 9) for d in (geo.haversine(F.col("clat"), F.col("clon"), *here), geo.haversine(*here, F.col("alat"), F.col("alon"))))
    x = x.withColumns({"a": first, "b": rest})
    w = W.partitionBy("region").orderBy(F.bround(F.col("a") + F.col("b"), 9), "a", F.desc("score"), "b", "station_id")
    return x.select("station_id", "region", F.row_number().over(w).cast("long").alias("place"))


def paged(routes, status=(), region=None, closed_since=None, limit: int = 25, offset: int = 0):
    """A page of routes (route_id, region, status, proposed, closed), newest proposals first: by status and region, where given; closed
    ones only if they closed at closed_since or later. The order is total, so pages don't overlap."""
    if status:
        routes = routes.where(F.col("status").isin(*status))
    if region is not None:
        routes = routes.where(F.col("region") == region)
    if closed_since is not None:
        routes = routes.where(F.col("closed").isNull() | (F.col("closed") >= closed_since))
    return routes.orderBy(F.desc("proposed"), "route_id").offset(offset).limit(limit)


@query("d12_paged_list", """SELECT o_orderkey AS route_id, o_orderstatus AS status FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
WHERE o_orderstatus IN ('O', 'F') AND n_regionkey = 2 AND (o_orderstatus = 'O' OR o_orderdate::DATE + (o_orderkey % 5)::INTEGER >= DATE '1998-01-01') ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 50""")
def d12(spark, sf):
    where = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("c_custkey").alias("o_custkey"), F.col("n_regionkey").alias("region"))
    closed = F.when(F.col("o_orderstatus") != "O", F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 5).cast("int")))
    o = table(spark, sf, "orders").join(where, "o_custkey")
    routes = o.select(F.col("o_orderkey").alias("route_id"), "region", F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("proposed"), closed.alias("closed"))
    return paged(routes, ("O", "F"), 2, F.to_date(F.lit("1998-01-01")), 25, 50).select("route_id", "status")


@query("d13_alerts", "WITH c AS (SELECT epoch_us(ts) // 86400000000 AS day FROM events GROUP BY ALL HAVING count(DISTINCT event_type) = 5), l AS (SELECT max(day) AS day FROM c) SELECT event_id, round_even(value, 0)::BIGINT AS score, CASE WHEN 19752 - day <= 0 THEN 'fresh' ELSE 'stale' END AS label FROM events JOIN l ON l.day = epoch_us(ts) // 86400000000 WHERE event_type = 'error'")
def d13(spark, sf):
    e = ev(spark, sf).withColumn("day", F.floor(F.col("s") / 86400))
    last = e.select("day", "event_type").distinct().groupBy("day").count().where("count = 5").agg(F.max("day").alias("day"))
    return e.where("event_type = 'error'").join(F.broadcast(last), "day").select("event_id", F.bround("value", 0).cast("long").alias("score"), F.when(19752 - F.col("day") <= 0, "fresh").otherwise("stale").alias("label"))


@query("d14_dimension_from_facts", "SELECT end_station_id AS id, arg_max(bike_id, (start_s, event_id)) AS last_bike FROM trips WHERE end_station_id <> 7 GROUP BY ALL")
def d14(spark, sf):
    t = trips(spark, sf).where("end_station_id <> 7")
    return t.groupBy(F.col("end_station_id").alias("id")).agg(F.max_by("bike_id", F.struct("start_s", "event_id")).alias("last_bike"))


