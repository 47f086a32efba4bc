"""Weather horizon, urgency, move quantities, remaining need, truck loads, routes, and the row shapes that are served."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import haversine
from ..functions.text import content_id
from ..sources.files import stored
from .base import centers, forecast, query, seconds, stations, stock, table, weather
from .measures import CLAMP_SQL, paths

#: The anchor of the serving run (2024-01-20 00:00) and its hour.
ANCHOR, HOUR = 1705708800, 473808
#: Hours that an issue of each product covers.
LEAD = {"ultra": 6, "short": 72}

FC_SQL = f"""fc AS (SELECT grid, event_id, base_s, base_s // 3600 + k AS h, temp + k / 10.0 AS temp, CASE WHEN event_id % 3 = 0 THEN 'ultra' ELSE 'short' END AS product FROM weather, (SELECT unnest(range(0, 73)) AS k)
  WHERE temp IS NOT NULL AND base_s <= {ANCHOR} AND k <= CASE WHEN event_id % 3 = 0 THEN 6 ELSE 72 END AND base_s // 3600 + k BETWEEN {HOUR + 1} AND {HOUR + 13}),
pick AS (SELECT * FROM fc QUALIFY row_number() OVER (PARTITION BY grid, h ORDER BY product DESC, base_s DESC, event_id DESC) = 1)"""


def forecast_hours(spark, sf):
    """Per grid and each of the 13 hours after the anchor the row to use: the newest ultra-short issue that covers the
    hour, else the newest short-term one. An issue gives at most 13 rows, and the pick is a max per (grid, hour)."""
    product = F.when(F.col("event_id") % 3 == 0, "ultra").otherwise("short")
    w = weather(spark, sf).where(f"temp is not null and base_s <= {ANCHOR}").withColumn("product", product)
    w = w.withColumn("h", F.explode(F.sequence(F.lit(HOUR + 1).cast("long"), F.lit(HOUR + 13).cast("long"))))
    k = F.col("h") - F.floor(F.col("base_s") / 3600)
    w = w.withColumn("k", k).where((F.col("k") >= 0) & (F.col("k") <= F.when(F.col("product") == "ultra", LEAD["ultra"]).otherwise(LEAD["short"])))
    best = F.max(F.struct(F.when(F.col("product") == "ultra", 1).otherwise(0).alias("p"), "base_s", "event_id", (F.col("temp") + F.col("k") / 10.0).alias("temp"), "product")).alias("x")
    return w.groupBy("grid", "h").agg(best).select("grid", "h", "x.temp", "x.product", "x.base_s")


@query("c17_weather_projection", f"WITH {FC_SQL} SELECT grid, h, round_even(temp, 6) AS temp, product FROM pick WHERE grid IN (SELECT grid FROM pick GROUP BY grid HAVING count(*) = 13)")
def c17(spark, sf):
    g = forecast_hours(spark, sf)
    whole = g.groupBy("grid").count().where("count = 13").select("grid")
    return g.join(whole, "grid", "left_semi").select("grid", "h", F.bround("temp", 6).alias("temp"), "product")


@query(
    "c31_weather_horizon",
    f"""WITH {FC_SQL}, r AS (SELECT *, h - row_number() OVER (PARTITION BY grid ORDER BY h) AS k FROM pick), g AS (SELECT grid, count(*) AS hours, ({ANCHOR} - max(base_s) FILTER (WHERE product = 'ultra')) // 60 AS ultra_age, ({ANCHOR} - max(base_s) FILTER (WHERE product = 'short')) // 60 AS short_age FROM r WHERE k = {HOUR} GROUP BY ALL)
SELECT station_id, coalesce(hours, 0)::BIGINT AS hours, coalesce(hours, 0) >= 12 AS complete, ultra_age, short_age FROM stations s LEFT JOIN g ON g.grid = s.station_id % 34""",
)
def c31(spark, sf):
    """Contiguous hours from the next one on, and the age in minutes of the newest issue used of each product."""
    r = forecast_hours(spark, sf).withColumn("k", F.col("h") - F.row_number().over(W.partitionBy("grid").orderBy("h"))).where(f"k = {HOUR}")
    age = lambda p: F.floor((ANCHOR - F.max(F.when(F.col("product") == p, F.col("base_s")))) / 60)
    g = r.groupBy("grid").agg(F.count("*").alias("hours"), age("ultra").alias("ultra_age"), age("short").alias("short_age"))
    out = stations(spark, sf).withColumn("grid", F.col("station_id") % 34).join(g, "grid", "left").withColumn("hours", F.coalesce("hours", F.lit(0).cast("long")))
    return out.select("station_id", "hours", (F.col("hours") >= 12).alias("complete"), "ultra_age", "short_age")


_SHOWS = """SELECT '{kind}' AS kind, sha256('["' || o_orderkey || '","' || o_custkey || '"]') AS id, o_orderkey, {place} AS place, {lat} AS lat, {lon} AS lon FROM orders JOIN {join} WHERE o_orderstatus = '{status}' AND o_orderdate >= TIMESTAMP '1998-06-01' AND o_orderdate < TIMESTAMP '2000-06-01'"""


@query(
    "c18_event_projection",
    _SHOWS.format(kind="culture", place="c_nationkey", lat="NULL::DOUBLE", lon="NULL::DOUBLE", join="customer ON c_custkey = o_custkey", status="P")
    + " UNION ALL "
    + _SHOWS.format(kind="performance", place="s.region", lat="s.lat", lon="s.lon", join="stations s ON s.station_id = o_custkey", status="F")
    + " AND s.lat BETWEEN 37.45 AND 37.6",
)
def c18(spark, sf):
    """Current and future events within two years: cultural ones with their own place, performances with their
    facility's coordinates, those outside the box left out. Rows that repeat collapse, unequal ones of an id fail."""
    from .sets import collapse_or_fail

    o = table(spark, sf, "orders").where("o_orderdate >= timestamp_ntz'1998-06-01' and o_orderdate < timestamp_ntz'2000-06-01'")
    own = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("place"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"))
    hall = stations(spark, sf).where("lat between 37.45 and 37.6").select(F.col("station_id").alias("o_custkey"), F.col("region").alias("place"), "lat", "lon")
    shows = [o.where(F.col("o_orderstatus") == status).join(places, "o_custkey").withColumn("kind", F.lit(kind)) for kind, status, places in (("culture", "P", own), ("performance", "F", hall))]
    rows = shows[0].unionByName(shows[1]).select("kind", content_id(F.col("o_orderkey"), F.col("o_custkey")).alias("id"), "o_orderkey", "place", "lat", "lon")
    return collapse_or_fail(rows, ["kind", "id"])


#: Fixed values of the urgency policy.
LOW_STOCK, VISIT_STOCK, RESPONSE_MIN, HALF_LIFE_MIN, SEVERITY, FIRST_MIN = 0.2, 0.4, 30, 60, 1.5, 60
_START = "station_id * 7 % 45"

URG_SQL = f"""{CLAMP_SQL.replace("station_id % 15", _START)},
pt AS (SELECT p.station_id, p.horizon, p.stock, p.total, p.flow, f.rent, ({_START.replace("station_id", "p.station_id")})::BIGINT AS cur, 20 + p.station_id % 10 AS hold, lag(p.stock, 1, ({_START.replace("station_id", "p.station_id")})::DOUBLE) OVER (PARTITION BY p.station_id ORDER BY p.horizon) AS prev FROM path p JOIN forecast f USING (station_id, horizon)),
u AS (SELECT station_id, cur, hold, greatest(0, greatest(cur, max(stock)) - hold) AS overshoot, greatest(0, -least(cur, 0, min(total))) AS deficit, coalesce(max(rent) FILTER (WHERE prev <= 0.2 * hold), 0) AS unmet,
  min(horizon) FILTER (WHERE stock <= 0.2 * hold OR stock >= hold) AS fh, arg_min(stock, horizon) FILTER (WHERE stock <= 0.2 * hold OR stock >= hold) AS fs,
  least(cur, min(total) FILTER (WHERE horizon <= 3)) AS low3, least(cur, min(total - 1.645 * sqrt(flow)) FILTER (WHERE horizon <= 4)) AS low4 FROM pt GROUP BY station_id, cur, hold),
z AS (SELECT station_id, max(tick) AS z FROM stock GROUP BY ALL),
tr AS (SELECT station_id, count(DISTINCT tick) AS seen, CASE WHEN count(DISTINCT tick) >= 2 THEN coalesce(round_even(regr_slope(bikes, (z - tick) / -60.0), 6), 0) ELSE 0 END AS slope FROM stock JOIN z USING (station_id) WHERE tick > z - 172800 GROUP BY ALL),
tt AS (SELECT u.*, coalesce(slope, 0) AS slope, coalesce(seen, 0) AS seen, CASE WHEN slope < 0 AND cur / -slope < 60 THEN cur / -slope WHEN slope > 0 AND (hold - cur) / slope < 60 THEN (hold - cur) / slope END AS tmin FROM u LEFT JOIN tr USING (station_id)),
act AS (SELECT *, CASE WHEN cur <= 0.2 * hold OR cur >= hold THEN 0 WHEN tmin IS NOT NULL THEN tmin WHEN fh IS NOT NULL THEN fh * 60.0 END AS mins,
  CASE WHEN cur <= 0.2 * hold THEN 'supply_needed' WHEN cur >= hold THEN 'retrieval_needed' WHEN tmin IS NOT NULL THEN CASE WHEN slope < 0 THEN 'supply_needed' ELSE 'retrieval_needed' END WHEN fh IS NULL THEN 'normal' WHEN fs <= 0.2 * hold THEN 'supply_needed' ELSE 'retrieval_needed' END AS action FROM tt),
sev AS (SELECT *, CASE action WHEN 'retrieval_needed' THEN overshoot WHEN 'supply_needed' THEN greatest(deficit, unmet) ELSE 0 END AS worst FROM act),
urg AS (SELECT *, CASE WHEN action = 'normal' THEN 0.0 ELSE round_even(100 * pow(2, -greatest(0, mins - 30) / 60.0) * (1 - exp(-(worst / hold) / 1.5)), 1) END AS score, coalesce(round_even(mins, 0), 720)::BIGINT AS critical_min FROM sev)"""


def urgency(spark, sf):
    """Per station: how soon its stock is critical (now, by its recent trend, or by the forecast), which action that
    asks for, how bad it gets over all horizons, and one score from both."""
    cur, hold, low = F.col("cur"), F.col("hold"), F.lit(LOW_STOCK) * F.col("hold")
    w = W.partitionBy("station_id").orderBy("horizon")
    p = paths(spark, sf, F.col("station_id") * 7 % 45).withColumns({"cur": F.col("station_id") * 7 % 45, "hold": 20 + F.col("station_id") % 10})
    p = p.withColumn("prev", F.coalesce(F.lag("stock").over(w), cur.cast("double")))
    odd = (F.col("stock") <= low) | (F.col("stock") >= hold)
    u = p.groupBy("station_id", "cur", "hold").agg(
        F.max("stock").alias("top"),
        F.min("total").alias("bottom"),
        F.coalesce(F.max(F.when(F.col("prev") <= low, F.col("rent"))), F.lit(0.0)).alias("unmet"),
        F.min(F.when(odd, F.struct("horizon", "stock"))).alias("first"),
        F.min(F.when(F.col("horizon") <= 3, F.col("total"))).alias("low3"),
        F.min(F.when(F.col("horizon") <= 4, F.col("total") - 1.645 * F.col("spread"))).alias("low4"),
    )
    s = stock(spark, sf)
    z = s.groupBy("station_id").agg(F.max("tick").alias("z"))
    trend = s.join(z, "station_id").where("tick > z - 172800").groupBy("station_id").agg(
        F.countDistinct("tick").alias("seen"), F.when(F.countDistinct("tick") >= 2, F.coalesce(F.bround(F.regr_slope("bikes", (F.col("z") - F.col("tick")) / -60.0), 6), F.lit(0.0))).otherwise(0.0).alias("slope")
    )
    x = u.join(trend, "station_id", "left").withColumns({"slope": F.coalesce("slope", F.lit(0.0)), "seen": F.coalesce("seen", F.lit(0).cast("long"))})
    reach = F.when(F.col("slope") < 0, F.try_divide(cur, -F.col("slope"))).when(F.col("slope") > 0, F.try_divide(hold - cur, F.col("slope")))
    x = x.withColumn("tmin", F.when(reach < FIRST_MIN, reach))
    supply, take = F.lit("supply_needed"), F.lit("retrieval_needed")
    action = (
        F.when(cur <= low, supply)
        .when(cur >= hold, take)
        .when(F.col("tmin").isNotNull(), F.when(F.col("slope") < 0, supply).otherwise(take))
        .when(F.col("first").isNull(), "normal")
        .when(F.col("first.stock") <= low, supply)
        .otherwise(take)
    )
    mins = F.when((cur <= low) | (cur >= hold), 0.0).otherwise(F.coalesce("tmin", F.col("first.horizon") * 60.0))
    overshoot = F.greatest(F.lit(0.0), F.greatest(cur.cast("double"), F.col("top")) - hold)
    deficit = F.greatest(F.lit(0.0), -F.least(cur.cast("double"), F.lit(0.0), F.col("bottom")))
    x = x.withColumns({"action": action, "mins": mins, "low3": F.least(cur.cast("double"), F.col("low3")), "low4": F.least(cur.cast("double"), F.col("low4"))})
    x = x.withColumn("worst", F.when(F.col("action") == take, overshoot).when(F.col("action") == supply, F.greatest(deficit, F.col("unmet"))).otherwise(0.0))
    score = 100 * F.pow(F.lit(2.0), -F.greatest(F.lit(0.0), F.col("mins") - RESPONSE_MIN) / HALF_LIFE_MIN) * (1 - F.exp(-(F.col("worst") / hold) / SEVERITY))
    return x.withColumns({"score": F.when(F.col("action") == "normal", 0.0).otherwise(F.bround(score, 1)), "critical_min": F.coalesce(F.bround("mins", 0), F.lit(720.0)).cast("long")})


@query("c24_urgency_score", f"WITH RECURSIVE {URG_SQL} SELECT station_id, critical_min, action, score, round_even(worst, 6) AS worst FROM urg")
def c24(spark, sf):
    return urgency(spark, sf).select("station_id", "critical_min", "action", "score", F.bround("worst", 6).alias("worst"))


QTY_SQL = f"""{URG_SQL}, qty AS (SELECT *, CASE action WHEN 'retrieval_needed' THEN least(cur, round_even(worst, 0)) WHEN 'supply_needed' THEN least(round_even(worst, 0), greatest(0, hold - cur)) ELSE 0 END::BIGINT AS legacy,
  CASE WHEN action = 'retrieval_needed' AND seen >= 3 THEN least(cur, greatest(0, cur - hold), greatest(0, floor(least(low4, cur + least(0, slope) * 210) - hold))) WHEN action = 'supply_needed' THEN least(greatest(0, ceil(ceil(0.2 * hold) - low3)), greatest(0, hold - cur)) ELSE 0 END::BIGINT AS band FROM urg)"""


def quantity(spark, sf):
    """Bikes to move. legacy: the worst case, clamped by what can be loaded or unloaded now. band: pickups only beyond
    what the present and the cautious future stock exceed the capacity by, from three observations on; supply up to
    the least stock over three hours."""
    hold, cur, worst = F.col("hold"), F.col("cur"), F.bround("worst", 0)
    room = F.greatest(F.lit(0), hold - cur)
    legacy = F.when(F.col("action") == "retrieval_needed", F.least(cur, worst)).when(F.col("action") == "supply_needed", F.least(worst, room)).otherwise(0)
    recent = cur + F.least(F.lit(0.0), F.col("slope")) * (3 * 60 + RESPONSE_MIN)
    pickup = F.least(cur, F.greatest(F.lit(0), cur - hold), F.greatest(F.lit(0), F.floor(F.least(F.col("low4"), recent) - hold)))
    supply = F.least(F.greatest(F.lit(0), F.ceil(F.ceil(LOW_STOCK * hold) - F.col("low3"))), room)
    band = F.when((F.col("action") == "retrieval_needed") & (F.col("seen") >= 3), pickup).when(F.col("action") == "supply_needed", supply).otherwise(0)
    return urgency(spark, sf).withColumns({"legacy": legacy.cast("long"), "band": band.cast("long")})


@query("c25_move_quantity", f"WITH RECURSIVE {QTY_SQL} SELECT station_id, action, score, legacy, band FROM qty")
def c25(spark, sf):
    return quantity(spark, sf).select("station_id", "action", "score", "legacy", "band")


#: Routes are open since the day before; completed ones count from the stock anchor on.
OPENED, STOCK_ANCHOR = 1706486400, 1706572800
NEED_SQL = f"""{QTY_SQL}, cov AS (SELECT user_id AS station_id, CASE WHEN event_id % 2 = 0 THEN 'pickup' ELSE 'dropoff' END AS move, sum(event_id % 3 + 1)::BIGINT AS covered FROM events
  WHERE (event_type = 'purchase' AND epoch_us(ts) // 1000000 > {OPENED}) OR (event_type = 'signup' AND epoch_us(ts) // 1000000 > {STOCK_ANCHOR}) GROUP BY ALL),
cool AS (SELECT DISTINCT user_id AS station_id FROM events WHERE event_type = 'error' AND epoch_us(ts) // 1000000 > {STOCK_ANCHOR}),
want AS (SELECT station_id, score, cur, hold, CASE action WHEN 'retrieval_needed' THEN 'pickup' ELSE 'dropoff' END AS move, CASE action WHEN 'retrieval_needed' THEN legacy ELSE least(legacy + greatest(0, ceil(0.4 * hold) - ceil(0.2 * hold)), greatest(0, hold - cur)) END::BIGINT AS planned FROM qty WHERE action <> 'normal' AND legacy > 0),
need AS (SELECT w.station_id, w.move, w.score, (w.planned - coalesce(c.covered, 0))::BIGINT AS need FROM want w LEFT JOIN cov c ON c.station_id = w.station_id AND c.move = w.move LEFT JOIN cool k ON k.station_id = w.station_id
  WHERE NOT (w.move = 'pickup' AND (k.station_id IS NOT NULL OR coalesce(c.covered, 0) > 0)) AND w.planned > coalesce(c.covered, 0))"""


def remaining(spark, sf):
    """What is left to move after the routes on their way: dispatched ones, and completed ones that ended after the
    stock was read. A pickup station is left out while it cools down or another route takes from it; a supply visit
    fills up to the visit target, as far as there is room."""
    e = table(spark, sf, "events").withColumn("s", seconds("ts"))
    cov = e.where(f"(event_type = 'purchase' and s > {OPENED}) or (event_type = 'signup' and s > {STOCK_ANCHOR})")
    cov = cov.groupBy(F.col("user_id").alias("station_id"), F.when(F.col("event_id") % 2 == 0, "pickup").otherwise("dropoff").alias("move")).agg(F.sum(F.col("event_id") % 3 + 1).alias("covered"))
    cool = e.where(f"event_type = 'error' and s > {STOCK_ANCHOR}").select(F.col("user_id").alias("station_id")).distinct().withColumn("cool", F.lit(True))
    hold = F.col("hold")
    buffer = F.greatest(F.lit(0), F.ceil(VISIT_STOCK * hold) - F.ceil(LOW_STOCK * hold))
    pickup = F.col("action") == "retrieval_needed"
    q = quantity(spark, sf).where("action <> 'normal' and legacy > 0")
    q = q.select("station_id", "score", F.when(pickup, "pickup").otherwise("dropoff").alias("move"), F.when(pickup, F.col("legacy")).otherwise(F.least(F.col("legacy") + buffer, F.greatest(F.lit(0), hold - F.col("cur")))).alias("planned"))
    x = q.join(cov, ["station_id", "move"], "left").join(cool, "station_id", "left").withColumn("covered", F.coalesce("covered", F.lit(0).cast("long")))
    x = x.where((F.col("move") == "dropoff") | (F.col("cool").isNull() & (F.col("covered") == 0)))
    return x.withColumn("need", (F.col("planned") - F.col("covered")).cast("long")).where("need > 0").select("station_id", "move", "score", "need")


@query("c26_remaining_need", f"WITH RECURSIVE {NEED_SQL} SELECT * FROM need")
def c26(spark, sf):
    return remaining(spark, sf)


TRUCK_SQL = f"""{NEED_SQL}, cum AS (SELECT *, station_id % 11 AS center, sum(need) OVER (PARTITION BY station_id % 11, move ORDER BY score DESC, station_id ROWS UNBOUNDED PRECEDING) AS hi FROM need),
full_ AS (SELECT center, max(hi) AS p FROM cum WHERE move = 'pickup' GROUP BY ALL), room AS (SELECT center, ((p + 19) // 20) * 20 - p AS room, (p + 19) // 20 - 1 AS last FROM full_),
load AS (SELECT station_id, center, move, score, k AS truck, (least(hi, (k + 1) * 20) - greatest(hi - need, k * 20))::BIGINT AS bikes FROM (SELECT *, unnest(range(((hi - need) // 20)::BIGINT, ((hi - 1) // 20)::BIGINT + 1)) AS k FROM cum WHERE move = 'pickup')
  UNION ALL SELECT station_id, center, move, score, last::BIGINT, (least(hi, room) - (hi - need))::BIGINT FROM cum JOIN room USING (center) WHERE move = 'dropoff' AND hi - need < room)"""
#: Bikes that a truck holds.
TRUCK = 20


def loads(spark, sf):
    """Pickups in score order, cut into trucks of 20: a station's interval of the running sum meets the trucks'
    intervals. What the last truck of a centre has left goes to the drop-offs in score order; a centre without pickups
    has nothing to give."""
    n = remaining(spark, sf).withColumn("center", F.col("station_id") % 11)
    w = W.partitionBy("center", "move").orderBy(F.desc("score"), "station_id").rowsBetween(W.unboundedPreceding, 0)
    n = stored(n.withColumn("hi", F.sum("need").over(w)), "needs")  # read for cuts, room and drop-offs
    up = n.where("move = 'pickup'")
    cut = up.withColumn("truck", F.explode(F.sequence(F.floor((F.col("hi") - F.col("need")) / TRUCK), F.floor((F.col("hi") - 1) / TRUCK))))
    cut = cut.withColumn("bikes", F.least(F.col("hi"), (F.col("truck") + 1) * TRUCK) - F.greatest(F.col("hi") - F.col("need"), F.col("truck") * TRUCK))
    trucks = F.floor((F.max("hi") + TRUCK - 1) / TRUCK)
    room = up.groupBy("center").agg((trucks * TRUCK - F.max("hi")).alias("room"), (trucks - 1).alias("truck"))
    down = n.where("move = 'dropoff'").join(room, "center").where("hi - need < room").withColumn("bikes", F.least("hi", "room") - (F.col("hi") - F.col("need")))
    cols = ("station_id", "center", "move", "score", "truck", "bikes")
    return cut.select(*cols).unionByName(down.select(*cols))


@query("c27_truck_loads", f"WITH RECURSIVE {TRUCK_SQL} SELECT station_id, center, move, truck, bikes FROM load")
def c27(spark, sf):
    return loads(spark, sf).drop("score")


#: Road to straight distance, km/h, minutes per stop and per bike, longest route in minutes.
ROAD, SPEED, STOP_MIN, BIKE_MIN, LONGEST = 1.25, 18.0, 4.0, 0.5, 120.0


def _hav(a, b, c, d):
    return f"2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))))"


@query(
    "c28_route_duration",
    f"""WITH RECURSIVE {TRUCK_SQL}, st AS (SELECT l.*, s.lat, s.lon, c.lat AS clat, c.lon AS clon FROM load l JOIN stations s USING (station_id) JOIN centers c ON c.center_id = l.center),
leg AS (SELECT *, lag(lat, 1, clat) OVER w AS plat, lag(lon, 1, clon) OVER w AS plon, lead(station_id) OVER w IS NULL AS final FROM st WINDOW w AS (PARTITION BY center, truck ORDER BY move DESC, score DESC, station_id)),
d AS (SELECT center, truck, count(*)::BIGINT AS stops, round_even((sum({_hav("plat", "plon", "lat", "lon")}) + sum(CASE WHEN final THEN {_hav("lat", "lon", "clat", "clon")} ELSE 0 END)) / 1000 * 1.25 / 18.0 * 60 + 4.0 * count(*) + 0.5 * sum(bikes), 3) AS minutes FROM leg GROUP BY ALL)
SELECT * FROM d WHERE minutes <= 120""",
)
def c28(spark, sf):
    """Minutes of a truck's round from its centre and back: road time, stops and handling. Routes beyond 120 minutes go."""
    c = centers(spark, sf).select(F.col("center_id").alias("center"), F.col("lat").alias("clat"), F.col("lon").alias("clon"))
    s = loads(spark, sf).join(stations(spark, sf).select("station_id", "lat", "lon"), "station_id").join(c, "center")
    w = W.partitionBy("center", "truck").orderBy(F.desc("move"), F.desc("score"), "station_id")
    s = s.withColumns({"plat": F.coalesce(F.lag("lat").over(w), "clat"), "plon": F.coalesce(F.lag("lon").over(w), "clon"), "final": F.lead("station_id").over(w).isNull()})
    back = F.when(F.col("final"), haversine(F.col("lat"), F.col("lon"), F.col("clat"), F.col("clon"))).otherwise(0.0)
    metres = F.sum(haversine(F.col("plat"), F.col("plon"), F.col("lat"), F.col("lon"))) + F.sum(back)
    minutes = metres / 1000 * ROAD / SPEED * 60 + STOP_MIN * F.count("*") + BIKE_MIN * F.sum("bikes")
    return s.groupBy("center", "truck").agg(F.count("*").alias("stops"), F.bround(minutes, 3).alias("minutes")).where(F.col("minutes") <= LONGEST)


_KST = 32400
SHAPES_SQL = f"""SELECT 'station' AS kind, 'ST-' || station_id AS id, 0::BIGINT AS seq, NULL::BIGINT AS utc_s, region::VARCHAR AS code, round_even(lat, 6) AS num FROM stations
UNION ALL SELECT 'stock', 'ST-' || station_id, 0, max(tick) - {_KST}, 'bikes', arg_max(bikes, (tick, event_id))::DOUBLE FROM stock GROUP BY station_id
UNION ALL SELECT 'forecast', 'ST-' || station_id, horizon, 1706659200 + horizon * 3600 - {_KST}, 'rent', round_even(rent, 0) FROM forecast
UNION ALL SELECT 'urgency', 'ST-' || station_id, critical_min, 1706659200 - {_KST}, CASE action WHEN 'supply_needed' THEN 'S' WHEN 'retrieval_needed' THEN 'R' ELSE 'N' END, score FROM urg
UNION ALL SELECT 'route', o_orderkey::VARCHAR, 0, epoch_us(o_orderdate) // 1000000 - {_KST}, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'proposed' ELSE 'dispatched' END, o_totalprice FROM orders
UNION ALL SELECT 'stop', l_orderkey::VARCHAR, l_linenumber, epoch_us(l_shipdate) // 1000000 - {_KST}, CASE l_returnflag WHEN 'R' THEN 'pickup' ELSE 'dropoff' END, l_quantity FROM lineitem"""


@query("c19_gold_row_shaping", f"WITH RECURSIVE {URG_SQL} {SHAPES_SQL}")
def c19(spark, sf):
    """The six kinds of served rows in one shape: station, stock, forecast, urgency, route and stop, local time as UTC
    (the zone has no daylight saving time)."""
    sta = F.concat(F.lit("ST-"), F.col("station_id").cast("string"))

    def shape(df, kind, id_, seq, at, code, num):
        return df.select(F.lit(kind).alias("kind"), id_.alias("id"), seq.cast("long").alias("seq"), (at - _KST).cast("long").alias("utc_s"), code.alias("code"), num.cast("double").alias("num"))

    none, zero = F.lit(None).cast("long"), F.lit(0)
    last = stock(spark, sf).groupBy("station_id").agg(F.max(F.struct("tick", "event_id", "bikes")).alias("x"))
    action = F.when(F.col("action") == "supply_needed", "S").when(F.col("action") == "retrieval_needed", "R").otherwise("N")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "proposed").otherwise("dispatched")
    shapes = [
        shape(stations(spark, sf), "station", sta, zero, none, F.col("region").cast("string"), F.bround("lat", 6)),
        shape(last, "stock", sta, zero, F.col("x.tick"), F.lit("bikes"), F.col("x.bikes")),
        shape(forecast(spark, sf), "forecast", sta, F.col("horizon"), 1706659200 + F.col("horizon") * 3600, F.lit("rent"), F.bround("rent", 0)),
        shape(urgency(spark, sf), "urgency", sta, F.col("critical_min"), F.lit(1706659200), action, F.col("score")),
        shape(table(spark, sf, "orders"), "route", F.col("o_orderkey").cast("string"), zero, seconds("o_orderdate"), status, F.col("o_totalprice")),
        shape(table(spark, sf, "lineitem"), "stop", F.col("l_orderkey").cast("string"), F.col("l_linenumber"), seconds("l_shipdate"), F.when(F.col("l_returnflag") == "R", "pickup").otherwise("dropoff"), F.col("l_quantity")),
    ]
    out = shapes[0]
    for s in shapes[1:]:
        out = out.unionByName(s)
    return out
