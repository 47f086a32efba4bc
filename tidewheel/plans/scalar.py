"""Scalar functions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import clock, geo, text
from ..sources.files import first_few
from .base import centers, query, seconds, stations, stock, table

_RAIN = "CASE event_id % 6 WHEN 0 THEN 'none' WHEN 1 THEN 'under 1mm' WHEN 2 THEN '30.0~50.0mm' WHEN 3 THEN (event_id % 40) || '.5mm' WHEN 4 THEN (event_id % 9) || 'cm' ELSE 'heavy' END"


def events(spark, sf):
    return table(spark, sf, "events").withColumn("s", seconds("ts"))


@query("p01_precipitation_number", f"SELECT event_id, CASE event_id % 6 WHEN 0 THEN 0.0 WHEN 1 THEN 0.5 WHEN 2 THEN 30.0 WHEN 3 THEN event_id % 40 + 0.5 WHEN 4 THEN event_id % 9 END::DOUBLE AS mm FROM (SELECT event_id, {_RAIN} AS t FROM events)")
def p01(spark, sf):
    return events(spark, sf).select("event_id", F.expr(_RAIN.replace("(event_id % 40) || '.5mm'", "concat(event_id % 40, '.5mm')").replace("(event_id % 9) || 'cm'", "concat(event_id % 9, 'cm')")).alias("t")).select("event_id", text.precipitation(F.col("t")).alias("mm"))


@query("p02_masked_number", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE round_even(value, 2) END AS v FROM events")
def p02(spark, sf):
    raw = F.when(F.col("event_id") % 7 == 0, " * ").otherwise(F.bround("value", 2).cast("string"))
    return events(spark, sf).select("event_id", text.masked(raw).alias("v"))


@query("p03_identity_text", "SELECT p_partkey, p_name || ' ' || p_brand AS t FROM part")
def p03(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.identity(F.concat(F.lit("  "), "p_name", F.lit("    "), "p_brand", F.lit(" "))).alias("t"))


@query("p04_content_id", """SELECT p_partkey, sha256('["' || p_name || '","' || p_brand || '","' || p_size || '"]') AS id FROM part""")
def p04(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.content_id(F.col("p_name"), F.col("p_brand"), F.col("p_size")).alias("id"))


@query("p05_station_number", r"SELECT c_custkey, CASE WHEN c_custkey % 9 <> 0 THEN lpad(c_custkey::VARCHAR, 5, '0') END AS no FROM customer")
def p05(spark, sf):
    raw = F.when(F.col("c_custkey") % 9 == 0, r"\N").otherwise(F.col("c_custkey").cast("string"))
    return table(spark, sf, "customer").select("c_custkey", text.station_number(raw).alias("no"))


@query("p06_key_to_window", "SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN strftime(ts, '%Y-%m-%dT%H:%M') END AS w FROM events")
def p06(spark, sf):
    hh = F.when(F.col("event_id") % 10 == 0, F.lit("24")).otherwise(F.date_format("ts", "HH"))
    key = F.concat(F.lit("silver/dt="), F.date_format("ts", "yyyy-MM-dd"), F.lit("/hh="), hh, F.lit("/"), F.date_format("ts", "HHmm"), F.lit(".parquet"))
    return events(spark, sf).select("event_id", text.window_of_key(key).alias("w"))


@query("p07_strict_boolean", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END AS b FROM events")
def p07(spark, sf):
    raw = F.expr("CASE event_id % 4 WHEN 0 THEN ' TRUE' WHEN 1 THEN 'n' WHEN 2 THEN '1' ELSE 'maybe' END")
    return events(spark, sf).select("event_id", text.strict_boolean(raw).alias("b"))


@query("p08_safe_number", "SELECT event_id, try_cast(CASE WHEN event_id % 5 = 0 THEN 'x' || event_id ELSE event_id::VARCHAR END AS DOUBLE) AS v FROM events")
def p08(spark, sf):
    raw = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("x"), "event_id")).otherwise(F.col("event_id").cast("string"))
    return events(spark, sf).select("event_id", text.to_number(raw).alias("v"))


@query("p09_code_label", "SELECT event_id, CASE event_id % 5 WHEN 1 THEN 'clear' WHEN 3 THEN 'cloudy' WHEN 4 THEN 'overcast' END AS sky FROM events")
def p09(spark, sf):
    return events(spark, sf).select("event_id", text.label(F.col("event_id") % 5, {1: "clear", 3: "cloudy", 4: "overcast"}).alias("sky"))


@query("p10_epoch_round_trip", "SELECT event_id, epoch_us(ts) // 1000000 AS s, date_trunc('second', ts) AS back FROM events")
def p10(spark, sf):
    return events(spark, sf).select("event_id", "s", F.expr("timestampadd(SECOND, s, TIMESTAMP_NTZ'1970-01-01 00:00:00')").alias("back"))


@query("p11_tick_floor_ceil", "WITH x AS (SELECT event_id, epoch_us(ts) // 1000000 AS s FROM events) SELECT event_id, s // 1200 * 1200 AS lo, (s + 1199) // 1200 * 1200 AS hi FROM x")
def p11(spark, sf):
    from ..operators.rolling import tick_ceil, tick_floor

    return events(spark, sf).select("event_id", tick_floor(F.col("s"), 1200).alias("lo"), tick_ceil(F.col("s"), 1200).alias("hi"))


@query("p12_calendar_parts", "SELECT event_id, (hour(ts) * 60 + minute(ts))::BIGINT AS minute_of_day, (isodow(ts) - 1)::BIGINT AS weekday, date_diff('day', DATE '2000-01-01', ts::DATE) AS day_index FROM events")
def p12(spark, sf):
    s = F.col("s")
    return events(spark, sf).select("event_id", clock.minute_of_day(s).alias("minute_of_day"), clock.weekday(s).alias("weekday"), clock.day_index(s).alias("day_index"))


_HOLIDAYS = ("2024-01-01", "2024-01-15")


@query("p13_holiday_or_weekend", "SELECT event_id, isodow(ts) >= 6 OR ts::DATE IN (DATE '2024-01-01', DATE '2024-01-15') AS off FROM events")
def p13(spark, sf):
    holidays = spark.createDataFrame([(d,) for d in _HOLIDAYS], "d string").select(F.to_date("d").alias("d"), F.lit(True).alias("h"))
    e = events(spark, sf).withColumn("d", F.to_date("ts"))
    return e.join(F.broadcast(holidays), "d", "left").select("event_id", (F.coalesce("h", F.lit(False)) | (clock.weekday(F.col("s")) >= 5)).alias("off"))


@query("p14_candidate_dates", """WITH d AS (SELECT DISTINCT ts::DATE AS d FROM events), p AS (SELECT d, isodow(d) = 7 OR d IN (DATE '2024-01-01', DATE '2024-01-15') AS special FROM d)
SELECT t.d AS target, c.d AS candidate, row_number() OVER (PARTITION BY t.d ORDER BY c.d DESC) AS week FROM p t JOIN p c ON c.d < t.d AND c.special = t.special AND (t.special OR isodow(c.d) = isodow(t.d)) QUALIFY week <= 4""")
def p14(spark, sf):
    h = [F.to_date(F.lit(x)) for x in _HOLIDAYS]
    d = table(spark, sf, "events").select(F.to_date("ts").alias("d")).distinct()
    d = d.withColumns({"wd": F.weekday("d"), "special": (F.weekday("d") == 6) | F.col("d").isin(*h)})
    d = d.select("d", F.when(F.col("special"), -1).otherwise(F.col("wd")).alias("pattern"))
    pairs = d.join(d.select(F.col("d").alias("candidate"), "pattern"), "pattern").where("candidate < d")
    w = W.partitionBy("d").orderBy(F.desc("candidate"))
    return pairs.withColumn("week", F.row_number().over(w).cast("long")).where("week <= 4").select(F.col("d").alias("target"), "candidate", "week")


@query("p15_publication_slot", """WITH x AS (SELECT event_id, epoch_us(ts) // 1000000 AS s, ts FROM events)
SELECT event_id, epoch_us(date_trunc('hour', CASE WHEN minute(ts) >= 40 THEN ts ELSE ts - INTERVAL 1 HOUR END)) // 1000000 AS hourly,
  epoch_us(date_trunc('hour', CASE WHEN minute(ts) >= 30 THEN ts ELSE ts - INTERVAL 1 HOUR END)) // 1000000 + 1800 AS half_hourly,
  (s - 7800) // 10800 * 10800 + 7200 AS three_hourly, s // 600 * 600 AS ten_minutely, s // 1800 * 1800 AS thirty_minutely FROM x""")
def p15(spark, sf):
    return events(spark, sf).select("event_id", *[clock.publication_slot(F.col("s"), k).alias(k) for k in clock.SLOTS])


@query("p16_training_window", "SELECT DISTINCT o_orderdate::DATE AS d, (o_orderdate::DATE - INTERVAL 3 MONTH)::DATE AS since, (o_orderdate::DATE - INTERVAL 7 DAY)::DATE AS until FROM orders")
def p16(spark, sf):
    return table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d")).distinct().select("d", F.add_months("d", -3).alias("since"), F.date_sub("d", 7).alias("until"))


@query("p17_purged_split", """WITH d AS (SELECT DISTINCT o_orderdate::DATE AS d FROM orders), r AS (SELECT d, CASE WHEN day(d) BETWEEN 20 AND 22 THEN 'valid' WHEN day(d) BETWEEN 26 AND 28 THEN 'test' ELSE 'train' END AS part FROM d),
n AS (SELECT d, unnest([d - 1, d + 1]) AS x FROM d), e AS (SELECT DISTINCT d FROM n WHERE day(x) BETWEEN 20 AND 22 OR day(x) BETWEEN 26 AND 28)
SELECT r.d, CASE WHEN part = 'train' AND e.d IS NOT NULL THEN 'embargo' ELSE part END AS part FROM r LEFT JOIN e ON e.d = r.d""")
def p17(spark, sf):
    d = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    day = F.dayofmonth("d")
    part = F.when(day.between(20, 22), "valid").when(day.between(26, 28), "test").otherwise("train")
    near = F.lit(False)
    for k in (-1, 1):  # one day of embargo on either side of a held-out day
        other = F.dayofmonth(F.date_add("d", k))
        near = near | other.between(20, 22) | other.between(26, 28)
    return d.select("d", F.when((part == "train") & near, "embargo").otherwise(part).alias("part"))


@query("p18_last_complete_months", "SELECT DISTINCT o_orderdate::DATE AS d, (date_trunc('month', o_orderdate::DATE - INTERVAL 7 DAY) - INTERVAL 3 MONTH)::DATE AS first_day, (date_trunc('month', o_orderdate::DATE - INTERVAL 7 DAY) - INTERVAL 1 DAY)::DATE AS last_day FROM orders")
def p18(spark, sf):
    d = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    month = F.to_date(F.trunc(F.date_sub("d", 7), "month"))
    return d.select("d", F.add_months(month, -3).alias("first_day"), F.last_day(F.add_months(month, -1)).alias("last_day"))


@query("p19_freshness_state", """WITH x AS (SELECT event_id, CASE WHEN event_id % 17 <> 0 THEN 1706000000 - epoch_us(ts) // 1000000 END AS age FROM events)
SELECT event_id, CASE WHEN age IS NULL THEN 'missing' WHEN age < -300 THEN 'misaligned' WHEN age <= 86400 THEN 'ready' WHEN age <= 864000 THEN 'stale' ELSE 'expired' END AS state, age // 60 AS age_min FROM x WHERE age >= 0 OR age IS NULL""")
def p19(spark, sf):
    e = events(spark, sf).withColumn("age", F.when(F.col("event_id") % 17 != 0, 1706000000 - F.col("s")))
    return e.where("age >= 0 or age is null").select("event_id", clock.freshness(F.col("age"), 86400, 864000).alias("state"), F.floor(F.col("age") / 60).alias("age_min"))


_HAV = "2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))))"


def hav_sql(a, b):
    return _HAV.format(a=a, b=b)


@query("p20_haversine", f"SELECT s.station_id, c.center_id, round_even({hav_sql('s', 'c')}, 3) AS m FROM stations s JOIN centers c ON c.center_id = s.station_id % 11")
def p20(spark, sf):
    c = centers(spark, sf).select("center_id", F.col("lat").alias("clat"), F.col("lon").alias("clon"))
    s = stations(spark, sf).withColumn("center_id", F.col("station_id") % 11).join(F.broadcast(c), "center_id")
    return s.select("station_id", "center_id", F.bround(geo.haversine(F.col("lat"), F.col("lon"), F.col("clat"), F.col("clon")), 3).alias("m"))


_K = geo.lambert_constants()


_LAMBERT_SQL = f"""
WITH x AS (
  SELECT station_id, {_K['re'] * _K['sf']!r} / pow(tan(pi() / 4 + radians(lat) / 2), {_K['sn']!r}) AS ra, (radians(lon) - {_K['olon']!r}) * {_K['sn']!r} AS th
  FROM stations),
cells AS (SELECT station_id, floor(ra * sin(th) + 43.5)::BIGINT AS nx, floor({_K['ro']!r} - ra * cos(th) + 136.5)::BIGINT AS ny FROM x),
back AS (SELECT *, nx - 43.0 AS dx, {_K['ro']!r} + 136 - ny AS dy FROM cells)
SELECT station_id, nx, ny,
  round_even(degrees(2 * atan(pow({_K['re'] * _K['sf']!r} / sqrt(dx * dx + dy * dy), 1 / {_K['sn']!r})) - pi() / 2), 8) AS cell_lat,
  round_even(degrees(atan2(dx, dy) / {_K['sn']!r} + {_K['olon']!r}), 8) AS cell_lon
FROM back"""


@query("p21_lambert_grid", _LAMBERT_SQL)
def p21(spark, sf):
    """The 5 km cell of each station, and the place of that cell's centre: both directions of the projection."""
    nx, ny = geo.lambert_cell(F.col("lat"), F.col("lon"))
    cells = stations(spark, sf).select("station_id", nx.alias("nx"), ny.alias("ny"))
    lat, lon = geo.lambert_point(F.col("nx"), F.col("ny"))
    return cells.select("*", F.bround(lat, 8).alias("cell_lat"), F.bround(lon, 8).alias("cell_lon"))


@query("p22_cell_corner", "SELECT station_id, floor(lat / 0.01)::BIGINT || ':' || floor(lon / 0.01)::BIGINT AS cell, floor(lat / 0.01)::BIGINT AS r, floor(lon / 0.01)::BIGINT AS c FROM stations")
def p22(spark, sf):
    r, c = geo.cell_of(F.col("lat"), F.col("lon"))
    s = stations(spark, sf).withColumn("cell", F.concat_ws(":", r, c))
    return s.select("station_id", "cell", F.split_part("cell", F.lit(":"), F.lit(1)).cast("long").alias("r"), F.split_part("cell", F.lit(":"), F.lit(2)).cast("long").alias("c"))


@query("p23_wind_components", "SELECT event_id, round_even(-value * sin(radians(event_id % 360)), 4) + 0.0 AS u, round_even(-value * cos(radians(event_id % 360)), 4) + 0.0 AS v FROM events")
def p23(spark, sf):
    u, v = geo.wind_components(F.col("value"), F.col("event_id") % 360)
    return events(spark, sf).select("event_id", (F.bround(u, 4) + 0.0).alias("u"), (F.bround(v, 4) + 0.0).alias("v"))


@query("p24_severity_and_time_factor", "SELECT event_id, round_even(1 - exp(-bikes / 1.5), 6) AS severity, round_even(pow(2, -(event_id % 240) / 60.0), 6) AS time_factor, round_even(100 * (1 - exp(-bikes / 1.5)) * pow(2, -(event_id % 240) / 60.0), 1) AS score FROM stock")
def p24(spark, sf):
    sev = 1 - F.exp(-F.col("bikes") / 1.5)
    tf = F.pow(F.lit(2.0), -(F.col("event_id") % 240) / 60.0)
    return stock(spark, sf).select("event_id", F.bround(sev, 6).alias("severity"), F.bround(tf, 6).alias("time_factor"), F.bround(100 * sev * tf, 1).alias("score"))


@query("p25_ties_to_even", "SELECT event_id, round_even(event_id / 2, 0)::BIGINT AS r FROM events")
def p25(spark, sf):
    return events(spark, sf).select("event_id", F.bround(F.col("event_id") / 2, 0).cast("long").alias("r"))


@query("p27_hash_shard")
def p27(spark, sf):
    return events(spark, sf).groupBy(F.pmod(F.crc32(F.encode(F.col("user_id").cast("string"), "UTF-8")), F.lit(16)).alias("shard")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("p33_occupancy", "SELECT event_id, round_even(bikes / nullif(capacity, 0), 6) AS rate FROM stock")
def p33(spark, sf):
    return stock(spark, sf).select("event_id", F.bround(F.try_divide("bikes", "capacity"), 6).alias("rate"))


@query("p29_sort_truncate_slots", "SELECT user_id, list_slice(list_sort(list(event_id)), 1, 12) AS slots, len(list_slice(list_sort(list(event_id)), 1, 12)) AS n FROM events GROUP BY user_id")
def p29(spark, sf):
    return first_few(events(spark, sf), "user_id", "event_id", 12, "slots").withColumn("n", F.size("slots").cast("long"))


@query("p30_slots_to_rows", "WITH s AS (SELECT event_id, epoch_us(ts) // 1000000 AS s, value FROM events) SELECT event_id, s + k * 3600 AS target, round_even(value * k, 3) AS lo, round_even(value * k + 1, 3) AS hi FROM s, (SELECT unnest(range(0, 14)) AS k) WHERE k > 0 AND k <= 12")
def p30(spark, sf):
    e = events(spark, sf)
    slots = F.transform(F.sequence(F.lit(0), F.lit(13)), lambda k: F.struct((F.col("s") + k * 3600).alias("target"), F.bround(F.col("value") * k, 3).alias("lo"), F.bround(F.col("value") * k + 1, 3).alias("hi")))
    return e.select("event_id", "s", F.inline(slots)).where("target > s and target <= s + 43200").drop("s")


@query("p31_json_of_stops", """
SELECT user_id, day, '[' || string_agg('{"visit":' || rn || ',"id":' || event_id || '}', ',' ORDER BY rn) || ']' AS stops
FROM (SELECT user_id, epoch_us(ts) // 86400000000 AS day, event_id, row_number() OVER (PARTITION BY user_id, epoch_us(ts) // 86400000000 ORDER BY event_id) AS rn FROM events) GROUP BY ALL""")
def p31(spark, sf):
    """The stops of a user's route of a day, nested in order."""
    a = events(spark, sf).groupBy("user_id", F.floor(F.col("s") / 86400).alias("day")).agg(F.array_sort(F.collect_list("event_id")).alias("a"))
    return a.select("user_id", "day", F.to_json(F.transform("a", lambda x, i: F.struct((i + 1).alias("visit"), x.alias("id")))).alias("stops"))


@query("p32_nearest_neighbour_order")
def p32(spark, sf):
    """Stops of each route, 20 stations in a row, in nearest-neighbour order: a fold over a bounded array (20 stops)."""
    s = stations(spark, sf).withColumn("route", F.floor(F.col("station_id") / 20))
    lists = s.groupBy("route").agg(F.array_sort(F.collect_list(F.struct("station_id", "lat", "lon"))).alias("a"))
    unit = "struct<station_id: bigint, lat: double, lon: double>"
    start = F.struct(F.slice("a", 1, 1).cast(f"array<{unit}>").alias("done"), F.slice("a", F.lit(2), F.size("a")).cast(f"array<{unit}>").alias("left"))

    def step(acc, _):
        here = F.element_at(acc["done"], -1)
        near = F.array_min(F.transform(acc["left"], lambda x: F.struct((F.pow(x["lat"] - here["lat"], 2) + F.pow(x["lon"] - here["lon"], 2)).alias("d"), x["station_id"].alias("i"), x.alias("x"))))
        return F.transform(F.array(near), lambda m: F.struct(F.concat(acc["done"], F.array(m["x"].cast(unit))).alias("done"), F.filter(acc["left"], lambda x: x["station_id"] != m["i"]).alias("left")))[0]

    order = F.aggregate(F.when(F.size("a") > 1, F.sequence(F.lit(2), F.size("a"))).otherwise(F.array().cast("array<int>")), start, step)["done"]
    return lists.select("route", F.posexplode(order).alias("visit", "stop")).select("route", "visit", "stop.station_id")


@query("p28_nearest_with_cap", f"WITH d AS (SELECT s.station_id, c.center_id, {hav_sql('s', 'c')} AS m, row_number() OVER (PARTITION BY s.station_id ORDER BY {hav_sql('s', 'c')}, c.center_id) AS rn FROM stations s, centers c) SELECT station_id, CASE WHEN m <= 5000 THEN center_id END AS center_id FROM d WHERE rn = 1")
def p28(spark, sf):
    from .space import nearest

    return nearest(stations(spark, sf), centers(spark, sf)).select("station_id", F.when(F.col("m") <= 5000, F.col("center_id")).alias("center_id"))
