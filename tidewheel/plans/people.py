"""Population: the nowcast from earlier weeks, and the blend of grid cells with areas of interest."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import population, query, seconds, table

#: Weights of the same weekday 1..4 weeks back.
WEEKS = {1: 0.4, 2: 0.3, 3: 0.2, 4: 0.1}


def nowcast(actual, first, last, keys, value, day="day"):
    """Estimate per key and target day in [first, last) from the same weekday before it.

    Weeks 1-4 weighted and renormalised over those present; else the nearest of weeks 5-8; else the mean of the key's
    days before the target; else 0. An observation goes to the eight targets it can serve, so there is no join per
    week; the mean is one running sum per key over its days and targets."""
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in WEEKS.items() for x in kv]), F.col("week"))
    served = actual.withColumn("week", F.explode(F.sequence(F.lit(1), F.lit(8)))).withColumn("target", F.col(day) + 7 * F.col("week")).where((F.col("target") >= first) & (F.col("target") < last))
    found = served.groupBy(*keys, "target").agg(
        F.sum(weight * F.col(value)).alias("_ws"),
        F.sum(F.when(F.col("week") <= 4, weight)).alias("_w"),
        F.count_if(F.col("week") <= 4).alias("_n"),
        F.min(F.when(F.col("week") > 4, F.struct("week", F.col(value).alias("v")))).alias("_ext"),
    )
    asked = actual.select(*keys).distinct().withColumn(day, F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last - 1).cast("long"))))
    series = actual.select(*keys, day, F.col(value).alias("_v"), F.lit(1).alias("_seen")).unionByName(asked.select(*keys, day, F.lit(None).cast("double").alias("_v"), F.lit(0).alias("_seen")))
    before = W.partitionBy(*keys).orderBy(day, "_seen").rowsBetween(W.unboundedPreceding, 0)  # a target comes before its own day
    means = series.withColumn("_mean", F.sum("_v").over(before) / F.count("_v").over(before)).where("_seen = 0").select(*keys, F.col(day).alias("target"), "_mean")
    every = means.join(found, [*keys, "target"], "left")
    method = (
        F.when(F.col("_n") == 4, "weighted_avg")
        .when(F.col("_n") == 1, "single_week_fallback")
        .when(F.col("_n") > 0, "reweighted_avg")
        .when(F.col("_ext").isNotNull(), "extended_lookback_fallback")
        .when(F.col("_mean").isNotNull(), "grid_historical_avg")
        .otherwise("no_data")
    )
    est = F.when(F.col("_n") > 0, F.col("_ws") / F.col("_w")).otherwise(F.coalesce(F.col("_ext.v"), F.col("_mean"), F.lit(0.0)))
    return every.select(*keys, "target", est.alias("estimate"), method.alias("method"))


ACT_SQL = "act AS (SELECT cell, hour, day, max(spop) AS v FROM population GROUP BY ALL)"


def now_sql(targets, source="act"):
    """est: the nowcast of relation `source` (cell, hour, day, v) for the days that the SQL `targets` lists as target."""
    return f"""tg AS ({targets}), wk(week, w) AS (VALUES (1, 0.4::DOUBLE), (2, 0.3), (3, 0.2), (4, 0.1), (5, 0), (6, 0), (7, 0), (8, 0)),
f AS (SELECT cell, hour, target, sum(w * v) FILTER (WHERE week <= 4) AS ws, sum(w) FILTER (WHERE week <= 4) AS sw, count(*) FILTER (WHERE week <= 4) AS n, arg_min(v, week) FILTER (WHERE week > 4) AS ext FROM tg, wk JOIN {source} ON day = target - 7 * week GROUP BY ALL),
ks AS (SELECT DISTINCT cell, hour FROM {source}),
m AS (SELECT ks.cell, ks.hour, tg.target, avg(a.v) AS mean FROM ks CROSS JOIN tg LEFT JOIN {source} a ON a.cell = ks.cell AND a.hour = ks.hour AND a.day < tg.target GROUP BY ALL),
est AS (SELECT m.cell, m.hour, m.target, round_even(CASE WHEN n > 0 THEN ws / sw ELSE coalesce(ext, mean, 0) END, 6) AS estimate,
  CASE WHEN n = 4 THEN 'weighted_avg' WHEN n = 1 THEN 'single_week_fallback' WHEN n > 0 THEN 'reweighted_avg' WHEN ext IS NOT NULL THEN 'extended_lookback_fallback' WHEN mean IS NOT NULL THEN 'grid_historical_avg' ELSE 'no_data' END AS method
  FROM m LEFT JOIN f ON f.cell = m.cell AND f.hour = m.hour AND f.target = m.target)"""


def hourly_actual(spark, sf):
    return population(spark, sf).groupBy("cell", "hour", "day").agg(F.max("spop").alias("v"))


def _rounded(df):
    return df.withColumn("estimate", F.bround("estimate", 6))


@query("c08_population_nowcast", f"WITH {ACT_SQL}, {now_sql('SELECT unnest(range(19748, 19765)) AS target')} SELECT * FROM est")
def c08(spark, sf):
    return _rounded(nowcast(hourly_actual(spark, sf), 19748, 19765, ["cell", "hour"], "v"))


_ARCHIVE = "have AS (SELECT day FROM act GROUP BY day HAVING count(DISTINCT hour) = 24), archive AS (SELECT * FROM act WHERE day IN (SELECT day FROM have))"


@query(
    "c09_nowcast_day_loop",
    f"""WITH {ACT_SQL}, {_ARCHIVE}, {now_sql("SELECT unnest(range(t - 3, t + 4)) AS target FROM (SELECT max(day) AS t FROM act)", "archive")}
SELECT * FROM est WHERE target NOT IN (SELECT day FROM have) UNION ALL SELECT cell, hour, day, round_even(v, 6), 'actual' FROM archive WHERE day IN (SELECT target FROM tg)""",
)
def c09(spark, sf):
    """Days D-3..D+3 round the newest day: a day whose 24 hours are all there is an actual and is not estimated;
    only such days are sources."""
    actual = hourly_actual(spark, sf)
    today = actual.agg(F.coalesce(F.max("day"), F.lit(0))).first()[0]
    have = actual.groupBy("day").agg(F.countDistinct("hour").alias("n")).where("n = 24").select("day")  # a row per day
    archive = actual.join(have, "day", "left_semi")
    missing = _rounded(nowcast(archive, today - 3, today + 4, ["cell", "hour"], "v")).join(have.withColumnRenamed("day", "target"), "target", "left_anti")
    real = archive.where(F.col("day").between(today - 3, today + 3)).select("cell", "hour", F.col("day").alias("target"), F.bround("v", 6).alias("estimate"), F.lit("actual").alias("method"))
    return missing.unionByName(real)


@query(
    "c10_point_in_time_nowcast",
    f"""WITH {ACT_SQL}, {now_sql("SELECT unnest(range(19740, 19745)) AS target")} SELECT *, count(*) FILTER (WHERE method <> 'no_data') OVER (PARTITION BY target) = (SELECT count(DISTINCT cell) * 24 FROM act) AS complete FROM est""",
)
def c10(spark, sf):
    """Past dates as they would have been estimated then: every source day is before its target. A target is complete
    if each cell has an estimate from data for each of the 24 hours."""
    actual = hourly_actual(spark, sf)
    est = _rounded(nowcast(actual, 19740, 19745, ["cell", "hour"], "v"))
    wanted = actual.agg(F.countDistinct("cell") * 24).first()[0]
    per = est.groupBy("target").agg((F.count_if(F.col("method") != "no_data") == wanted).alias("complete"))  # a row per target
    return est.join(per, "target")


#: Side of a grid cell in metres; 5 x 5 cells.
SIDE, ACROSS = 250, 5
POI_SQL = """poi AS (SELECT user_id AS poi, user_id * 37 % 1250 AS x, user_id * 91 % 1250 AS y, 50 + user_id % 200 AS half, min(value) AS lo, max(value) AS hi, user_id % 101 AS male FROM events GROUP BY user_id),
ov0 AS (SELECT poi, cell, male, lo, hi, 4.0 * half * half AS area, (least(x + half, cell % 5 * 250 + 250) - greatest(x - half, cell % 5 * 250)) AS ox, (least(y + half, cell // 5 * 250 + 250) - greatest(y - half, cell // 5 * 250)) AS oy FROM poi, (SELECT unnest(range(0, 25)) AS cell)),
ov AS (SELECT *, ox * oy / 62500.0 AS w, row_number() OVER (PARTITION BY cell ORDER BY area DESC, poi) AS rn FROM ov0 WHERE ox > 0 AND oy > 0)"""


def overlaps(spark, sf):
    """Areas of interest (squares read from the events) and the grid cells they overlap: cell, poi, area, w (share of
    the cell), male (rate in percent), lo, hi. An area meets the few cells between its own edges, not all of them."""
    k = F.col("poi")
    poi = table(spark, sf, "events").groupBy(F.col("user_id").alias("poi")).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    poi = poi.select("poi", "lo", "hi", (k * 37 % 1250).alias("x"), (k * 91 % 1250).alias("y"), (50 + k % 200).alias("half"), (k % 101).alias("male"))
    first, last = (lambda c: F.greatest(F.lit(0).cast("long"), F.floor((F.col(c) - F.col("half")) / SIDE))), (lambda c: F.least(F.lit(ACROSS - 1).cast("long"), F.floor((F.col(c) + F.col("half")) / SIDE)))
    poi = poi.withColumn("cx", F.explode(F.sequence(first("x"), last("x")))).withColumn("cy", F.explode(F.sequence(first("y"), last("y"))))
    inside = lambda c, k: F.least(F.col(c) + F.col("half"), (F.col(k) + 1) * SIDE) - F.greatest(F.col(c) - F.col("half"), F.col(k) * SIDE)
    poi = poi.withColumns({"ox": inside("x", "cx"), "oy": inside("y", "cy")}).where("ox > 0 and oy > 0")
    return poi.select((F.col("cy") * ACROSS + F.col("cx")).alias("cell"), "poi", (4.0 * F.col("half") * F.col("half")).alias("area"), (F.col("ox") * F.col("oy") / float(SIDE * SIDE)).alias("w"), "male", "lo", "hi")


def blended(base, over, keys):
    """base (keys, s0), over (keys, poi, area, w, male, pop) -> keys, s0, s, male.

    Each area, the large ones first, replaces its share w of the cell's density by its own: s <- (1 - w) s + w d A.
    male is the rate of the last area, null where no area overlaps."""
    x = F.struct((-F.col("area")).alias("o"), "poi", "w", (F.col("pop") / F.col("area") * float(SIDE * SIDE)).alias("d"), "male")
    lists = over.groupBy(*keys).agg(F.array_sort(F.collect_list(x)).alias("a"))  # the areas over one cell
    both = base.join(lists, keys, "left")
    s = F.aggregate(F.coalesce("a", F.array().cast("array<struct<o: double, poi: bigint, w: double, d: double, male: bigint>>")), F.col("s0"), lambda s, v: (1 - v["w"]) * s + v["w"] * v["d"])
    return both.select(*keys, "s0", s.alias("s"), F.element_at("a", -1)["male"].alias("male"))


def _blend_sql(base, keys, pop):
    """b: the sequential blend in SQL; base has keys and s0, pop is an expression over ov."""
    k = ", ".join(keys)
    on = " AND ".join(f"o.{c} = b.{c}" for c in keys if c == "cell")
    return f"""{base}, b AS (SELECT {k}, 0::BIGINT AS rn, s0 AS s, NULL::BIGINT AS male FROM base
UNION ALL SELECT {", ".join("b." + c for c in keys)}, o.rn, (1 - o.w) * b.s + o.w * ({pop} / o.area * 62500.0), o.male FROM b JOIN ov o ON {on} AND o.rn = b.rn + 1),
bl AS (SELECT {k}, arg_max(s, rn) AS s, arg_max(male, rn) AS male, max(rn) AS n FROM b GROUP BY ALL)"""


_BASE = "base AS (SELECT cell, max(spop) AS s0 FROM population GROUP BY ALL)"


@query("c11_grid_poi_blend", f"WITH RECURSIVE {POI_SQL}, {_blend_sql(_BASE, ['cell'], '((o.lo + o.hi) / 2)')} SELECT cell, round_even(s, 6) AS s, n AS areas FROM bl")
def c11(spark, sf):
    over = overlaps(spark, sf).withColumn("pop", (F.col("lo") + F.col("hi")) / 2)
    base = population(spark, sf).groupBy("cell").agg(F.max("spop").alias("s0"))
    n = over.groupBy("cell").agg(F.count("*").alias("areas"))
    out = blended(base, over, ["cell"]).join(n, "cell", "left")
    return out.select("cell", F.bround("s", 6).alias("s"), F.coalesce("areas", F.lit(0).cast("long")).alias("areas"))


_AGES = """ages AS (SELECT c.cell, c.age, coalesce(e.v, 0)::DOUBLE AS v FROM (SELECT cell, unnest(range(0, 28)) AS age FROM (SELECT DISTINCT user_id % 25 AS cell FROM events)) c
LEFT JOIN (SELECT user_id % 25 AS cell, event_id % 28 AS age, sum(value::DECIMAL(18,2))::DOUBLE AS v FROM events WHERE NOT (user_id % 25 % 7 = 3 AND event_id % 28 < 14) GROUP BY ALL) e USING (cell, age)),
tot AS (SELECT cell, sum(v::DECIMAL(18,2))::DOUBLE AS s0, coalesce(sum(v::DECIMAL(18,2)) FILTER (WHERE age < 14), 0)::DOUBLE AS m, coalesce(sum(v::DECIMAL(18,2)) FILTER (WHERE age >= 14), 0)::DOUBLE AS f FROM ages GROUP BY ALL)"""
_AGE_BASE = f"{_AGES}, base AS (SELECT cell, s0 FROM tot)"


@query(
    "c12_age_sex_redistribution",
    f"""WITH RECURSIVE {POI_SQL}, {_blend_sql(_AGE_BASE, ['cell'], '((o.lo + o.hi) / 2)')}
SELECT a.cell, a.age, round_even(CASE WHEN bl.male IS NULL THEN v WHEN age < 14 THEN bl.s * bl.male / 100.0 * CASE WHEN m > 0 THEN v / m ELSE 1 / 14.0 END ELSE bl.s * (100 - bl.male) / 100.0 * CASE WHEN f > 0 THEN v / f ELSE 1 / 14.0 END END, 4) AS now,
  round_even(CASE WHEN bl.male IS NULL THEN v WHEN m + f > 0 THEN v * (bl.s / (m + f)) ELSE bl.s / 28.0 END, 4) AS later FROM ages a JOIN tot USING (cell) JOIN bl USING (cell)""",
)
def c12(spark, sf):
    """28 age columns per cell (0-13 men, 14-27 women) after the blend. now: the areas' sex ratio, ages in their old
    proportion, even where a sex had none; later: all ages scaled to the new total. Cells without an area stay."""
    e = table(spark, sf, "events").select((F.col("user_id") % 25).alias("cell"), (F.col("event_id") % 28).alias("age"), F.col("value").cast("decimal(18,2)").alias("v"))
    some = e.where("not (cell % 7 = 3 and age < 14)").groupBy("cell", "age").agg(F.sum("v").alias("v"))
    cells = e.select("cell").distinct().withColumn("age", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(27).cast("long"))))
    ages = cells.join(some, ["cell", "age"], "left").withColumn("v", F.coalesce("v", F.lit(0)))
    tot = ages.groupBy("cell").agg(F.sum("v").cast("double").alias("s0"), F.sum(F.when(F.col("age") < 14, F.col("v")).otherwise(0)).cast("double").alias("m"), F.sum(F.when(F.col("age") >= 14, F.col("v")).otherwise(0)).cast("double").alias("f"))
    new = blended(tot.select("cell", "s0"), overlaps(spark, sf).withColumn("pop", (F.col("lo") + F.col("hi")) / 2), ["cell"])
    x = ages.withColumn("v", F.col("v").cast("double")).join(tot.drop("s0"), "cell").join(new, "cell")
    part = lambda total: F.when(F.col(total) > 0, F.try_divide("v", total)).otherwise(1 / 14.0)
    now = F.when(F.col("male").isNull(), F.col("v")).when(F.col("age") < 14, F.col("s") * F.col("male") / 100.0 * part("m")).otherwise(F.col("s") * (100 - F.col("male")) / 100.0 * part("f"))
    later = F.when(F.col("male").isNull(), F.col("v")).when(F.col("m") + F.col("f") > 0, F.col("v") * F.try_divide("s", F.col("m") + F.col("f"))).otherwise(F.col("s") / 28.0)
    return x.select("cell", "age", F.bround(now, 4).alias("now"), F.bround(later, 4).alias("later"))


_SLOT_BASE = "base AS (SELECT p.cell, h.h, max(p.spop) AS s0 FROM population p JOIN (SELECT unnest(range(0, 13)) AS h) h ON p.hour = (6 + h.h) % 24 GROUP BY ALL)"


@query("c13_forecast_hour_blend", f"WITH RECURSIVE {POI_SQL}, {_blend_sql(_SLOT_BASE, ['cell', 'h'], '((o.lo * (1 + b.h / 24.0) + o.hi * (1 + b.h / 24.0)) / 2)')} SELECT cell, h AS target, round_even(s, 6) AS s FROM bl")
def c13(spark, sf):
    """The current hour and 12 forecast hours: each area's slots (lo, hi per hour) become rows, are blended per target
    into the baseline of the target's own hour of the day, in one pass for all targets."""
    slots = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(12).cast("long")), lambda h: F.struct(h.alias("h"), ((F.col("lo") * (1 + h / 24.0) + F.col("hi") * (1 + h / 24.0)) / 2).alias("pop")))
    over = overlaps(spark, sf).select("cell", "poi", "area", "w", "male", F.inline(slots))
    base = population(spark, sf).withColumn("h", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(12).cast("long")))).where("hour = (6 + h) % 24").groupBy("cell", "h").agg(F.max("spop").alias("s0"))
    return blended(base, over, ["cell", "h"]).select("cell", F.col("h").alias("target"), F.bround("s", 6).alias("s"))
