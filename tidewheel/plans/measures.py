"""Aggregations, windows over panels, and forecast quality."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import replay as RP
from ..sources import files as S
from .base import forecast, population, query, seconds, stock, table, trips, weather


def ev(spark, sf):
    return table(spark, sf, "events").withColumn("s", seconds("ts"))


def money(c):
    """Exact sum of values with two decimals: no order of addition matters."""
    return F.sum(c.cast("decimal(18,2)")).cast("double")


@query("a02_grid_mean", "SELECT grid, obs_s // 3600 AS h, round_even(avg(temp::DECIMAL(18,3)), 4) AS temp, round_even(avg(precip), 0)::BIGINT AS rounded FROM weather WHERE temp BETWEEN -50 AND 50 GROUP BY ALL")
def a02(spark, sf):
    w = weather(spark, sf).where("temp between -50 and 50")
    return w.groupBy("grid", F.floor(F.col("obs_s") / 3600).alias("h")).agg(F.bround(F.sum(F.col("temp").cast("decimal(18,3)")).cast("double") / F.count("*"), 4).alias("temp"), F.bround(F.avg("precip"), 0).cast("long").alias("rounded"))


_REV = "rev AS (SELECT * FROM population QUALIFY row_number() OVER (PARTITION BY cell, dong, day, hour ORDER BY estimated, revision DESC) = 1)"


def revised(spark, sf):
    """W06: actual rows win over estimates, then the newest revision."""
    best = F.min(F.struct("estimated", (-F.col("revision")).alias("r"), "event_id", "spop")).alias("x")
    return population(spark, sf).groupBy("cell", "dong", "day", "hour").agg(best).select("cell", "dong", "day", "hour", "x.event_id", "x.spop", "x.estimated")


@query("w05_latest_revision", "SELECT cell, day, arg_max(event_id, revision) AS event_id FROM population GROUP BY ALL")
def w05(spark, sf):
    return population(spark, sf).groupBy("cell", "day").agg(F.max_by("event_id", "revision").alias("event_id"))


@query("w06_actual_over_estimate", f"WITH {_REV} SELECT cell, dong, day, hour, event_id, estimated FROM rev")
def w06(spark, sf):
    return revised(spark, sf).select("cell", "dong", "day", "hour", "event_id", "estimated")


@query("a03_component_sum", f"WITH {_REV} SELECT cell, day, hour, round_even(sum(CASE WHEN dong = 1 THEN NULL ELSE spop END::DECIMAL(18,2))::DOUBLE, 2) AS spop FROM rev GROUP BY ALL")
def a03(spark, sf):
    return revised(spark, sf).groupBy("cell", "day", "hour").agg(money(F.when(F.col("dong") != 1, F.col("spop"))).alias("spop"))


@query("c04_population_by_cell_hour", f"WITH {_REV} SELECT cell, day, hour, sum(spop::DECIMAL(18,2))::DOUBLE AS spop, bool_or(estimated) AS any_estimated FROM rev GROUP BY ALL")
def c04(spark, sf):
    return revised(spark, sf).groupBy("cell", "day", "hour").agg(money(F.col("spop")).alias("spop"), F.bool_or("estimated").alias("any_estimated"))


#: Age groups of a population row, for men and women (fixed values).
AGES = [f"{sex}_{age}" for sex in ("m", "f") for age in ("0_9", "10_14", "15_19", "20_24", "25_29", "30_34", "35_39", "40_44", "45_49", "50_54", "55_59", "60_64", "65_69", "70_up")]


def _age_sql(k: int, name: str) -> str:
    return f"sum(CASE WHEN event_id % 9 <> {k % 9} THEN (spop * {k + 1} / 100)::DECIMAL(18, 4) END)::DOUBLE AS {name}"


def population_totals(rows, keys, columns, places: int = 4):
    """Sums of all columns and the smallest district per key, exact to `places` decimals; a column without any value in a key stays null."""
    exact = lambda c: F.sum(F.col(c).cast(f"decimal(18,{places})")).cast("double").alias(c)
    return rows.groupBy(*keys).agg(*map(exact, columns), F.min("dong").alias("dong"))


@query("a04_cell_hour_totals", f"SELECT cell, day, hour, sum(spop::DECIMAL(18, 4))::DOUBLE AS spop, {', '.join(_age_sql(k, n) for k, n in enumerate(AGES))}, min(dong)::BIGINT AS dong FROM population GROUP BY ALL")
def a04(spark, sf):
    """Total and 28 age columns per cell and hour over its districts: one aggregation of all columns."""
    p = population(spark, sf)
    p = p.withColumns({n: F.when(F.col("event_id") % 9 != k % 9, F.col("spop") * (k + 1) / 100) for k, n in enumerate(AGES)})
    return population_totals(p, ["cell", "day", "hour"], ["spop", *AGES])


@query("a05_station_profile", "SELECT user_id % 20 AS station, hour(ts) AS h, isodow(ts) - 1 AS wd, round_even(sum(value::DECIMAL(18,2))::DOUBLE / count(*), 8) AS mean, round_even(coalesce(stddev_samp(value), 0), 3) AS sd, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def a05(spark, sf):
    e = ev(spark, sf)
    return e.groupBy((F.col("user_id") % 20).alias("station"), F.hour("ts").alias("h"), F.weekday("ts").alias("wd")).agg(F.bround(money(F.col("value")) / F.count("*"), 8).alias("mean"), F.bround(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), 3).alias("sd"), F.count("*").alias("n"))


@query("a06_population_profile", "SELECT cell, hour, day % 7 AS wd, round_even(sum(spop::DECIMAL(18,2))::DOUBLE / count(*), 8) AS spop FROM population GROUP BY ALL")
def a06(spark, sf):
    return population(spark, sf).groupBy("cell", "hour", (F.col("day") % 7).alias("wd")).agg(F.bround(money(F.col("spop")) / F.count("*"), 8).alias("spop"))


@query("a07_historical_average", "SELECT cell, hour, round_even(sum(spop::DECIMAL(18,2))::DOUBLE / count(*), 8) AS spop FROM population WHERE day % 7 < 5 GROUP BY ALL")
def a07(spark, sf):
    return population(spark, sf).where("day % 7 < 5").groupBy("cell", "hour").agg(F.bround(money(F.col("spop")) / F.count("*"), 8).alias("spop"))


def partial_state(df):
    """A08: mergeable sums and counts per key and day."""
    return df.groupBy("cell", "hour", "day").agg(F.sum(F.col("spop").cast("decimal(18,2)")).alias("total"), F.count("spop").alias("n"))


def finalised(state):
    return state.groupBy("cell", "hour").agg(F.bround(F.sum("total").cast("double") / F.sum("n"), 8).alias("spop"))


@query("a08_partial_state", "SELECT cell, hour, round_even(sum(spop::DECIMAL(18,2))::DOUBLE / count(*), 8) AS spop FROM population GROUP BY ALL")
def a08(spark, sf):
    p = population(spark, sf)
    cached, new = partial_state(p.where("day < 19740")), partial_state(p.where("day >= 19740"))
    return finalised(cached.unionByName(new))


_ERR = "err AS (SELECT event_id, user_id % 12 + 1 AS horizon, epoch_us(ts) // 86400000000 AS day, (event_id * 7 % 11)::DOUBLE AS y, (value / 10)::DOUBLE AS mu FROM events)"


def errors(spark, sf):
    return ev(spark, sf).select("event_id", (F.col("user_id") % 12 + 1).alias("horizon"), F.floor(F.col("s") / 86400).alias("day"), (F.col("event_id") * 7 % 11).cast("double").alias("y"), (F.col("value") / 10).alias("mu"))


@query("a09_error_partial_sums", f"WITH {_ERR} SELECT horizon, count(*)::BIGINT AS n, round_even(sqrt(sum((y - mu) * (y - mu)) / count(*)), 6) AS rmse, round_even(sum(abs(y - mu)) / count(*), 6) AS mae FROM err GROUP BY ALL")
def a09(spark, sf):
    e = errors(spark, sf).withColumn("d", F.col("y") - F.col("mu"))
    per_day = e.groupBy("horizon", "day").agg(F.count("*").alias("n"), F.sum(F.col("d") * F.col("d")).alias("sq"), F.sum(F.abs("d")).alias("ab"))
    return per_day.groupBy("horizon").agg(F.sum("n").alias("n"), F.bround(F.sqrt(F.sum("sq") / F.sum("n")), 6).alias("rmse"), F.bround(F.sum("ab") / F.sum("n"), 6).alias("mae"))


@query("a10_poisson_deviance", f"WITH {_ERR} SELECT horizon, round_even(2 * avg(CASE WHEN y = 0 THEN greatest(mu, 1e-6) ELSE y * ln(y / greatest(mu, 1e-6)) - y + greatest(mu, 1e-6) END), 5) AS deviance FROM err GROUP BY ALL")
def a10(spark, sf):
    mu = F.greatest(F.col("mu"), F.lit(1e-6))
    term = F.when(F.col("y") == 0, mu).otherwise(F.col("y") * F.ln(F.col("y") / mu) - F.col("y") + mu)
    return errors(spark, sf).groupBy("horizon").agg(F.bround(2 * F.avg(term), 5).alias("deviance"))


@query("a11_pinball_loss", f"WITH {_ERR} SELECT horizon, round_even(avg(greatest(0.9 * (y - mu), (0.9 - 1) * (y - mu))), 6) AS loss FROM err GROUP BY ALL")
def a11(spark, sf):
    d = F.col("y") - F.col("mu")
    return errors(spark, sf).groupBy("horizon").agg(F.bround(F.avg(F.greatest(0.9 * d, (0.9 - 1) * d)), 6).alias("loss"))


@query("a12_rmse_and_coverage", f"WITH {_ERR} SELECT horizon, round_even(sqrt(avg(pow(y - mu, 2))), 6) AS rmse, round_even(avg((y BETWEEN mu - 2 AND mu + 2)::INT), 6) AS coverage FROM err GROUP BY ALL")
def a12(spark, sf):
    inside = F.col("y").between(F.col("mu") - 2, F.col("mu") + 2).cast("int")
    return errors(spark, sf).groupBy("horizon").agg(F.bround(F.sqrt(F.avg(F.pow(F.col("y") - F.col("mu"), 2))), 6).alias("rmse"), F.bround(F.avg(inside), 6).alias("coverage"))


#: Buckets of scores per unit.
BUCKETS = 256


@query("a13_split_conformal", f"WITH {_ERR}, s AS (SELECT horizon, greatest(mu - 2 - y, y - mu - 2) AS score, row_number() OVER (PARTITION BY horizon ORDER BY greatest(mu - 2 - y, y - mu - 2)) - 1 AS k, count(*) OVER (PARTITION BY horizon) AS n FROM err), q AS (SELECT *, (n - 1) * least(1.0, ceil((n + 1) * 0.8) / n) AS at_k FROM s) SELECT horizon, round_even(min(score) + (max(score) - min(score)) * (max(at_k) - floor(max(at_k))), 6) AS q FROM q WHERE k = floor(at_k) OR k = ceil(at_k) GROUP BY ALL")
def a13(spark, sf):
    """Exact quantile at ceil((n + 1) * 0.8) / n of max(lo - y, y - hi), interpolated."""
    e = errors(spark, sf).withColumn("score", F.greatest(F.col("mu") - 2 - F.col("y"), F.col("y") - F.col("mu") - 2))
    # counts per bucket of scores find the bucket that holds the wanted rank; only its rows are ranked one by one
    e = e.withColumn("b", F.floor(F.col("score") * BUCKETS))
    per = e.groupBy("horizon", "b").agg(F.count("*").alias("m"))
    before = W.partitionBy("horizon").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    per = per.withColumns({"before": F.coalesce(F.sum("m").over(before), F.lit(0)), "n": F.sum("m").over(W.partitionBy("horizon"))})
    at = (F.col("n") - 1) * F.least(F.lit(1.0), F.ceil((F.col("n") + 1) * F.lit(0.8)) / F.col("n"))
    per = per.withColumn("at", at).where("before <= ceil(at) and before + m > floor(at)")
    w = W.partitionBy("horizon", "b").orderBy("score", "event_id")
    r = e.join(per, ["horizon", "b"]).withColumn("k", F.col("before") + F.row_number().over(w) - 1).where("k = floor(at) or k = ceil(at)")
    lo, hi = F.min("score"), F.max("score")
    return r.groupBy("horizon").agg(F.bround(lo + (hi - lo) * (F.max("at") - F.floor(F.max("at"))), 6).alias("q"))


@query("a14_run_summary", "SELECT t.s AS source, count(o_orderkey)::BIGINT AS runs, count(*) FILTER (WHERE o_orderstatus = 'F')::BIGINT AS failed, coalesce(round_even(count(*) FILTER (WHERE o_orderstatus = 'F') / nullif(count(o_orderkey), 0), 6), 0) AS fail_rate, count(o_orderkey) = 0 OR coalesce(count(*) FILTER (WHERE o_orderstatus = 'F') / nullif(count(o_orderkey), 0), 0) > t.lim AS risk FROM (VALUES ('1-URGENT', 0.3), ('2-HIGH', 0.34), ('5-LOW', 0.5), ('9-NONE', 0.1)) t(s, lim) LEFT JOIN orders ON o_orderpriority = t.s GROUP BY t.s, t.lim")
def a14(spark, sf):
    t = spark.createDataFrame([("1-URGENT", 0.3), ("2-HIGH", 0.34), ("5-LOW", 0.5), ("9-NONE", 0.1)], "source string, lim double")
    o = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("source")).agg(F.count("*").alias("runs"), F.count_if(F.col("o_orderstatus") == "F").alias("failed"))
    zero = F.lit(0).cast("long")
    out = F.broadcast(t).join(o, "source", "left").withColumns({"runs": F.coalesce("runs", zero), "failed": F.coalesce("failed", zero)})
    rate = F.coalesce(F.try_divide("failed", "runs"), F.lit(0.0))
    return out.select("source", "runs", "failed", F.bround(rate, 6).alias("fail_rate"), ((F.col("runs") == 0) | (rate > F.col("lim"))).alias("risk"))


@query("a15_daily_completeness", "SELECT epoch_us(ts) // 86400000000 AS day, count(DISTINCT epoch_us(ts) // 300000000)::BIGINT AS windows, round_even(count(DISTINCT epoch_us(ts) // 300000000) / 288, 6) AS ratio FROM events GROUP BY ALL")
def a15(spark, sf):
    w = ev(spark, sf).select(F.floor(F.col("s") / 300).alias("w")).distinct()
    return w.groupBy(F.floor(F.col("w") / 288).alias("day")).agg(F.count("*").alias("windows")).withColumn("ratio", F.bround(F.col("windows") / 288, 6))


@query("a16_dispatched_coverage", "SELECT l_suppkey, l_returnflag, sum(l_quantity)::BIGINT AS qty FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL")
def a16(spark, sf):
    return table(spark, sf, "lineitem").where("l_linestatus = 'O'").groupBy("l_suppkey", "l_returnflag").agg(F.sum("l_quantity").cast("long").alias("qty"))


_RES = "res AS (SELECT station_id, tick, event_id, lead(bikes) OVER w - bikes + (event_id % 3 - 1) AS r FROM stock WINDOW w AS (PARTITION BY station_id ORDER BY tick, event_id))"


def residuals(spark, sf):
    w = W.partitionBy("station_id").orderBy("tick", "event_id")
    return stock(spark, sf).select("station_id", "tick", "event_id", (F.lead("bikes").over(w) - F.col("bikes") + (F.col("event_id") % 3 - 1)).alias("r"))


@query("w20_checkpoint_residual", f"WITH {_RES} SELECT event_id, r FROM res WHERE r IS NOT NULL")
def w20(spark, sf):
    return residuals(spark, sf).where("r is not null").select("event_id", "r")


@query("a17_operator_movement", f"WITH {_RES} SELECT station_id, sum(greatest(r, 0))::BIGINT AS added, sum(greatest(-r, 0))::BIGINT AS removed, least(sum(greatest(r, 0)), sum(greatest(-r, 0)))::BIGINT AS balanced, abs(sum(r))::BIGINT AS imbalance, round_even(avg(abs(r)), 6) AS mae FROM res WHERE r IS NOT NULL GROUP BY ALL")
def a17(spark, sf):
    r, zero = F.col("r"), F.lit(0)
    add, rem = F.sum(F.greatest(r, zero)), F.sum(F.greatest(-r, zero))
    return residuals(spark, sf).where("r is not null").groupBy("station_id").agg(add.alias("added"), rem.alias("removed"), F.least(add, rem).alias("balanced"), F.abs(F.sum(r)).alias("imbalance"), F.bround(F.avg(F.abs(r)), 6).alias("mae"))


@query("a19_most_frequent_id", "SELECT station_id, arg_max(bike_id, (n, -bike_id)) AS bike_id FROM (SELECT station_id, bike_id, count(*) AS n FROM trips GROUP BY ALL) GROUP BY ALL")
def a19(spark, sf):
    n = trips(spark, sf).groupBy("station_id", "bike_id").agg(F.count("*").alias("n"))
    return n.groupBy("station_id").agg(F.max_by("bike_id", F.struct("n", -F.col("bike_id"))).alias("bike_id"))


@query("a20_one_to_one_check", "SELECT 'forward' AS side, l_partkey AS id, count(DISTINCT l_suppkey)::BIGINT AS n FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_suppkey) > 1 UNION ALL SELECT 'back', l_suppkey, count(DISTINCT l_partkey) FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_partkey) > 1")
def a20(spark, sf):
    p = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").distinct()
    one = lambda side, k: p.groupBy(F.col(k).alias("id")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(side).alias("side"), "id", "n")
    return one("forward", "l_partkey").unionByName(one("back", "l_suppkey"))


@query("a21_empty_station_hours", "SELECT station_id, count(*) FILTER (WHERE bikes <= 0)::BIGINT AS empty FROM stock GROUP BY ALL")
def a21(spark, sf):
    return stock(spark, sf).groupBy("station_id").agg(F.count_if(F.col("bikes") <= 0).alias("empty"))


_CELLS = "cells AS (SELECT epoch_us(ts) // 86400000000 AS cell, user_id % 3 AS minutes, sum(event_id % 7)::BIGINT AS base, sum(event_id % 5)::BIGINT AS cand FROM events GROUP BY ALL)"


def cells(spark, sf):
    return ev(spark, sf).groupBy(F.floor(F.col("s") / 86400).alias("cell"), (F.col("user_id") % 3).alias("minutes")).agg(F.sum(F.col("event_id") % 7).alias("base"), F.sum(F.col("event_id") % 5).alias("cand"))


_ROLL = "SELECT minutes, sum(base)::BIGINT AS base, sum(cand)::BIGINT AS cand, count(*) FILTER (WHERE cand < base)::BIGINT AS improved, count(*) FILTER (WHERE cand = base)::BIGINT AS equal, count(*) FILTER (WHERE cand > base)::BIGINT AS worse, round_even(100 * (sum(base) - sum(cand)) / sum(base), 4) AS reduction FROM cells GROUP BY ALL"


@query("a22_policy_roll_up", f"WITH {_CELLS} {_ROLL}")
def a22(spark, sf):
    b, c = F.sum("base"), F.sum("cand")
    return cells(spark, sf).groupBy("minutes").agg(b.alias("base"), c.alias("cand"), F.count_if(F.col("cand") < F.col("base")).alias("improved"), F.count_if(F.col("cand") == F.col("base")).alias("equal"), F.count_if(F.col("cand") > F.col("base")).alias("worse"), F.bround(100 * (b - c) / b, 4).alias("reduction"))


@query("a23_gate_flags", f"WITH {_CELLS} SELECT minutes, bool_and(cand <= base * 1.2) AS no_cell_much_worse, bool_and(cand > 0) AS all_present FROM cells GROUP BY ALL")
def a23(spark, sf):
    return cells(spark, sf).groupBy("minutes").agg(F.bool_and(F.col("cand") <= F.col("base") * 1.2).alias("no_cell_much_worse"), F.bool_and(F.col("cand") > 0).alias("all_present"))


@query("c38_policy_comparison", f"WITH {_CELLS}, r AS ({_ROLL}) SELECT c.cell, c.minutes, (c.cand - c.base)::BIGINT AS delta, r.reduction, CASE WHEN c.cand < c.base THEN 'resolved' WHEN c.cand > c.base THEN 'new' ELSE 'same' END AS state FROM cells c JOIN r USING (minutes)")
def c38(spark, sf):
    c = cells(spark, sf)
    state = F.when(F.col("cand") < F.col("base"), "resolved").when(F.col("cand") > F.col("base"), "new").otherwise("same")
    return c.withColumns({"delta": F.col("cand") - F.col("base"), "state": state}).drop("base", "cand").join(a22(spark, sf).select("minutes", "reduction"), "minutes").select("cell", "minutes", "delta", "reduction", "state")


@query("a24_publication_summary", "SELECT event_type, count(*)::BIGINT AS n, min(epoch_us(ts) // 1000000) AS first_s, max(epoch_us(ts) // 1000000) AS last_s, count(DISTINCT user_id)::BIGINT AS stations, count(DISTINCT user_id) * 12 AS expected, count(*) >= count(DISTINCT user_id) * 12 AS complete FROM events GROUP BY ALL")
def a24(spark, sf):
    per = ev(spark, sf).groupBy("event_type", "user_id").agg(F.count("*").alias("n"), F.min("s").alias("a"), F.max("s").alias("z"))
    return per.groupBy("event_type").agg(F.sum("n").alias("n"), F.min("a").alias("first_s"), F.max("z").alias("last_s"), F.count("*").alias("stations")).withColumns({"expected": F.col("stations") * 12, "complete": F.col("n") >= F.col("stations") * 12})


@query("a25_nested_stops", "SELECT l_orderkey, array_to_string(list(l_linenumber || ':' || l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey), ',') AS stops FROM lineitem GROUP BY ALL")
def a25(spark, sf):
    a = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey")))
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(a.alias("a")).select("l_orderkey", F.array_join(F.transform("a", lambda x: F.concat_ws(":", x["l_linenumber"], x["l_partkey"])), ",").alias("stops"))


_METRICS = "avg(pow(y - mu, 2)) {0} AS {1}mse, avg((y BETWEEN mu - 2 AND mu + 2)::INT) {0} AS {1}cov"


@query(
    "a26_retrain_decision",
    f"""WITH {_ERR}, m AS (SELECT horizon, {_METRICS.format("FILTER (WHERE event_id IS NOT NULL)", "")}, {_METRICS.format("FILTER (WHERE day < 19738)", "old_")}, {_METRICS.format("FILTER (WHERE day >= 19738)", "new_")} FROM err GROUP BY ALL)
SELECT horizon, sqrt(mse) > 4.1 OR cov < 0.4 AS retrain, concat_ws(',', CASE WHEN sqrt(mse) > 4.1 THEN 'rmse' END, CASE WHEN cov < 0.4 THEN 'coverage' END) AS reasons,
  coalesce(new_mse <= old_mse AND new_cov >= old_cov - 0.02, false) AS promote, concat_ws(',', CASE WHEN new_mse IS NULL OR old_mse IS NULL THEN 'no_data' END, CASE WHEN new_mse > old_mse THEN 'rmse' END, CASE WHEN new_cov < old_cov - 0.02 THEN 'coverage' END) AS against FROM m""",
)
def a26(spark, sf):
    """Whether a model is to be trained again, and whether the challenger (late days) may replace the champion (early days)."""
    e = errors(spark, sf).withColumns({"sq": F.pow(F.col("y") - F.col("mu"), 2), "inside": F.col("y").between(F.col("mu") - 2, F.col("mu") + 2).cast("int")})
    old, new = F.col("day") < 19738, F.col("day") >= 19738
    m = e.groupBy("horizon").agg(
        *[F.avg(c).alias(n) for c, n in (("sq", "mse"), ("inside", "cov"))],
        *[F.avg(F.when(when, F.col(c))).alias(f"{k}_{n}") for k, when in (("old", old), ("new", new)) for c, n in (("sq", "mse"), ("inside", "cov"))],
    )
    said = lambda pairs: F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in pairs])), ",")
    weak = [(F.sqrt("mse") > 4.1, "rmse"), (F.col("cov") < 0.4, "coverage")]
    worse = [(F.col("new_mse").isNull() | F.col("old_mse").isNull(), "no_data"), (F.col("new_mse") > F.col("old_mse"), "rmse"), (F.col("new_cov") < F.col("old_cov") - 0.02, "coverage")]
    promote = F.coalesce((F.col("new_mse") <= F.col("old_mse")) & (F.col("new_cov") >= F.col("old_cov") - 0.02), F.lit(False))
    return m.select("horizon", (weak[0][0] | weak[1][0]).alias("retrain"), said(weak).alias("reasons"), promote.alias("promote"), said(worse).alias("against"))


@query("a27_category_list", "SELECT event_type, row_number() OVER (ORDER BY event_type) AS code FROM (SELECT DISTINCT event_type FROM events)")
def a27(spark, sf):
    return table(spark, sf, "events").agg(F.array_sort(F.collect_set("event_type")).alias("a")).select(F.posexplode("a").alias("code", "event_type")).select("event_type", (F.col("code") + 1).cast("long").alias("code"))


@query("w07_next_observation", "SELECT event_id, lead(obs_s) OVER (PARTITION BY grid ORDER BY obs_s, event_id) AS next_s FROM weather")
def w07(spark, sf):
    """Rows are ordered within a grid's day; the last one of a day takes the first one of the grid's next day that has any."""
    o = weather(spark, sf).withColumn("day", F.floor(F.col("obs_s") / 86400))
    days = o.groupBy("grid", "day").agg(F.min("obs_s").alias("first"))
    days = days.withColumn("after", F.lead("first").over(W.partitionBy("grid").orderBy("day"))).drop("first")
    inside = F.lead("obs_s").over(W.partitionBy("grid", "day").orderBy("obs_s", "event_id"))
    return o.withColumn("inside", inside).join(days, ["grid", "day"]).select("event_id", F.coalesce("inside", "after").alias("next_s"))


@query("w08_leading_invalid_run", "SELECT user_id, (coalesce(min(rn) FILTER (WHERE event_type <> 'error'), count(*) + 1) - 1)::BIGINT AS run FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rn FROM events) GROUP BY ALL")
def w08(spark, sf):
    e = table(spark, sf, "events").withColumn("rn", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("ts"), "event_id")))
    return e.groupBy("user_id").agg((F.coalesce(F.min(F.when(F.col("event_type") != "error", F.col("rn"))), F.count("*") + 1) - 1).alias("run"))


@query("w09_stock_trend", "WITH m AS (SELECT station_id, max(tick) AS z FROM stock GROUP BY ALL) SELECT station_id, CASE WHEN count(DISTINCT tick) >= 2 THEN coalesce(round_even(regr_slope(bikes, (z - tick) / -60.0), 6), 0) ELSE 0 END AS slope FROM stock JOIN m USING (station_id) WHERE tick > z - 172800 GROUP BY ALL")
def w09(spark, sf):
    s = stock(spark, sf)
    m = s.groupBy("station_id").agg(F.max("tick").alias("z"))
    x = (F.col("z") - F.col("tick")) / -60.0
    return s.join(m, "station_id").where("tick > z - 172800").groupBy("station_id").agg(F.when(F.countDistinct("tick") >= 2, F.coalesce(F.bround(F.regr_slope("bikes", x), 6), F.lit(0.0))).otherwise(0.0).alias("slope"))


def paths(spark, sf, start=None):
    """Per station and horizon: running net flow, and the stock clamped at 0 in each step, in closed form."""
    w = W.partitionBy("station_id").orderBy("horizon").rowsBetween(W.unboundedPreceding, 0)
    f = forecast(spark, sf).withColumn("start", (F.col("station_id") % 15 if start is None else start).cast("double"))
    f = f.withColumn("total", F.col("start") + F.sum(F.col("ret") - F.col("rent")).over(w))
    lowest = F.least(F.lit(0.0), F.min("total").over(w))
    return f.withColumns({"stock": F.col("total") - lowest, "spread": F.sqrt(F.sum(F.col("ret") + F.col("rent")).over(w))})


CLAMP_SQL = """path AS (SELECT station_id, 1::BIGINT AS horizon, greatest(0.0, station_id % 15 + ret - rent)::DOUBLE AS stock, (station_id % 15 + ret - rent)::DOUBLE AS total, (ret + rent)::DOUBLE AS flow FROM forecast WHERE horizon = 1
UNION ALL SELECT f.station_id, f.horizon, greatest(0.0, p.stock + f.ret - f.rent), p.total + f.ret - f.rent, p.flow + f.ret + f.rent FROM path p JOIN forecast f ON f.station_id = p.station_id AND f.horizon = p.horizon + 1)"""


@query("w10_clamped_stock", f"WITH RECURSIVE {CLAMP_SQL} SELECT station_id, horizon, stock FROM path")
def w10(spark, sf):
    return paths(spark, sf).select("station_id", "horizon", "stock")


@query("w11_deepest_deficit", f"WITH RECURSIVE {CLAMP_SQL} SELECT station_id, greatest(0, -min(total)) AS deficit, greatest(0, max(total) - (20 + station_id % 10)) AS overshoot FROM path GROUP BY station_id")
def w11(spark, sf):
    p = paths(spark, sf).groupBy("station_id").agg(F.min("total").alias("lo"), F.max("total").alias("hi"))
    return p.select("station_id", F.greatest(F.lit(0.0), -F.col("lo")).alias("deficit"), F.greatest(F.lit(0.0), F.col("hi") - (20 + F.col("station_id") % 10)).alias("overshoot"))


@query("w12_poisson_lower_path", f"WITH RECURSIVE {CLAMP_SQL} SELECT station_id, round_even(min(total - 1.645 * sqrt(flow)), 6) AS lowest FROM path GROUP BY ALL")
def w12(spark, sf):
    return paths(spark, sf).groupBy("station_id").agg(F.bround(F.min(F.col("total") - 1.645 * F.col("spread")), 6).alias("lowest"))


def adverse_path(panel, start):
    """Per station and horizon the lower of two stocks: of the quantile path, which takes the tenth percentile of returns and the
    ninetieth of rentals at each step, and of the Poisson path, the mean less 1.645 deviations. panel: rent, ret, rent_p90, ret_p10."""
    w = W.partitionBy("station_id").orderBy("horizon").rowsBetween(W.unboundedPreceding, 0)  # 12 rows a station
    quantile = start + F.sum(F.col("ret_p10") - F.col("rent_p90")).over(w)
    poisson = start + F.sum(F.col("ret") - F.col("rent")).over(w) - 1.645 * F.sqrt(F.sum(F.col("ret") + F.col("rent")).over(w))
    return panel.select("station_id", "horizon", F.least(quantile, poisson).alias("adverse"))


def quantile_panel(spark, sf):
    """The forecast with quantiles of each station's and hour's own history: residuals of past counts round the mean."""
    h = F.col("horizon")
    t = trips(spark, sf)
    per = lambda key, at: t.where(f"{at} is not null").groupBy(F.col(key).alias("_s"), (F.floor(F.col(at) / 7200) % 12 + 1).alias("horizon"), F.floor(F.col(at) / 86400).alias("_d")).agg(F.count("*").alias("n"))
    low = lambda df, q, out: df.groupBy("_s", "horizon").agg(F.percentile("n", q).alias(out))
    rent, ret = low(per("station_id", "start_s"), 0.9, "_rent"), low(per("end_station_id", "end_s"), 0.1, "_ret")
    f = forecast(spark, sf).withColumn("_s", F.col("station_id") % 20)
    f = f.join(rent, ["_s", "horizon"], "left").join(ret, ["_s", "horizon"], "left")
    return f.select("station_id", h, "rent", "ret", F.greatest("rent", F.coalesce("_rent", "rent")).alias("rent_p90"), F.least("ret", F.coalesce("_ret", "ret")).alias("ret_p10"))


_W13 = f"""
WITH RECURSIVE {CLAMP_SQL},
o AS (SELECT station_id AS s, start_s // 7200 % 12 + 1 AS horizon, start_s // 86400 AS d, count(*) AS n FROM trips GROUP BY ALL),
i AS (SELECT end_station_id AS s, end_s // 7200 % 12 + 1 AS horizon, end_s // 86400 AS d, count(*) AS n FROM trips WHERE end_s IS NOT NULL GROUP BY ALL),
oq AS (SELECT s, horizon, quantile_cont(n, 0.9) AS q FROM o GROUP BY ALL),
iq AS (SELECT s, horizon, quantile_cont(n, 0.1) AS q FROM i GROUP BY ALL),
p AS (
  SELECT f.station_id, f.horizon, greatest(f.rent, coalesce(oq.q, f.rent)) AS rent_p90, least(f.ret, coalesce(iq.q, f.ret)) AS ret_p10
  FROM forecast f LEFT JOIN oq ON oq.s = f.station_id % 20 AND oq.horizon = f.horizon LEFT JOIN iq ON iq.s = f.station_id % 20 AND iq.horizon = f.horizon),
a AS (SELECT station_id, horizon, station_id % 15 + sum(ret_p10 - rent_p90) OVER (PARTITION BY station_id ORDER BY horizon) AS q FROM p)
SELECT station_id, horizon, round_even(least(q, total - 1.645 * sqrt(flow)), 6) AS adverse FROM a JOIN path USING (station_id, horizon)"""


@query("w13_adverse_path", _W13)
def w13(spark, sf):
    return adverse_path(quantile_panel(spark, sf), F.col("station_id") % 15).select("station_id", "horizon", F.bround("adverse", 6).alias("adverse"))


@query("w14_first_non_normal", f"WITH RECURSIVE {CLAMP_SQL} SELECT station_id, min(horizon) FILTER (WHERE stock <= 2 OR stock >= 20 + station_id % 10) AS horizon, CASE WHEN arg_min(stock, horizon) FILTER (WHERE stock <= 2 OR stock >= 20 + station_id % 10) <= 2 THEN 'supply' WHEN arg_min(stock, horizon) FILTER (WHERE stock <= 2 OR stock >= 20 + station_id % 10) IS NOT NULL THEN 'collect' ELSE 'none' END AS action FROM path GROUP BY station_id")
def w14(spark, sf):
    odd = (F.col("stock") <= 2) | (F.col("stock") >= 20 + F.col("station_id") % 10)
    p = paths(spark, sf).groupBy("station_id").agg(F.min(F.when(odd, F.struct("horizon", "stock"))).alias("x"))
    return p.select("station_id", F.col("x.horizon").alias("horizon"), F.when(F.col("x.stock") <= 2, "supply").when(F.col("x").isNotNull(), "collect").otherwise("none").alias("action"))


@query("w15_route_sequence", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey % 11, (o_orderdate + INTERVAL 9 HOUR)::DATE ORDER BY o_orderkey) AS no FROM orders")
def w15(spark, sf):
    o = table(spark, sf, "orders")
    w = W.partitionBy(F.col("o_custkey") % 11, F.to_date(F.col("o_orderdate") + F.expr("interval 9 hours"))).orderBy("o_orderkey")
    return o.select("o_orderkey", F.row_number().over(w).cast("long").alias("no"))


@query("w16_proposal_rank", "SELECT o_orderkey, dense_rank() OVER (PARTITION BY o_custkey % 11, o_orderdate ORDER BY floor(o_totalprice / 10000) DESC) AS rank FROM orders")
def w16(spark, sf):
    o = table(spark, sf, "orders").withColumn("b", F.floor(F.col("o_totalprice") / 10000))
    return o.select("o_orderkey", F.dense_rank().over(W.partitionBy(F.col("o_custkey") % 11, "o_orderdate").orderBy(F.desc("b"))).cast("long").alias("rank"))


@query("w17_consecutive_dates", "WITH d AS (SELECT DISTINCT user_id, epoch_us(ts) // 86400000000 AS day FROM events), g AS (SELECT *, day - row_number() OVER (PARTITION BY user_id ORDER BY day) AS g FROM d) SELECT user_id, min(day) AS first, max(day) AS last, count(*)::BIGINT AS n FROM g GROUP BY user_id, g")
def w17(spark, sf):
    d = ev(spark, sf).select("user_id", F.floor(F.col("s") / 86400).alias("day")).distinct()
    d = d.withColumn("g", F.col("day") - F.row_number().over(W.partitionBy("user_id").orderBy("day")))
    return d.groupBy("user_id", "g").agg(F.min("day").alias("first"), F.max("day").alias("last"), F.count("*").alias("n")).drop("g")


@query("w18_even_date_shards", "SELECT d, ntile(7) OVER (ORDER BY d) AS shard FROM (SELECT DISTINCT o_orderdate::DATE AS d FROM orders)")
def w18(spark, sf):
    d = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    """The first n % 7 shards have one date more; places come from range partitions, so no task holds all dates."""
    placed, n = S.placed(d, ["d"]), d.count()
    small, more = n // 7, n % 7
    shard = F.when(F.col("place") < more * (small + 1), F.floor(F.col("place") / (small + 1))).otherwise(more + F.floor((F.col("place") - more * (small + 1)) / max(1, small)))
    return placed.select("d", (shard + 1).cast("long").alias("shard"))


_REPLAY = "x AS (SELECT station_id, start_s AS t, -1 AS delta, event_id FROM trips UNION ALL SELECT end_station_id, end_s, 1, event_id FROM trips WHERE end_s IS NOT NULL), r AS (SELECT station_id, t, 40 + sum(delta) OVER (PARTITION BY station_id ORDER BY t, delta, event_id ROWS UNBOUNDED PRECEDING) AS bikes, lead(t) OVER (PARTITION BY station_id ORDER BY t, delta, event_id) - t AS held FROM x)"


def replay(spark, sf):
    t = trips(spark, sf)
    x = t.select("station_id", F.col("start_s").alias("t"), F.lit(-1).alias("delta"), "event_id").unionByName(t.where("end_s is not null").select(F.col("end_station_id").alias("station_id"), F.col("end_s").alias("t"), F.lit(1).alias("delta"), "event_id"))
    # running sums within a station's day; what earlier days leave and the next day's first time come from sums per day
    x = x.withColumn("day", F.floor(F.col("t") / 86400))
    w, days = W.partitionBy("station_id", "day").orderBy("t", "delta", "event_id"), W.partitionBy("station_id").orderBy("day")
    per = x.groupBy("station_id", "day").agg(F.sum("delta").alias("moved"), F.min("t").alias("first"))
    per = per.select("station_id", "day", F.coalesce(F.sum("moved").over(days.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.lead("first").over(days).alias("after"))
    x = x.withColumns({"inside": F.sum("delta").over(w.rowsBetween(W.unboundedPreceding, 0)), "next": F.lead("t").over(w)}).join(per, ["station_id", "day"])
    return x.select("station_id", "t", (40 + F.col("before") + F.col("inside")).alias("bikes"), (F.coalesce("next", "after") - F.col("t")).alias("held"))


@query("w21_stock_replay", f"WITH {_REPLAY} SELECT station_id, coalesce(sum(held) FILTER (WHERE bikes <= 0), 0)::BIGINT AS empty_s, coalesce(sum(held) FILTER (WHERE bikes < 0), 0)::BIGINT AS negative_s, min(bikes)::BIGINT AS lowest FROM r GROUP BY ALL")
def w21(spark, sf):
    zero = F.lit(0).cast("long")
    return replay(spark, sf).groupBy("station_id").agg(F.coalesce(F.sum(F.when(F.col("bikes") <= 0, F.col("held"))), zero).alias("empty_s"), F.coalesce(F.sum(F.when(F.col("bikes") < 0, F.col("held"))), zero).alias("negative_s"), F.min("bikes").alias("lowest"))


_TIMINGS_SQL = """
WITH moves AS (SELECT station_id, start_s AS t, -1 AS delta FROM trips UNION ALL SELECT end_station_id, end_s, 1 FROM trips WHERE end_s IS NOT NULL),
checks AS (SELECT station_id, tick AS t, arg_max(bikes, event_id) AS bikes FROM stock WHERE station_id IN (SELECT station_id FROM moves) GROUP BY ALL),
gaps AS (SELECT station_id, t AS t0, bikes AS b0, lead(t) OVER w AS t1, lead(bikes) OVER w AS b1 FROM checks WINDOW w AS (PARTITION BY station_id ORDER BY t)),
moved AS (
  SELECT g.station_id, t0, t1, b1 - b0 - coalesce(sum(m.delta), 0) AS quantity
  FROM gaps g LEFT JOIN moves m ON m.station_id = g.station_id AND m.t > g.t0 AND m.t <= g.t1 WHERE t1 IS NOT NULL GROUP BY g.station_id, t0, t1, b0, b1),
span AS (SELECT station_id, min(t) AS w0, max(t) AS w1, arg_min(bikes, t) AS b0, arg_max(bikes, t) AS b1 FROM checks GROUP BY ALL),
timings(timing, halves) AS (VALUES ('interval_start', 0), ('interval_midpoint', 1), ('interval_end', 2)),
changes AS (
  SELECT station_id, timing, t0 + (t1 - t0) * halves // 2 AS t, 0 AS prio, quantity AS delta FROM moved, timings WHERE abs(quantity) >= 5
  UNION ALL SELECT station_id, timing, t, CASE WHEN delta > 0 THEN 1 ELSE 2 END, delta FROM moves JOIN span USING (station_id), timings WHERE t > w0 AND t <= w1
  UNION ALL SELECT station_id, timing, w0, -1, b0 FROM span, timings),
played AS (
  SELECT station_id, timing, t, sum(delta) OVER (w ROWS UNBOUNDED PRECEDING) AS bikes, lead(t) OVER w AS after FROM changes
  WINDOW w AS (PARTITION BY station_id, timing ORDER BY t, prio)),
spent AS (
  SELECT station_id, timing, coalesce(sum(coalesce(after, w1) - t) FILTER (WHERE bikes <= 0), 0)::BIGINT AS empty_s,
    coalesce(sum(coalesce(after, w1) - t) FILTER (WHERE bikes < 0), 0)::BIGINT AS negative_s, min(bikes)::BIGINT AS lowest
  FROM played JOIN span USING (station_id) GROUP BY ALL),
ends AS (SELECT station_id, timing, abs(sum(delta) - any_value(b1))::BIGINT AS end_error FROM changes JOIN span USING (station_id) GROUP BY ALL)
SELECT * FROM spent JOIN ends USING (station_id, timing)"""


@query("w21b_replay_timings", _TIMINGS_SQL)
def w21b(spark, sf):
    """Empty and negative time, lowest stock and end error per station under three timings of unexplained movement."""
    t = trips(spark, sf)
    moves = t.select("station_id", F.col("start_s").alias("t"), F.lit(-1).cast("long").alias("delta"))
    moves = moves.unionByName(t.where("end_s is not null").select(F.col("end_station_id").alias("station_id"), F.col("end_s").alias("t"), F.lit(1).cast("long").alias("delta")))
    known = moves.select("station_id").distinct()
    checks = stock(spark, sf).groupBy("station_id", F.col("tick").alias("t")).agg(F.max_by("bikes", "event_id").alias("bikes"))
    return RP.replay_timings(checks.join(known, "station_id", "left_semi"), moves, least=5)


@query("w22_first_shortage", f"WITH {_REPLAY} SELECT station_id, min(t) FILTER (WHERE bikes < 0) AS first_s, min(bikes)::BIGINT AS lowest FROM r GROUP BY ALL")
def w22(spark, sf):
    return replay(spark, sf).groupBy("station_id").agg(F.min(F.when(F.col("bikes") < 0, F.col("t"))).alias("first_s"), F.min("bikes").alias("lowest"))


_LOAD = "ld AS (SELECT l_orderkey, sum(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) AS load FROM lineitem)"


@query("w23_prefix_load_check", f"WITH {_LOAD} SELECT l_orderkey, bool_and(load BETWEEN 0 AND 100) AS ok, max(load)::BIGINT AS peak FROM ld GROUP BY ALL")
def w23(spark, sf):
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey").rowsBetween(W.unboundedPreceding, 0)
    l = table(spark, sf, "lineitem").withColumn("load", F.sum(F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))).over(w))
    return l.groupBy("l_orderkey").agg(F.bool_and(F.col("load").between(0, 100)).alias("ok"), F.max("load").cast("long").alias("peak"))


@query("w24_capacity_allocation", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, least(l_quantity, greatest(0, 60 - (sum(l_quantity) OVER w - l_quantity)))::BIGINT AS given FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING)")
def w24(spark, sf):
    w = W.partitionBy("l_orderkey").orderBy(F.desc("l_quantity"), "l_linenumber", "l_partkey", "l_suppkey").rowsBetween(W.unboundedPreceding, 0)
    before = F.sum("l_quantity").over(w) - F.col("l_quantity")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.least("l_quantity", F.greatest(F.lit(0.0), 60 - before)).cast("long").alias("given"))
