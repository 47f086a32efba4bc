"""The demand model: Poisson regression with an exposure offset, residual quantiles and a conformal interval."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import query

#: Days before this one fit the model and its quantiles, later ones calibrate the interval.
SPLIT_S, COVERAGE = 19745 * 86400, 0.8


def demand(f):
    """f (station_id, tick, rental_count, rental_lag_1h, exposure) -> one row per feature row: mean, lo, hi, calibrated.

    The mean comes from a Poisson regression with log exposure as its offset. The 10 % and 90 % quantiles of the residuals are
    taken per hour of the day (percentile_approx: bounded memory), and the interval is widened by the split-conformal
    correction of the calibration days, the quantile at ceil((n + 1) c) / n of max(lo - y, y - hi), found by ranks."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    hour = F.floor(F.col("tick") / 3600) % 24
    f = f.withColumns({"y": F.col("rental_count").cast("double"), "x1": F.coalesce("rental_lag_1h", F.lit(0)).cast("double"), "off": F.log("exposure"), "hour": hour, "sinh": F.sin(hour * 0.2618), "cosh": F.cos(hour * 0.2618)})
    rows = VectorAssembler(inputCols=["x1", "sinh", "cosh"], outputCol="x").transform(f)
    early = F.col("tick") < SPLIT_S
    model = GeneralizedLinearRegression(family="poisson", link="log", featuresCol="x", labelCol="y", offsetCol="off", predictionCol="mu", maxIter=15, regParam=0.001).fit(rows.where(early))
    scored = model.transform(rows).select("station_id", "tick", "hour", "y", "mu", early.alias("early"))
    part = scored.where("early").groupBy("hour").agg(F.percentile_approx(F.col("y") - F.col("mu"), [0.1, 0.9], 10000).alias("q"))  # 24 rows
    banded = scored.join(part, "hour", "left").select("station_id", "tick", "y", "mu", "early", F.greatest(F.lit(0.0), F.col("mu") + F.col("q")[0]).alias("lo"), (F.col("mu") + F.col("q")[1]).alias("hi"))
    missed = F.bround(F.greatest(F.col("lo") - F.col("y"), F.col("y") - F.col("hi")), 3)
    per = banded.where("not early").groupBy(missed.alias("m")).agg(F.count("*").alias("n"))  # a row per thousandth
    n = per.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rank = min(n, -(-(n + 1) * COVERAGE // 1))
    below = per.withColumn("b", F.floor(F.col("m"))).groupBy("b").agg(F.sum("n").alias("n"))
    below = below.withColumn("c", F.sum("n").over(W.orderBy("b"))).where(F.col("c") >= rank).orderBy("b").limit(1).first() if n else None
    wide = 0.0
    if below:
        inner = per.where(F.floor(F.col("m")) == below.b).withColumn("c", F.lit(below.c - below.n) + F.sum("n").over(W.orderBy("m")))
        wide = inner.where(F.col("c") >= rank).agg(F.min("m")).first()[0]
    return banded.select("station_id", "tick", "y", F.bround("mu", 4).alias("mu"), F.bround("lo", 4).alias("lo"), F.bround("hi", 4).alias("hi"), F.bround(F.greatest(F.lit(0.0), F.col("lo") - wide), 4).alias("safe_lo"), F.bround(F.col("hi") + wide, 4).alias("safe_hi"), "early")


@query("c36_demand_model")
def c36(spark, sf):
    from .rolling import features

    return demand(features(spark, sf))
