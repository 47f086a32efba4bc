"""Registration of queries, table access and the role views over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query (spark, sf_dir) -> DataFrame and, if SQL can express it, its DuckDB SQL."""

    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return f

    return put


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(c):
    """Epoch seconds of a zone-free timestamp, whatever the session's zone."""
    return F.unix_timestamp(c)


#: Role views in DuckDB SQL; a query's SQL names those it uses.
VIEWS = {
    "trips": """SELECT event_id, user_id % 20 AS station_id, (user_id + event_id) % 24 AS end_station_id, user_id AS bike_id,
        epoch_us(ts) // 1000000 AS start_s, CASE WHEN event_id % 11 <> 0 THEN epoch_us(ts) // 1000000 + (event_id * 37 % 180) * 60 END AS end_s FROM events""",
    "stock": """SELECT event_id, user_id AS station_id, epoch_us(ts) // 1000000 AS tick, (floor(value)::BIGINT % 40) AS bikes, 20 + user_id % 10 AS capacity FROM events""",
    "weather": """SELECT event_id, user_id % 34 AS grid, epoch_us(ts) // 1000000 AS obs_s, epoch_us(ts) // 1000000 + (event_id % 4) * 600 AS base_s,
        CASE WHEN event_id % 13 = 0 THEN NULL ELSE value / 10 END AS temp, event_id % 5 AS precip FROM events WHERE event_type = 'view'""",
    "population": """SELECT event_id, user_id % 25 AS cell, (user_id // 25) % 3 AS dong, epoch_us(ts) // 86400000000 AS day, (epoch_us(ts) // 3600000000) % 24 AS hour,
        value AS spop, event_id % 3 = 0 AS estimated, event_id AS revision FROM events""",
    "stations": """SELECT c_custkey AS station_id, c_nationkey AS region, 37.45 + (c_custkey * 37 % 200) / 1000.0 AS lat, 126.8 + (c_custkey * 91 % 350) / 1000.0 AS lon,
        10 + c_custkey % 30 AS capacity FROM customer""",
    "centers": """SELECT s_suppkey AS center_id, 37.45 + (s_suppkey * 53 % 200) / 1000.0 AS lat, 126.8 + (s_suppkey * 71 % 350) / 1000.0 AS lon FROM supplier WHERE s_suppkey < 11""",
    "forecast": """SELECT station_id, h AS horizon, (station_id * 7 + h * 3) % 9 + ((station_id + h) % 4) / 4.0 AS rent, (station_id * 5 + h * 11) % 8 + (station_id * h % 4) / 4.0 AS ret
        FROM (SELECT DISTINCT user_id AS station_id FROM events), (SELECT unnest(range(1, 13)) AS h)""",
}


def with_views(sql: str) -> str:
    """sql with the role views that it names put before it as common table expressions."""
    import re

    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    text = sql.strip()
    head = ", ".join(f"{v} AS ({VIEWS[v]})" for v in used)
    if not head:
        return text
    if re.match(r"WITH RECURSIVE\b", text):
        return f"WITH RECURSIVE {head}, {text[len('WITH RECURSIVE'):].strip()}"
    return f"WITH {head}, {text[4:].strip()}" if re.match(r"WITH\b", text) else f"WITH {head} {text}"


def trips(spark, sf) -> DataFrame:
    e = table(spark, sf, "events").withColumn("start_s", seconds("ts"))
    return e.select(
        "event_id",
        (F.col("user_id") % 20).alias("station_id"),
        ((F.col("user_id") + F.col("event_id")) % 24).alias("end_station_id"),
        F.col("user_id").alias("bike_id"),
        "start_s",
        F.when(F.col("event_id") % 11 != 0, F.col("start_s") + (F.col("event_id") * 37 % 180) * 60).alias("end_s"),
    )


def stock(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.col("user_id").alias("station_id"), seconds("ts").alias("tick"), (F.floor("value") % 40).alias("bikes"), (20 + F.col("user_id") % 10).alias("capacity"))


def weather(spark, sf) -> DataFrame:
    return (
        table(spark, sf, "events")
        .where("event_type = 'view'")
        .select(
            "event_id",
            (F.col("user_id") % 34).alias("grid"),
            seconds("ts").alias("obs_s"),
            (seconds("ts") + (F.col("event_id") % 4) * 600).alias("base_s"),
            F.when(F.col("event_id") % 13 != 0, F.col("value") / 10).alias("temp"),
            (F.col("event_id") % 5).alias("precip"),
        )
    )


def population(spark, sf) -> DataFrame:
    e = table(spark, sf, "events").withColumn("s", seconds("ts"))
    return e.select(
        "event_id",
        (F.col("user_id") % 25).alias("cell"),
        (F.floor(F.col("user_id") / 25) % 3).alias("dong"),
        F.floor(F.col("s") / 86400).alias("day"),
        (F.floor(F.col("s") / 3600) % 24).alias("hour"),
        F.col("value").alias("spop"),
        (F.col("event_id") % 3 == 0).alias("estimated"),
        F.col("event_id").alias("revision"),
    )


def stations(spark, sf) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(k.alias("station_id"), F.col("c_nationkey").alias("region"), (37.45 + (k * 37 % 200) / 1000.0).alias("lat"), (126.8 + (k * 91 % 350) / 1000.0).alias("lon"), (10 + k % 30).alias("capacity"))


def centers(spark, sf) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").where("s_suppkey < 11").select(k.alias("center_id"), (37.45 + (k * 53 % 200) / 1000.0).alias("lat"), (126.8 + (k * 71 % 350) / 1000.0).alias("lon"))


def forecast(spark, sf) -> DataFrame:
    s, h = F.col("station_id"), F.col("horizon")
    ids = table(spark, sf, "events").select(F.col("user_id").alias("station_id")).distinct()
    panel = ids.withColumn("horizon", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(12).cast("long"))))
    return panel.withColumns({"rent": ((s * 7 + h * 3) % 9 + ((s + h) % 4) / 4.0), "ret": ((s * 5 + h * 11) % 8 + (s * h % 4) / 4.0)})
