"""Counts over moving windows, step functions and gap-aware lags. Times are epoch seconds (long)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def tick_floor(s, tick: int):
    return F.floor(s / F.lit(tick)) * tick


def tick_ceil(s, tick: int):
    return -tick_floor(-s, tick)


def _running(changes: DataFrame, key: str) -> DataFrame:
    """(key, tick, delta) -> the step function (key, tick, count); one row per key and tick meets the window."""
    per_tick = changes.groupBy(key, "tick").agg(F.sum("delta").alias("delta"))
    w = W.partitionBy(key).orderBy("tick").rowsBetween(W.unboundedPreceding, 0)
    return per_tick.select(key, "tick", F.sum("delta").over(w).alias("count"))


def _steps(spans: DataFrame, key: str, tick: int) -> DataFrame:
    """(key, first, last): +1 from the tick `first` to the tick `last`."""
    change = F.explode(F.array(F.struct(F.col("first").alias("tick"), F.lit(1).alias("delta")), F.struct((F.col("last") + tick).alias("tick"), F.lit(-1).alias("delta")))).alias("c")
    return _running(spans.where("first <= last").select(key, change).select(key, "c.*"), key)


def censored_counts(trips: DataFrame, window: int = 3600, embargo: int = 2400, tick: int = 1200, key: str = "station_id", start: str = "start_s", end: str = "end_s") -> DataFrame:
    """At each tick T: trips that began in [T - embargo - window, T - embargo) and had ended by T. Open trips never count."""
    out = F.col(start) + embargo
    spans = trips.where(F.col(end).isNotNull()).select(key, F.greatest(tick_floor(out, tick) + tick, tick_ceil(F.col(end), tick)).alias("first"), tick_floor(out + window, tick).alias("last"))
    return _steps(spans, key, tick)


def future_counts(events: DataFrame, width: int = 3600, tick: int = 1200, key: str = "station_id", at: str = "start_s") -> DataFrame:
    """At each tick T: events in [T, T + width)."""
    spans = events.select(key, (tick_floor(F.col(at) - width, tick) + tick).alias("first"), tick_floor(F.col(at), tick).alias("last"))
    return _steps(spans, key, tick)


def count_steps(trips: DataFrame, width: int = 3600, embargo: int = 2400, tick: int = 1200) -> DataFrame:
    """The step functions rental and returned (future_counts of starts and of ends) and recent (censored_counts), from one pass over
    trips (station_id, start_s, end_station_id, end_s): station_id, fn, tick, count."""
    start, end = F.col("start_s"), F.col("end_s")
    future = lambda at: (tick_floor(at - width, tick) + tick, tick_floor(at, tick))
    seen = (F.greatest(tick_floor(start + embargo, tick) + tick, tick_ceil(end, tick)), tick_floor(start + embargo + width, tick))
    spans = {"rental": ("station_id", *future(start), F.lit(True)), "returned": ("end_station_id", *future(end), end.isNotNull()), "recent": ("station_id", *seen, end.isNotNull())}
    changes = []
    for fn, (key, first, last, there) in spans.items():
        for at, delta in ((first, 1), (last + tick, -1)):
            row = F.struct(F.col(key).cast("long").alias("station_id"), F.lit(fn).alias("fn"), at.cast("long").alias("tick"), F.lit(delta).cast("long").alias("delta"))
            changes.append(F.when(there & (first <= last), row))
    per = trips.select(F.inline(F.array_compact(F.array(*changes)))).groupBy("station_id", "fn", "tick").agg(F.sum("delta").alias("delta"))
    w = W.partitionBy("station_id", "fn").orderBy("tick").rowsBetween(W.unboundedPreceding, 0)  # a row per tick
    return per.select("station_id", "fn", "tick", F.sum("delta").over(w).alias("count"))


def as_of(steps: DataFrame, wanted: DataFrame, key: str = "station_id", value: str = "count") -> DataFrame:
    """wanted (key, tick) with the last value at or before tick; keys or times without one get 0.

    Both sides go through one shuffle and one sorted pass, not a range join."""
    both = steps.select(key, "tick", F.col(value).alias("_v"), F.lit(0).alias("_asked")).unionByName(wanted.select(key, "tick", F.lit(None).cast("long").alias("_v"), F.lit(1).alias("_asked")))
    w = W.partitionBy(key).orderBy("tick", "_asked").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn(value, F.coalesce(F.last("_v", ignorenulls=True).over(w), F.lit(0))).where("_asked = 1").select(key, "tick", value)


def forward_fill(series: DataFrame, tick: int, stale: int, key: str, at: str, values: list[str]) -> DataFrame:
    """The series on the tick grid: each observation holds from its time until the next one, `stale` seconds at most."""
    nxt = F.lead(at).over(W.partitionBy(key).orderBy(at))
    first = tick_ceil(F.col(at), tick)
    last = F.least(tick_floor(F.col(at) + stale, tick), F.coalesce(tick_ceil(F.col("_next"), tick) - tick, F.lit(1 << 60)))
    held = series.withColumn("_next", nxt).withColumns({"_first": first, "_last": last}).where("_first <= _last")
    return held.select(key, F.explode(F.sequence("_first", "_last", F.lit(tick).cast("long"))).alias("tick"), *values)


def exact_lag(df: DataFrame, value: str, offset: int, out: str, key: str = "station_id", at: str = "tick") -> DataFrame:
    """df with the value of the row exactly `offset` seconds before: null over a gap, never the previous row's."""
    before = df.select(key, (F.col(at) + offset).alias(at), F.col(value).alias(out))
    return df.join(before, [key, at], "left")


def horizons(anchors: DataFrame, targets: DataFrame, n: int = 12, step: int = 3600, key: str = "station_id", at: str = "tick", values: tuple = ("count",)) -> DataFrame:
    """anchors x 1..n with the targets at tick + (h - 1) * step; rows without a target are dropped."""
    long = anchors.withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("_at", F.col(at) + (F.col("horizon") - 1) * step)
    right = targets.select(key, F.col(at).alias("_at"), *[F.col(v).alias(f"target_{v}") for v in values])
    return long.join(right, [key, "_at"]).drop("_at")


def visible(start, end, at, bucket: int):
    """Whether a trip is visible at `at`: it ended, and its start's bucket is over."""
    return end.isNotNull() & (end <= at) & (tick_floor(start, bucket) + bucket <= at)
