"""Replaying stock from signed changes: running totals by day, unexplained movement, and what different timings of it imply.

Times are epoch seconds (long). Running totals are windows over a key's day; what earlier days leave is added from sums per
key and day, so no task passes over a key's whole history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The part of an interval, in halves, after which unexplained movement is applied (fixed values).
TIMINGS = {"interval_start": 0, "interval_midpoint": 1, "interval_end": 2}


def running(changes: DataFrame, keys: list[str], at: str = "t", delta: str = "delta", ties: tuple = ()) -> DataFrame:
    """changes with `total`, the sum of delta up to and with each row in order of (at, ties), and `next_at`, the key's next time."""
    x = changes.withColumn("_day", F.floor(F.col(at) / 86400))
    inside, days = W.partitionBy(*keys, "_day").orderBy(at, *ties), W.partitionBy(*keys).orderBy("_day")
    per = x.groupBy(*keys, "_day").agg(F.sum(delta).alias("_moved"), F.min(at).alias("_first"))
    before = F.coalesce(F.sum("_moved").over(days.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    per = per.select(*keys, "_day", before.alias("_before"), F.lead("_first").over(days).alias("_after"))
    x = x.withColumns({"_sum": F.sum(delta).over(inside.rowsBetween(W.unboundedPreceding, 0)), "_next": F.lead(at).over(inside)})
    x = x.join(per, [*keys, "_day"]).withColumns({"total": F.col("_before") + F.col("_sum"), "next_at": F.coalesce("_next", "_after")})
    return x.drop("_day", "_moved", "_first", "_before", "_after", "_sum", "_next")


def unexplained(checks: DataFrame, moves: DataFrame) -> DataFrame:
    """Between consecutive checkpoints (station_id, t, bikes) the change that moves (station_id, t, delta) don't explain:
    station_id, t0, t1, quantity. Moves after t0 and up to t1 count.

    Both sides go through one running sum; no move is joined with intervals."""
    both = moves.select("station_id", "t", "delta", F.lit(None).cast("long").alias("bikes"), F.lit(0).alias("_k"))
    both = both.unionByName(checks.select("station_id", "t", F.lit(0).cast("long").alias("delta"), F.col("bikes").cast("long").alias("bikes"), F.lit(1).alias("_k")))
    seen = running(both, ["station_id"], ties=("_k",)).where("_k = 1").select("station_id", "t", "bikes", "total")
    w = W.partitionBy("station_id").orderBy("t")  # over checkpoints alone
    nxt = {f"{c}1": F.lead(c).over(w) for c in ("t", "bikes", "total")}
    gap = seen.withColumns(nxt).where("t1 is not null")
    quantity = (F.col("bikes1") - F.col("bikes")) - (F.col("total1") - F.col("total"))
    return gap.select("station_id", F.col("t").alias("t0"), "t1", quantity.alias("quantity"))


def replay_timings(checks: DataFrame, moves: DataFrame, least: int = 1) -> DataFrame:
    """Per station and timing: empty_s and negative_s (seconds with no bike, with fewer than none), lowest, and end_error,
    how far the replayed stock is from the last checkpoint.

    Stock starts at the first checkpoint and is not clamped. Unexplained movement of `least` bikes or more is applied at
    its interval's start, midpoint or end, before moves of the same second; less counts as noise. Returns come before
    rentals of the same second. All timings are replayed in one pass: a change is a row per timing."""
    last = F.max(F.struct("t", "bikes"))
    span = checks.groupBy("station_id").agg(F.min(F.struct("t", "bikes")).alias("a"), last.alias("z"))
    span = span.select("station_id", F.col("a.t").alias("w0"), F.col("a.bikes").alias("b0"), F.col("z.t").alias("w1"), F.col("z.bikes").alias("b1"))
    every = F.explode(F.array(*[F.struct(F.lit(n).alias("timing"), F.lit(h).alias("halves")) for n, h in TIMINGS.items()])).alias("_t")
    gaps = unexplained(checks, moves).where(F.abs("quantity") >= least).select("*", every).select("station_id", "t0", "t1", "quantity", "_t.*")
    at = F.col("t0") + F.floor((F.col("t1") - F.col("t0")) * F.col("halves") / 2)
    changes = gaps.select("station_id", "timing", at.alias("t"), F.lit(0).alias("prio"), F.col("quantity").alias("delta"))
    inside = moves.join(span, "station_id").where("t > w0 and t <= w1")
    prio = F.when(F.col("delta") > 0, 1).otherwise(2)
    changes = changes.unionByName(inside.select("station_id", every, "t", prio.alias("prio"), F.col("delta").cast("long").alias("delta")).select("station_id", "_t.timing", "t", "prio", "delta"))
    opening = span.select("station_id", every, F.col("w0").alias("t"), F.lit(-1).alias("prio"), F.col("b0").cast("long").alias("delta"))
    changes = changes.unionByName(opening.select("station_id", "_t.timing", "t", "prio", "delta"))
    rows = running(changes, ["station_id", "timing"], ties=("prio",)).join(span.select("station_id", "w1", "b1"), "station_id")
    held = F.coalesce("next_at", "w1") - F.col("t")
    spent = lambda when: F.coalesce(F.sum(F.when(when, held)), F.lit(0).cast("long"))
    figures = {"empty_s": spent(F.col("total") <= 0), "negative_s": spent(F.col("total") < 0), "lowest": F.min("total"), "_end": F.sum("delta"), "_b1": F.max("b1")}
    out = rows.groupBy("station_id", "timing").agg(*[v.alias(k) for k, v in figures.items()])
    return out.select("station_id", "timing", "empty_s", "negative_s", "lowest", F.abs(F.col("_end") - F.col("_b1")).alias("end_error"))
