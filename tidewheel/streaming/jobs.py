"""Structured Streaming jobs over a folder of Parquet files, each with the result of its batch twin.

A job runs with trigger(availableNow) and writes to the shared folder: file sources and sinks keep their own
progress in the checkpoint, so a restarted job goes on where it stopped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import work_folder


#: Rows of a replayed file.
ROWS_PER_FILE = 1_000_000


def replay(spark: SparkSession, df: DataFrame, files: int = 4, order: str = "ts") -> DataFrame:
    """df as a stream in order of time: slices of about equal size are written one after the other to the shared folder,
    each in as many files as its rows ask for, and a micro-batch takes that many files."""
    path, at = work_folder(spark, "stream-input"), F.unix_timestamp(F.col(order))
    per_slice = max(1, -(-df.count() // (files * ROWS_PER_FILE)))
    cuts = df.select(at.cast("double").alias("t")).approxQuantile("t", [k / files for k in range(1, files)], 0.01) if files > 1 else []
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = df if low is None else df.where(at > low)
        part = part if high is None else part.where(at <= high)
        part.repartition(per_slice).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", per_slice).parquet(path)


def finished(stream: DataFrame, name: str) -> DataFrame:
    """Runs an append stream to the end of its input and reads what it wrote."""
    spark = stream.sparkSession
    out = work_folder(spark, name)
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-progress").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def tick_counts(stream: DataFrame, width: str = "5 minutes", slide: str | None = None, late: str = "40 minutes") -> DataFrame:
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return stream.withWatermark("ts", late).groupBy(w.alias("w"), "station").agg(F.count("*").alias("n"), F.sum("v").alias("v"))


def window_trends(stream: DataFrame, width: int = 1500, slide: int = 300, late: str = "40 minutes") -> DataFrame:
    """Least-squares slope of v per minute in sliding windows: station, start_s, n, slope.

    The state of a window is five whole numbers (n and the sums of x, y, xy and xx, x in seconds from the window's
    start), so partial sums merge without rounding. Only windows with a row in their last slide, the anchor's, are
    given; the slope of a single time is null."""
    rows = stream.withWatermark("ts", late).withColumn("w", F.window("ts", f"{width} seconds", f"{slide} seconds"))
    x = F.unix_timestamp("ts") - F.unix_timestamp("w.start")
    sums = {"n": F.count("*"), "sx": F.sum(x), "sy": F.sum("v"), "sxy": F.sum(x * F.col("v")), "sxx": F.sum(x * x), "newest": F.max(x)}
    state = rows.groupBy("w", "station").agg(*[v.alias(k) for k, v in sums.items()])
    n, sx, sy, sxy, sxx = (F.col(c).cast("double") for c in ("n", "sx", "sy", "sxy", "sxx"))
    slope = F.lit(60.0) * (n * sxy - sx * sy) / F.nullif(n * sxx - sx * sx, F.lit(0.0))
    return state.where(F.col("newest") >= width - slide).select("station", F.unix_timestamp("w.start").alias("start_s"), "n", slope.alias("slope"))


def deduplicated(stream: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def merged_state(stream: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Mean per key from mergeable partial sums: each micro-batch writes its partials under its own number.

    A repeated batch replaces its own file, so the state is exact once."""
    spark = stream.sparkSession
    out = work_folder(spark, name)

    def put(batch: DataFrame, number: int) -> None:
        batch.groupBy(*keys).agg(F.sum(value).alias("total"), F.count(value).alias("n")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{out}-progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy(*keys).agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def newest(stream: DataFrame, keys: list[str], generation: str, name: str) -> DataFrame:
    """The newest generation per key over all micro-batches; an older one that comes late loses."""
    spark = stream.sparkSession
    out = work_folder(spark, name)
    best = lambda df: df.groupBy(*keys).agg(F.max(F.struct(generation, "event_id")).alias("x"))

    def put(batch: DataFrame, number: int) -> None:
        best(batch).select(*keys, "x.*").write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{out}-progress").trigger(availableNow=True).start().awaitTermination()
    return best(spark.read.parquet(out)).select(*keys, "x.*")
