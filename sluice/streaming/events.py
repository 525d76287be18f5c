"""Streaming twins of the batch operators on an event stream: windows, sessions, interval joins and deduplication, with
bounded state: all results are appended once the watermark has passed them, and their state goes.

Late rows are accepted within the watermark; what is older than that is dropped with its state. Each function takes and gives
a streaming frame, so sources and sinks are the caller's choice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.sources.tables import scratch

LATENESS = "6 days"


def stream(spark: SparkSession, folder: str, name: str = "events", files: int = 1) -> DataFrame:
    """The table as a stream of its files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def timed(events: DataFrame) -> DataFrame:
    """Watermarks need a timestamp with a zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATENESS)


def tumbling(events: DataFrame, width: str = "1 hour") -> DataFrame:
    found = timed(events).groupBy(F.window("ts", width)).agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    return found.select(F.col("window.start").alias("bucket"), "n", "cents")


def sliding(events: DataFrame, width: str = "2 hours", step: str = "1 hour") -> DataFrame:
    found = timed(events).groupBy(F.window("ts", width, step), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return found.select(F.col("window.start").alias("bucket"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    found = timed(events).groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"))
    return found.select("user_id", F.col("session_window.start").alias("first_ts"), "n")


def deduplicated(events: DataFrame, keys: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """The first row of each key within the watermark, in bounded state."""
    return timed(events).dropDuplicatesWithinWatermark(list(keys))


def interval_join(left: DataFrame, right: DataFrame, key: str, span: str) -> DataFrame:
    """Rows of ``left`` with the rows of ``right`` that have the same key and lie at most ``span`` before them; the columns of
    ``right`` get the prefix other_. Both watermarks and the bound on time let old rows of either side go."""
    late = timed(right).select(*[F.col(c).alias(f"other_{c}") for c in right.columns])
    near = (F.col(key) == F.col(f"other_{key}")) & F.expr(f"other_ts <= ts AND other_ts >= ts - INTERVAL {span}")
    return timed(left).join(late, near)


def closable(events: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """The stream, and what ends it: a last row far in the future moves the watermark past every window, so an append-mode
    result is complete though no state was kept for it. The row's own window stays open and is never given out."""
    spark = events.sparkSession
    path = scratch(spark, "stream-end")
    spark.createDataFrame([], events.schema).write.parquet(path)

    def close() -> None:
        end = spark.sql("SELECT TIMESTAMP_NTZ '2200-01-01 00:00:00' AS ts")
        end.select(*[(F.col("ts") if f.name == "ts" else F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema]).write.mode("append").parquet(path)

    return events.unionByName(spark.readStream.schema(events.schema).parquet(path)), close


def drained(df: DataFrame, close: Callable[[], None] | None = None) -> DataFrame:
    """What the stream gives for all that its source has now, in append mode, as a batch frame from a written table. ``close``:
    ends the stream, once all of it is read."""
    spark = df.sparkSession
    out, state = scratch(spark, "stream"), scratch(spark, "stream-state")
    for step in (None, close) if close else (None,):
        if step:
            step()
        df.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(out)
