"""Expressions are plain projections, so they run on streams unchanged; windows over event time are Spark's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_events(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A stream of the Parquet files of a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def _timed(events: DataFrame, time: str, late: str) -> tuple[T.DataType, DataFrame]:
    """The type of the time column, and the rows with a watermark on it if they are a stream: that needs instants."""
    kind = events.schema[time].dataType
    if events.isStreaming:
        events = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return kind, events


def windowed(events: DataFrame, *, time: str = "ts", by: str = "event_type", value: str = "value", size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Count and sum of each window of event time, from rows at most `late` behind the latest; batch or stream."""
    kind, events = _timed(events, time, late)
    grouped = events.groupBy(F.window(time, size).alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return grouped.select(F.col("w.start").cast(kind).alias("start"), by, "n", "total")


def sessions(events: DataFrame, *, time: str = "ts", by: str = "user_id", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Count of each session: events of a key no more than `gap` apart."""
    kind, events = _timed(events, time, late)
    grouped = events.groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count("*").alias("n"))
    return grouped.select(F.col("w.start").cast(kind).alias("start"), by, "n")


def run_available(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> None:
    """Write what is there to Parquet, and stop."""
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(folder).awaitTermination()
