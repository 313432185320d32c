"""Event-time windows for streams and tables alike (an extension: the same functions take either)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, watermark: str) -> DataFrame:
    """A stream needs a watermark, which needs a timestamp with time zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark) if events.isStreaming else events


def tumbling(events: DataFrame, width: str = "1 hour", watermark: str = "2 hours") -> DataFrame:
    e = _timed(events, watermark)
    return e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", watermark: str = "2 hours") -> DataFrame:
    e = _timed(events, watermark)
    return e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")
