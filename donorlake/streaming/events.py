"""Windowed counts of an event stream with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly(events: DataFrame, late: str | None = "2 hours") -> DataFrame:
    """(hour, event_type, n, total) by tumbling hour; on a stream rows later than ``late`` are left out."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming and late:
        rows = rows.withWatermark("ts", late)
    got = rows.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return got.select(F.col("w.start").alias("hour"), "event_type", "n", "total")
