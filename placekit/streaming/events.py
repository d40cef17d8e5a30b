"""Streaming extension: windowed counts of a stream of events, late rows bounded by a watermark."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, event_type, n, total for each window; the same plan over a batch or a stream."""
    seen = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    sums = seen.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return sums.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")
