"""Segments that arrive as a stream, kept as tumbling windows of output positions.

A watermark on the arrival time bounds the state; counts of a window are final once it has passed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_counts(stream: DataFrame, time: str = "ts", keys: tuple[str, ...] = ("event_type",), size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows and summed values per key and tumbling window; works on batches and streams alike."""
    rows = stream.withColumn(time, F.col(time).cast("timestamp"))
    rows = rows.withWatermark(time, late) if stream.isStreaming else rows
    counted = rows.groupBy(F.window(time, size).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("start"), *keys, "n", "total")
