"""Counts for the dynamic samplers on a live stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def key_counts(records: DataFrame, key: str, seconds: int, lateness: str) -> DataFrame:
    """key, interval, n by tumbling window; a window is given out once the watermark has passed it, and what comes later is not counted."""
    windowed = records.withWatermark("ts", lateness).groupBy(F.window("ts", f"{seconds} seconds").alias("w"), F.col(key).alias("key")).agg(F.count("*").alias("n"))
    return windowed.select("key", F.floor(F.unix_timestamp("w.start") / seconds).cast("long").alias("interval"), "n")
