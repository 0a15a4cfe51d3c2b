"""Streams of events: session merging with late data, and running pileup counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, key: str, time: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """key, st, en, n: events of a key at most `gap` apart are one session; the time analogue of merging intervals. Works on streams and tables."""
    rows = events.withColumn("_t", F.col(time).cast("timestamp"))
    rows = rows.withWatermark("_t", late) if events.isStreaming else rows
    out = rows.groupBy(key, F.session_window("_t", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("st"), F.col("w.end").alias("en"), "n")


def tumbling_counts(events: DataFrame, keys: list[str], time: str, width: str, late: str = "10 minutes") -> DataFrame:
    """keys, st, n, total: counts and sums of `value` by tumbling windows."""
    rows = events.withColumn("_t", F.col(time).cast("timestamp"))
    rows = rows.withWatermark("_t", late) if events.isStreaming else rows
    out = rows.groupBy(*keys, F.window("_t", width).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(*keys, F.col("w.start").alias("st"), "n", "total")
