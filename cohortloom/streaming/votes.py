"""Per-subject votes over event time, the same code for batch and stream. An addition of this library, not a parity item."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, length: str = "1 hour", late: str = "1 hour", by: str = "event_type") -> DataFrame:
    """(start, by, n, total) in tumbling windows of `ts`; in a stream, rows later than `late` are dropped."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.window("ts", length), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n) of sessions split by gaps."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
