"""Running statistics over an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def activity_counts(stream: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events and cases per activity and window of ts; rows later than ``late`` are dropped by the watermark."""
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", window), "act")
    return w.agg(F.count("*").alias("events"), F.approx_count_distinct("case").alias("cases")).select(F.col("window.start").alias("from"), "act", "events", "cases")


def arrivals(stream: DataFrame, gap: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Sessions of a case: runs of events with no pause of ``gap``."""
    return stream.withWatermark("ts", late).groupBy("case", F.session_window("ts", gap)).agg(F.count("*").alias("events")).select("case", F.col("session_window.start").alias("from"), F.col("session_window.end").alias("to"), "events")
