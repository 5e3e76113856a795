"""Event-time counts: the same transformation over a batch table and over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_counts(events: DataFrame, key: str = "event_type", ts: str = "ts", late: str | None = None, width: str = "1 day") -> DataFrame:
    """key, day, n: events of each key in tumbling windows. `late` sets a watermark, which a stream needs."""
    rows = events.select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("ts"))
    if late:
        rows = rows.withWatermark("ts", late)
    n = rows.groupBy("key", F.window("ts", width)).agg(F.count(F.lit(1)).alias("n"))
    return n.select("key", F.col("window.start").alias("day"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """user_id, start, end, n: runs of a user's events without a gap."""
    rows = events.select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    if late:
        rows = rows.withWatermark("ts", late)
    n = rows.groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"))
    return n.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
