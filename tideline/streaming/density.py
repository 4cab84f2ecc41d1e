"""The activity series as a stream: hopping windows with a watermark, and exact per-key running state.

The batch operators see whole series; these give the same windows incrementally, and drop nothing that
is not later than the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hopping(events: DataFrame, size: str = "5 hours", slide: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(media_id, w_start, w_end, events, total) of a stream (or table) of events with a time ts."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    sums = timed.groupBy(F.window("ts", size, slide).alias("w"), F.col("event_type").alias("media_id")).agg(F.count("*").alias("events"), F.sum("value").alias("total"))
    return sums.select("media_id", F.col("w.start").alias("w_start"), F.col("w.end").alias("w_end"), "events", F.round("total", 4).alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, s_start, s_end, events): runs of a user's events that are no further apart than gap."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    runs = timed.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("events"))
    return runs.select("user_id", F.col("s.start").alias("s_start"), F.col("s.end").alias("s_end"), "events")
