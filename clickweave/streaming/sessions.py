"""Sessions over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickweave.functions.columns import session_pattern


def stream_sessions(events: DataFrame, gap_minutes: int = 30, delay: str = "10 minutes") -> DataFrame:
    """Sessions of a streaming (or batch) frame with visitorid, ts (timestamp), event.

    A gap of exactly `gap_minutes` stays in one session, as in batch. `delay` must cover the disorder of the stream: events
    that are later are dropped. The end is the last event's time, not the window's.
    """
    return (
        events.withWatermark("ts", delay)
        .groupBy("visitorid", F.session_window("ts", f"{gap_minutes} minutes").alias("w"))
        .agg(F.min("ts").alias("session_start"), F.max("ts").alias("session_end"), F.count("*").alias("event_count"), session_pattern(F.col("event")).alias("session_pattern"))
        .drop("w")
    )
