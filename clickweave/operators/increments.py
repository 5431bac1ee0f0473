"""Distinct counts that merge: a state for each day, from which the figures of any set of days follow exactly without their events.

A state row has the bits of one stretch of 32,768 ids. States of days are merged by OR, so a day is added, or redone, by writing its own states
alone. Ids should be dense, as a stretch takes 4 KB however few ids are in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def day_states(events: DataFrame, by: str = "itemid", of: str = "visitorid") -> DataFrame:
    """day, `by`, stretch, n and bits: events and the distinct `of` ids of each day and `by`; rows without either, or a time, have no part.

    Made with map-side combination; to be written by day (``partitionBy("day")``).
    """
    rows = events.filter(F.col(by).isNotNull() & F.col(of).isNotNull() & F.col("ts").isNotNull())
    return rows.groupBy(F.to_date("ts").alias("day"), by, F.bitmap_bucket_number(of).alias("stretch")).agg(F.count("*").alias("n"), F.bitmap_construct_agg(F.bitmap_bit_position(of)).alias("bits"))


def merged(states: DataFrame, by: str = "itemid") -> DataFrame:
    """`by`, n_events and n_distinct over all days of `states`."""
    stretches = states.groupBy(by, "stretch").agg(F.sum("n").alias("n"), F.bitmap_or_agg("bits").alias("bits"))
    return stretches.groupBy(by).agg(F.sum("n").alias("n_events"), F.sum(F.bitmap_count("bits")).alias("n_distinct"))
