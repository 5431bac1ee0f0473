"""Item properties: counts, category mapping, availability, events by category."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def category_mapping(properties: DataFrame, latest_by: str | None = None) -> DataFrame:
    """itemid and categoryid of every `categoryid` row, repeats kept; with `latest_by`, an item's last row only.

    A value that is no number gives a null category.
    """
    rows = properties.filter("property = 'categoryid'")
    value = F.col("value").try_cast("bigint")
    if latest_by is None:
        return rows.select("itemid", value.alias("categoryid"))
    return rows.groupBy("itemid").agg(F.max_by(value, F.struct(F.col(latest_by), value)).alias("categoryid"))


def mapping_summary(mapping: DataFrame) -> DataFrame:
    return mapping.agg(F.count("*").alias("n_rows"), F.count_distinct("itemid").alias("unique_items"), F.count_distinct("categoryid").alias("unique_categories"))


def unparsed_values(properties: DataFrame) -> DataFrame:
    """property and n: values of `categoryid` and `available` rows that are no number, which the analyses take as null."""
    typed = properties.filter(F.col("property").isin("categoryid", "available"))
    return typed.groupBy("property").agg(F.count_if(F.col("value").isNotNull() & F.col("value").try_cast("bigint").isNull()).alias("n"))


def availability(properties: DataFrame) -> DataFrame:
    """Per cent of `available` rows whose value is 1; null if there are none."""
    return properties.filter("property = 'available'").agg((F.avg((F.col("value").try_cast("int") == 1).cast("int")) * 100).alias("available_pct"))


def with_category(events: DataFrame, mapping: DataFrame) -> DataFrame:
    """Events with the categories of their items; an item with several multiplies its events, one without has null."""
    return events.join(mapping, "itemid", "left")


def category_event_counts(events: DataFrame, mapping: DataFrame) -> DataFrame:
    """Events of each category. Events are counted by item first, so the join's rows are items, not events."""
    return category_counts(events.filter("itemid IS NOT NULL").groupBy("itemid").agg(F.count("*").alias("c")), mapping)


def category_counts(items: DataFrame, mapping: DataFrame) -> DataFrame:
    """`category_event_counts` of a row with its count `c` for each item."""
    return items.join(mapping.filter("categoryid IS NOT NULL"), "itemid").groupBy("categoryid").agg(F.sum("c").alias("n"))
