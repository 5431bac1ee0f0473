"""Item features: counts, popularity, conversion, categories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickweave.functions.columns import conversion_rate, count_event, popularity


def item_stats(events: DataFrame) -> DataFrame:
    """One row an item: visitors, events, first and last time, counts of the three steps, popularity, conversion."""
    found = events.filter("itemid IS NOT NULL").groupBy("itemid").agg(
        F.count_distinct("visitorid").alias("unique_users"), F.count("event").alias("total_events"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
        count_event("view").alias("view_count"), count_event("addtocart").alias("addtocart_count"), count_event("transaction").alias("transaction_count"),
    )
    return with_scores(found)


def with_scores(found: DataFrame) -> DataFrame:
    views, carts, sales = (F.col(f"{e}_count") for e in ("view", "addtocart", "transaction"))
    return found.withColumns({"popularity_score": popularity(views, carts, sales), "conversion_rate": conversion_rate(views, sales)})


def item_features(events: DataFrame, mapping: DataFrame) -> DataFrame:
    """`item_stats` with categories; an item with several has a row for each."""
    return with_categories(item_stats(events), mapping)


def with_categories(stats: DataFrame, mapping: DataFrame) -> DataFrame:
    return stats.join(mapping, "itemid", "left")


def features_summary(features: DataFrame) -> DataFrame:
    return features.agg(F.count("*").alias("total_items_analyzed"), F.count("categoryid").alias("items_with_category"))


def top_by_popularity(features: DataFrame, top: int = 20) -> DataFrame:
    return features.select("itemid", "popularity_score", "conversion_rate", "categoryid").orderBy(F.desc("popularity_score"), "itemid", F.asc_nulls_last("categoryid")).limit(top)


def category_stats(features: DataFrame, top: int | None = None) -> DataFrame:
    found = features.filter("categoryid IS NOT NULL").groupBy("categoryid").agg(F.avg("popularity_score").alias("avg_popularity"), F.avg("conversion_rate").alias("avg_conversion_rate"), F.avg("unique_users").alias("avg_unique_users"), F.count("itemid").alias("item_count"))
    return found if top is None else found.orderBy(F.desc("avg_popularity"), "categoryid").limit(top)
