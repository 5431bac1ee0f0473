"""User behaviour: event pivot, user types, favourite categories, activity, anomalies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickweave.functions.columns import MICROS_PER_DAY, count_event, is_outlier, micros, user_type
from .quantiles import exact_quantiles

METRICS = ("total_events", "unique_items", "daily_avg_events")


def event_pivot(events: DataFrame, *by: str) -> DataFrame:
    """Numbers of views, carts and transactions by visitor (or other columns), 0 where there are none."""
    by = by or ("visitorid",)
    return events.filter(F.col(by[0]).isNotNull()).groupBy(*by).agg(*[count_event(e).alias(e) for e in ("view", "addtocart", "transaction")])


def with_type(pivot: DataFrame) -> DataFrame:
    return pivot.withColumn("user_type", user_type(F.col("view"), F.col("addtocart"), F.col("transaction")))


def type_distribution(pivot: DataFrame) -> DataFrame:
    """Rows of each user type and their per cent; one row a type, so the total is a window over a few rows."""
    counts = with_type(pivot).groupBy("user_type").agg(F.count("*").alias("n"))
    return counts.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()))


def category_preference(events: DataFrame, mapping: DataFrame) -> DataFrame:
    """interaction_count of each visitor and category; events are counted by visitor and item before the join."""
    return pair_preference(events.filter("visitorid IS NOT NULL AND itemid IS NOT NULL").groupBy("visitorid", "itemid").agg(F.count("*").alias("c")), mapping)


def pair_preference(pairs: DataFrame, mapping: DataFrame) -> DataFrame:
    """`category_preference` of a row with its count `c` for each visitor and item."""
    return pairs.join(mapping.filter("categoryid IS NOT NULL"), "itemid").groupBy("visitorid", "categoryid").agg(F.sum("c").alias("interaction_count"))


def top_category(preference: DataFrame) -> DataFrame:
    """Each visitor's category with most interactions, ties to the smaller id; one aggregate, no sort."""
    best = preference.groupBy("visitorid").agg(F.max(F.struct("interaction_count", (-F.col("categoryid")).alias("minus"))).alias("b"))
    return best.select("visitorid", (-F.col("b.minus")).alias("categoryid"), F.col("b.interaction_count").alias("interaction_count"))


def users_with_preference(preference: DataFrame) -> DataFrame:
    return preference.agg(F.count_distinct("visitorid").alias("n_users"))


def activity(events: DataFrame) -> DataFrame:
    """Events, items, first and last time, days between and smoothed events a day, by visitor."""
    found = events.filter("visitorid IS NOT NULL").groupBy("visitorid").agg(F.count("event").alias("total_events"), F.count_distinct("itemid").alias("unique_items"), F.min("ts").alias("first_activity"), F.max("ts").alias("last_activity"))
    return with_daily(found)


def with_daily(found: DataFrame) -> DataFrame:
    found = found.withColumn("activity_days", micros(F.col("first_activity"), F.col("last_activity")) / F.lit(float(MICROS_PER_DAY)))
    return found.withColumn("daily_avg_events", F.col("total_events") / (F.col("activity_days") + 1))


def anomalies(stats: DataFrame, k: float = 1.5) -> DataFrame:
    """`stats` with an outlier flag for each metric, and their number as anomaly_score.

    Quartiles interpolate linearly over all users; they are one row. `stats` is read for the quartiles and for the flags, so give it stored.
    """
    quartiles = exact_quantiles(stats, METRICS, (0.25, 0.75))
    flagged = stats.join(F.broadcast(quartiles), F.lit(True)).withColumns({f"{m}_outlier": F.coalesce(is_outlier(F.col(m), F.col(f"{m}_0"), F.col(f"{m}_1"), k), F.lit(False)) for m in METRICS})
    score = sum((F.col(f"{m}_outlier").cast("int") for m in METRICS[1:]), F.col(f"{METRICS[0]}_outlier").cast("int"))
    return flagged.select(*stats.columns, *[f"{m}_outlier" for m in METRICS], score.alias("anomaly_score"))


def anomaly_summary(flagged: DataFrame, least: int = 2) -> DataFrame:
    found = flagged.agg(F.count("*").alias("total_users"), F.count_if(F.col("anomaly_score") >= least).alias("anomaly_users"))
    return found.withColumn("anomaly_ratio", F.try_divide(F.col("anomaly_users") * 100.0, F.col("total_users")))


def top_anomalies(flagged: DataFrame, least: int = 2, top: int = 10) -> DataFrame:
    return flagged.filter(F.col("anomaly_score") >= least).orderBy(F.desc("total_events"), "visitorid").limit(top)
