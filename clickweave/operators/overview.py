"""Event log: overview, counts, funnel, time profile, concentration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickweave.functions.columns import MICROS_PER_DAY, count_event, micros, percent_or_zero


def enrich(events: DataFrame) -> DataFrame:
    """Events with date, hour, dayofweek (Monday is 0) and the day's full name."""
    return events.withColumns({"date": F.to_date("ts"), "hour": F.hour("ts"), "dayofweek": F.weekday("ts"), "day_name": F.date_format("ts", "EEEE")})


def footprint(df: DataFrame) -> float:
    """Megabytes, to two digits, that the optimizer takes the table to have; no job runs. It depends on format and session."""
    return round(int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) / 1e6, 2)


def dataset_shape(df: DataFrame, name: str) -> DataFrame:
    """dataset, n_rows, n_columns and column_names."""
    return df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("dataset"), "n_rows", F.lit(len(df.columns)).alias("n_columns"), F.lit(",".join(df.columns)).alias("column_names"))


def null_percentages(df: DataFrame) -> DataFrame:
    """column_name and null_pct of every column, in one pass; null for an empty table."""
    one = df.agg(*[(F.avg(F.col(f"`{c}`").isNull().cast("int")) * 100).alias(f"c{i}") for i, c in enumerate(df.columns)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"c{i}").alias("null_pct")) for i, c in enumerate(df.columns)])).alias("x")).select("x.*")


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Rows of each non-null value, as n; with `top`, the commonest, ties by value."""
    found = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return found if top is None else found.orderBy(F.desc("n"), column).limit(top)


def conversion_funnel(events: DataFrame) -> DataFrame:
    return funnel_rates(events.agg(count_event("view").alias("views"), count_event("addtocart").alias("carts"), count_event("transaction").alias("transactions")))


def funnel_rates(counted: DataFrame) -> DataFrame:
    views, carts, sales = F.col("views"), F.col("carts"), F.col("transactions")
    return counted.select("*", percent_or_zero(carts, views).alias("view_to_cart_rate"), percent_or_zero(sales, carts).alias("cart_to_transaction_rate"), percent_or_zero(sales, views).alias("view_to_transaction_rate"))


def time_span(events: DataFrame) -> DataFrame:
    """first_ts, last_ts and whole days between them."""
    return span_days(events.agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")))


def span_days(ends: DataFrame) -> DataFrame:
    return ends.select("*", F.floor(micros(F.col("first_ts"), F.col("last_ts")) / F.lit(MICROS_PER_DAY)).cast("bigint").alias("n_days"))


def per_period(events: DataFrame, *columns: str) -> DataFrame:
    return enrich(events).filter(F.col(columns[0]).isNotNull()).groupBy(*columns).agg(F.count("event").alias("n"))


def daily_average(events: DataFrame) -> DataFrame:
    """Mean number of events of the days that have any."""
    return per_period(events, "date").agg(F.avg("n").alias("avg_daily_events"))


def visitor_item_summary(events: DataFrame) -> DataFrame:
    """Visitors, events, items and events a visitor. Each distinct count folds its own column first, so no row is multiplied."""
    by_visitor = events.groupBy("visitorid").agg(F.count("*").alias("n")).agg(F.count("visitorid").alias("unique_visitors"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_events"))
    by_item = events.groupBy("itemid").agg(F.lit(1)).agg(F.count("itemid").alias("unique_items"))
    found = by_visitor.join(F.broadcast(by_item), F.lit(True))  # one row each
    return found.withColumn("avg_events_per_visitor", F.try_divide(F.col("total_events").cast("double"), F.col("unique_visitors")))


def concentration(events: DataFrame, fraction: float = 0.01) -> DataFrame:
    """Share, in per cent, of the views that the most viewed `fraction` of items have; the number of items is truncated.

    Items are folded into a histogram of their view counts, so nothing is sorted as a whole: a count is a bin, and bins are few.
    """
    return concentration_of(events.filter("event = 'view' AND itemid IS NOT NULL").groupBy("itemid").agg(F.count("*").alias("c")), fraction)


def concentration_of(items: DataFrame, fraction: float = 0.01) -> DataFrame:
    """`concentration` of a row with its count `c` for each item."""
    bins = items.groupBy("c").agg(F.count("*").alias("k"))
    # bins are few: with n events, no more than the root of 2n
    every = Window.partitionBy()
    before = F.coalesce(F.sum("k").over(Window.orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = bins.select("c", "k", before.alias("before"), F.sum("k").over(every).alias("n"))
    top = F.floor(F.col("n") * F.lit(float(fraction))).cast("bigint")
    taken = F.greatest(F.lit(0), F.least(F.col("k"), top - F.col("before")))
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("bigint")
    found = ranked.agg(zero(F.max("n")).alias("n_items"), zero(F.max(top)).alias("n_top_items"), F.sum(F.col("c") * taken).alias("top_views"), F.sum(F.col("c") * F.col("k")).alias("views"))
    return found.select("n_items", "n_top_items", F.try_divide(F.col("top_views") * 100.0, F.col("views")).alias("concentration_ratio"))


def popularity_histogram(events: DataFrame, width: float = 0.1) -> DataFrame:
    """Items by the logarithm (base 10) of their number of events, in bins of `width`."""
    return histogram_of(events.filter("itemid IS NOT NULL").groupBy("itemid").agg(F.count("*").alias("c")), width)


def histogram_of(items: DataFrame, width: float = 0.1) -> DataFrame:
    """`popularity_histogram` of a row with its count `c` for each item."""
    return items.groupBy(F.floor(F.log10("c") / F.lit(width)).cast("bigint").alias("bin")).agg(F.count("*").alias("n_items"))
