"""Column expressions that several operators share; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_MINUTE, MICROS_PER_DAY = 60_000_000, 86_400_000_000


def micros(start: Column, end: Column) -> Column:
    """Microseconds from one zone-free timestamp to another."""
    return F.timestamp_diff("MICROSECOND", start, end)


def percent_or_zero(part: Column, whole: Column) -> Column:
    """`part` of `whole` in per cent; 0 if `whole` isn't positive."""
    return F.when(whole > 0, part * 100.0 / whole).otherwise(0.0)


def count_event(name: str, event: str = "event") -> Column:
    return F.count_if(F.col(event) == name)


def user_type(views: Column, carts: Column, transactions: Column) -> Column:
    """The furthest step of a user."""
    return F.when(transactions > 0, "buyer").when(carts > 0, "cart_user").when(views > 0, "browser").otherwise("inactive")


def session_pattern(event: Column) -> Column:
    """Aggregate: the furthest step of a session, by substrings of event names."""
    has = lambda name: F.coalesce(F.bool_or(F.contains(event, F.lit(name))), F.lit(False))
    return F.when(has("transaction"), "conversion").when(has("addtocart"), "cart_only").otherwise("view_only")


def popularity(views: Column, carts: Column, transactions: Column) -> Column:
    return views + 3 * carts + 10 * transactions


def conversion_rate(views: Column, transactions: Column) -> Column:
    """Transactions per view in per cent; no view counts as one."""
    return transactions * 100.0 / F.when(views == 0, 1).otherwise(views)


def is_outlier(value: Column, q1: Column, q3: Column, k: float = 1.5) -> Column:
    """Strictly outside the fences of the interquartile range."""
    return (value < q1 - k * (q3 - q1)) | (value > q3 + k * (q3 - q1))
