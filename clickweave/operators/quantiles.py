"""Exact quantiles of whole columns, without one task that holds them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickweave.shared import discard, stored


def exact_quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """One row with a column ``{column}_{k}`` for each column and k-th share, interpolated linearly; null without values.

    Equal values are counted first and dealt over ranges; sums of the ranges tell which of them hold the wanted ranks, and only these
    are ordered. So a task has one range at most, however the values are distributed. Runs at once: the row is local, and what led to it is deleted.
    """
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("x.*").filter("v IS NOT NULL")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(long.groupBy("c", "v").agg(F.count("*").alias("k")).repartitionByRange(n, "c", "v").withColumn("p", F.spark_partition_id()))
    parts = dealt.groupBy("c", "p").agg(F.sum("k").alias("k"))  # a row for each range
    whole = Window.partitionBy("c")
    parts = parts.select("c", "p", (F.sum("k").over(whole.orderBy("p")) - F.col("k")).alias("before"), "k", F.sum("k").over(whole).alias("total"))
    place = (F.col("total") - 1) * F.col("share")
    shared = F.explode(F.array(*[F.struct(F.lit(k).alias("q"), F.lit(float(s)).alias("share")) for k, s in enumerate(shares)])).alias("s")
    ranks = parts.select("*", shared).select("c", "p", "before", "k", "s.*", "total").select("c", "p", "before", "k", "q", place.alias("place"), F.explode(F.array(F.floor(place), F.ceil(place))).alias("rank"))
    ranks = ranks.filter((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("k"))).drop("k").distinct()
    ordered = Window.partitionBy("c", "p").orderBy("v")
    inner = dealt.join(F.broadcast(ranks.select("c", "p").distinct()), ["c", "p"]).select("c", "p", "v", "k", (F.sum("k").over(ordered) - F.col("k")).alias("inside"))
    at = inner.join(F.broadcast(ranks), ["c", "p"]).filter((F.col("rank") >= F.col("before") + F.col("inside")) & (F.col("rank") < F.col("before") + F.col("inside") + F.col("k")))
    both = at.groupBy("c", "q").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.max("place").alias("place"))
    value = F.col("low") + (F.col("high") - F.col("low")) * (F.col("place") - F.floor("place"))
    names = [f"{c}_{k}" for c in columns for k in range(len(shares))]
    one = both.agg(*[F.max(F.when((F.col("c") == c) & (F.col("q") == k), value)).alias(f"{c}_{k}") for c in columns for k in range(len(shares))]).first()
    discard(dealt)
    return df.sparkSession.createDataFrame([tuple(one)], ", ".join(f"`{n}` double" for n in names))
