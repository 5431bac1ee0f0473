"""Scans: the canonical clickstream tables from CSV files, and from the star-schema parquet tables.

Canonical columns: events (event_id, ts, visitorid, event, itemid), item properties (itemid, property, value) and the
category tree (categoryid, parentid). Times are zone-free timestamps in UTC, so no session setting shifts them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from clickweave.shared import scratch

EVENTS_CSV = "timestamp BIGINT, visitorid BIGINT, event STRING, itemid BIGINT"
PROPERTIES_CSV = "itemid BIGINT, property STRING, value STRING"
TREE_CSV = "categoryid BIGINT, parentid BIGINT"
#: The three event types that the analyses name; others pass through.
EVENT_TYPES = ("view", "addtocart", "transaction")
#: Milliseconds since 1970 of the first and the last moment of the years 1 to 9999; a `timestamp` beyond is rejected.
FIRST_MS, LAST_MS = -62_135_596_800_000, 253_402_300_799_999
#: Id ranges of the tree that is made of regions, nations and suppliers.
REGION_ID, NATION_ID, SUPPLIER_ID = 1_000_000_000, 2_000_000_000, 3_000_000_000


def from_epoch_ms(ms: Column | str) -> Column:
    """Milliseconds since 1970 as a zone-free UTC timestamp; null outside the years 1 to 9999."""
    name = ms if isinstance(ms, str) else ms._jc.toString()
    return F.expr(f"CASE WHEN {name} BETWEEN {FIRST_MS} AND {LAST_MS} THEN timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, CAST({name} / 1000BD AS DECIMAL(18, 6))) END")


def by_name(spark: SparkSession, path: str, wanted: str) -> DataFrame:
    """The wanted columns (a DDL schema) of the CSV files at one path as strings, looked up by the header, whatever its order and further columns.

    Files below one path must have the same header; Spark checks each. Rows keep `_metadata`.
    """
    read = spark.read.option("header", True).option("enforceSchema", False)
    header = read.csv(path).columns
    names = [f.name for f in StructType.fromDDL(wanted).fields]
    missing = [n for n in names if n not in header]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}; its header is {', '.join(header)}")
    rows = read.schema(StructType([StructField(n, StringType()) for n in header])).csv(path)
    return rows.select(*[f"`{n}`" for n in names], F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))


def accepted(field: StructField) -> Column:
    """A field in its type: null if it doesn't parse or, for a `timestamp`, is out of range (see `unparsed` and `rejected`)."""
    value = F.col(field.name).try_cast(field.dataType)
    return F.when(value.between(FIRST_MS, LAST_MS), value) if field.name == "timestamp" else value


def typed(rows: DataFrame, wanted: str) -> list[Column]:
    return [accepted(f).alias(f.name) for f in StructType.fromDDL(wanted).fields]


def csv_table(spark: SparkSession, paths: Sequence[str], wanted: str) -> DataFrame:
    parts = [by_name(spark, p, wanted) for p in paths]
    return reduce(DataFrame.unionByName, [p.select(*typed(p, wanted)) for p in parts])


def unparsed(spark: SparkSession, wanted: str, *paths: str) -> DataFrame:
    """column_name and n of every wanted column: fields that aren't empty and don't parse or are out of range, which the scans read as null."""
    kinds = StructType.fromDDL(wanted).fields
    rows = reduce(DataFrame.unionByName, [by_name(spark, p, wanted) for p in paths])
    one = rows.agg(*[F.count_if(F.col(f.name).isNotNull() & accepted(f).isNull()).alias(f.name) for f in kinds])
    return one.select(F.explode(F.array(*[F.struct(F.lit(f.name).alias("column_name"), F.col(f.name).alias("n")) for f in kinds])).alias("x")).select("x.*")


def rejected(spark: SparkSession, wanted: str, *paths: str) -> DataFrame:
    """A row for each fault of the files: file, record (of a ragged row), column_name, field and reason.

    Reasons: `not <type>` and `out of range`, for a field that the scans read as null; `ragged`, for a row with fewer or more fields than the
    header, of which the scans take the fields that it has. One pass over the files; meant to be written beside the accepted rows.
    """
    kinds = StructType.fromDDL(wanted).fields
    found = []
    for path in paths:
        read = spark.read.option("header", True).option("enforceSchema", False)
        header = read.csv(path).columns
        rows = read.option("columnNameOfCorruptRecord", "_bad").schema(StructType([StructField(n, StringType()) for n in (*header, "_bad")])).csv(path)
        faults = [F.when(F.col("_bad").isNotNull(), F.struct(F.lit(None).cast("string").alias("column_name"), F.lit(None).cast("string").alias("field"), F.lit("ragged").alias("reason")))]
        for f in kinds:
            parsed = F.col(f.name).try_cast(f.dataType)
            reason = F.when(parsed.isNull(), f"not {f.dataType.simpleString()}").otherwise("out of range")
            faults.append(F.when(F.col(f.name).isNotNull() & accepted(f).isNull(), F.struct(F.lit(f.name).alias("column_name"), F.col(f.name).alias("field"), reason.alias("reason"))))
        each = F.explode(F.filter(F.array(*faults), lambda x: x.isNotNull()))
        found.append(rows.select(F.col("_metadata.file_path").alias("file"), F.col("_bad").alias("record"), each.alias("x")).select("file", "record", "x.*"))
    return reduce(DataFrame.unionByName, found)


def csv_events(spark: SparkSession, *paths: str) -> DataFrame:
    """Events of CSV files with a header; columns are found by name and further ones are ignored.

    event_id orders the rows as the files have them, files in the order of `paths`: it breaks ties of time as reading in order would.
    """
    parts = []
    for i, path in enumerate(paths):
        rows = by_name(spark, path, EVENTS_CSV)
        event_id = F.struct(F.lit(i).alias("path"), F.col("_file").alias("file"), F.col("_start").alias("start"), F.monotonically_increasing_id().alias("row"))
        parts.append(rows.select(event_id.alias("event_id"), *typed(rows, EVENTS_CSV)))
    raw = reduce(DataFrame.unionByName, parts)
    return raw.select("event_id", from_epoch_ms("timestamp").alias("ts"), "visitorid", "event", "itemid")


def csv_item_properties(spark: SparkSession, *paths: str, timed: bool = False) -> DataFrame:
    """The union of all property files; `timed` adds their `timestamp`, for mappings by the latest row."""
    return csv_table(spark, paths, ("timestamp BIGINT, " if timed else "") + PROPERTIES_CSV)


def csv_category_tree(spark: SparkSession, *paths: str) -> DataFrame:
    return csv_table(spark, paths, TREE_CSV)


def csv_copy(df: DataFrame) -> str:
    """`df` written as CSV files with a header, below the shared folder; the path."""
    path = scratch(df.sparkSession, "csv")
    df.write.option("header", True).csv(path)
    return path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table: users are visitors, the number in props is the item."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.col("user_id").alias("visitorid"),
        F.when(kind == "click", "addtocart").when(kind == "purchase", "transaction").otherwise(kind).alias("event"),
        F.get_json_object("props", "$.k").cast("bigint").alias("itemid"),
    )


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as events of customers."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("event_id"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("ts"),
        F.col("o_custkey").alias("visitorid"),
        F.lit("transaction").alias("event"),
        F.col("l_partkey").alias("itemid"),
    )


def item_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as (item, property, value) rows; every part has two categories, its size and its brand."""
    part = table(spark, sf_dir, "part")
    first = part.select(F.col("p_partkey").alias("itemid"), F.stack(F.lit(2), F.lit("categoryid"), F.col("p_size").cast("string"), F.lit("available"), (F.col("p_size") % 2).cast("string")).alias("property", "value"))
    second = part.select(F.col("p_partkey").alias("itemid"), F.lit("categoryid").alias("property"), (F.regexp_extract("p_brand", r"(\d+)", 1).cast("int") + 100).cast("string").alias("value"))
    return first.unionByName(second)


def category_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions over nations over suppliers."""
    region = table(spark, sf_dir, "region").select((F.col("r_regionkey").cast("bigint") + REGION_ID).alias("categoryid"), F.lit(None).cast("bigint").alias("parentid"))
    nation = table(spark, sf_dir, "nation").select((F.col("n_nationkey").cast("bigint") + NATION_ID).alias("categoryid"), (F.col("n_regionkey").cast("bigint") + REGION_ID).alias("parentid"))
    supplier = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + SUPPLIER_ID).alias("categoryid"), (F.col("s_nationkey").cast("bigint") + NATION_ID).alias("parentid"))
    return region.unionByName(nation).unionByName(supplier)
