"""All registered queries over the star-schema tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickweave.operators import figure, increments, items, overview, properties, sessions, tree, users
from clickweave.shared import stored
from clickweave.shipping import ship
from clickweave.sources import tables
from clickweave.sources.tables import category_tree, events, item_properties, purchases
from clickweave.streaming.stateful import ROCKSDB, stream_numbered

from .oracle import ORACLE_SQL as ORACLE_SQL  # noqa: PLC0414

#: Digits to which derived doubles are rounded, as summation order isn't fixed.
DIGITS = 6


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(F.col(f"`{c}`"), DIGITS).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def mapping(spark: SparkSession, d: str) -> DataFrame:
    return properties.category_mapping(item_properties(spark, d))


def marked(spark: SparkSession, d: str, gap: float = sessions.GAP_MINUTES) -> DataFrame:
    return sessions.sessionized(events(spark, d), gap)


def session_rows(spark: SparkSession, d: str, gap: float = sessions.GAP_MINUTES) -> DataFrame:
    return sessions.sessions(marked(spark, d, gap))


def preference(spark: SparkSession, d: str) -> DataFrame:
    return users.category_preference(events(spark, d), mapping(spark, d))


def features(spark: SparkSession, d: str) -> DataFrame:
    return items.item_features(events(spark, d), mapping(spark, d))


def dated_pivot(spark: SparkSession, d: str) -> DataFrame:
    return users.event_pivot(overview.enrich(events(spark, d)), "visitorid", "date")


def flagged(spark: SparkSession, d: str) -> DataFrame:
    return users.anomalies(stored(users.activity(purchases(spark, d))))


def shapes(spark: SparkSession, d: str) -> DataFrame:
    found = [overview.dataset_shape(f(spark, d), n) for n, f in (("events", events), ("item_properties", item_properties), ("category_tree", category_tree))]
    return found[0].unionByName(found[1]).unionByName(found[2])


def line_views(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as views of parts."""
    return tables.table(spark, d, "lineitem").select(F.lit("view").alias("event"), F.col("l_partkey").alias("itemid"))


def event_sequences(spark: SparkSession, d: str, gap: float = sessions.GAP_MINUTES) -> DataFrame:
    """A row for each session, with its whole sequences as text, which any engine prints alike; events without a visitor are those of one more."""
    # a struct is no null, so that the null visitor is a key like others
    found = events(spark, d).withColumn("visitorid", F.struct("visitorid"))
    return sessions.session_texts(sessions.sessionized(found, gap)).withColumn("visitorid", F.col("visitorid.visitorid"))


def csv_events(spark: SparkSession, d: str) -> DataFrame:
    """Events by way of CSV files in another order of columns and with one more, as milliseconds."""
    rows = events(spark, d).select("itemid", F.lit("x").alias("transactionid"), "event", "visitorid", (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("bigint").alias("timestamp"))
    return tables.csv_events(spark, tables.csv_copy(rows)).drop("event_id")


def csv_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of events by way of CSV files."""
    rows = events(spark, d).select((F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("bigint").alias("timestamp"), "visitorid", "event", "itemid")
    return sessions.length_distribution(sessions.sessions(sessions.sessionized(tables.csv_events(spark, tables.csv_copy(rows)))))


def csv_properties(spark: SparkSession, d: str) -> DataFrame:
    """Item properties by way of two CSV tables with other columns around theirs."""
    rows = item_properties(spark, d).select(F.lit(0).alias("timestamp"), "value", "itemid", "property")
    halves = [tables.csv_copy(rows.filter(F.col("itemid") % 2 == k)) for k in (0, 1)]
    return tables.csv_item_properties(spark, *halves)


def csv_unparsed(spark: SparkSession, d: str) -> DataFrame:
    """Fields of a CSV file of parts that are no whole numbers."""
    rows = tables.table(spark, d, "part").select(F.col("p_partkey").alias("itemid"), F.lit("categoryid").alias("property"), F.col("p_brand").alias("value"))
    return tables.unparsed(spark, "itemid BIGINT, value BIGINT", tables.csv_copy(rows))


def csv_rejected(spark: SparkSession, d: str) -> DataFrame:
    """Faults of a CSV file of events in which every 97th time is out of range, every 89th item no number and every 83rd row too long."""
    ms = (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("bigint")
    every = lambda n: F.col("event_id") % n == 0
    line = F.concat_ws(",", F.when(every(97), F.lit(2**63 - 1)).otherwise(ms), "visitorid", "event", F.when(every(89), "item").otherwise(F.col("itemid").cast("string")), F.when(every(83), "more"))
    path = tables.scratch(spark, "csv")
    # one column that holds whole lines, so that rows can be ragged
    events(spark, d).select(line.alias("timestamp,visitorid,event,itemid")).write.option("header", True).option("sep", "\u0001").option("quote", "").csv(path)
    return tables.rejected(spark, tables.EVENTS_CSV, path).groupBy("column_name", "field", "reason").agg(F.count("*").alias("n"))


def latest_mapping(spark: SparkSession, d: str) -> DataFrame:
    """Of each item's categories, that of its last row; here the larger id is the later row."""
    rows = item_properties(spark, d).withColumn("timestamp", F.length("value"))
    return properties.category_mapping(rows, "timestamp")


def streamed(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream, with their sessions numbered by state; those of the last millisecond still wait when the stream ends."""
    ship(spark)
    kind = "spark.sql.streaming.stateStore.providerClass"
    before, out = spark.conf.get(kind), tables.scratch(spark, "stream")
    # the stream's source is a folder of files
    source = tables.scratch(spark, "events")
    events(spark, d).withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    spark.conf.set(kind, ROCKSDB)
    try:
        query = stream_numbered(stream, delay="0 seconds").writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", tables.scratch(spark, "state")).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(kind, before)
    return spark.read.parquet(out).drop("ts")


def item_visitors_of_days(spark: SparkSession, d: str) -> DataFrame:
    """Visitors and events of each item from the states of days, written by day and read again."""
    folder = tables.scratch(spark, "days")
    increments.day_states(events(spark, d)).write.partitionBy("day").parquet(folder)
    return increments.merged(spark.read.parquet(folder))


PLANS = {
    "csv_events": csv_events,
    "csv_session_lengths": csv_sessions,
    "csv_item_properties": csv_properties,
    "csv_category_tree": lambda s, d: tables.csv_category_tree(s, tables.csv_copy(category_tree(s, d).select("parentid", "categoryid"))),
    "csv_unparsed_fields": csv_unparsed,
    "csv_rejected_records": csv_rejected,
    "unparsed_values": lambda s, d: properties.unparsed_values(item_properties(s, d)),
    "latest_category_mapping": latest_mapping,
    "session_sequence_blocks": lambda s, d: sessions.sequence_blocks(marked(s, d, 720), 4).select("visitorid", "session_id", "block", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"), F.array_join("events", ",").alias("events")),
    "dataset_shapes": shapes,
    "events_sample": lambda s, d: events(s, d).orderBy("event_id").limit(5),
    "null_percentages": lambda s, d: overview.null_percentages(events(s, d)),
    "event_type_counts": lambda s, d: overview.value_counts(events(s, d), "event"),
    "conversion_funnel": lambda s, d: overview.conversion_funnel(events(s, d)),
    "event_time_span": lambda s, d: overview.time_span(events(s, d)),
    "daily_event_counts": lambda s, d: overview.per_period(events(s, d), "date"),
    "daily_event_average": lambda s, d: overview.daily_average(events(s, d)),
    "hourly_event_counts": lambda s, d: overview.per_period(events(s, d), "hour"),
    "weekday_event_counts": lambda s, d: overview.per_period(events(s, d), "dayofweek", "day_name").withColumnRenamed("dayofweek", "weekday"),
    "visitor_item_summary": lambda s, d: overview.visitor_item_summary(events(s, d)),
    "top_items": lambda s, d: overview.value_counts(events(s, d), "itemid", 20),
    "longtail_concentration": lambda s, d: overview.concentration(line_views(s, d)),
    "item_popularity_histogram": lambda s, d: overview.popularity_histogram(line_views(s, d)),
    "property_counts": lambda s, d: overview.value_counts(item_properties(s, d), "property"),
    "category_item_counts": lambda s, d: overview.value_counts(mapping(s, d), "categoryid"),
    "category_mapping_summary": lambda s, d: properties.mapping_summary(mapping(s, d)),
    "availability_ratio": lambda s, d: properties.availability(item_properties(s, d)),
    "events_with_category": lambda s, d: properties.with_category(events(s, d), mapping(s, d)).select("event_id", "visitorid", "itemid", "event", "categoryid"),
    "category_event_counts": lambda s, d: properties.category_event_counts(events(s, d), mapping(s, d)),
    "top_categories": lambda s, d: properties.category_event_counts(events(s, d), mapping(s, d)).orderBy(F.desc("n"), "categoryid").limit(20),
    "tree_summary": lambda s, d: tree.tree_summary(category_tree(s, d)),
    "tree_root_depths": lambda s, d: tree.root_depths(category_tree(s, d)),
    "tree_children_counts": lambda s, d: tree.children_counts(category_tree(s, d), 10),
    "graph_degrees": lambda s, d: tree.degrees(category_tree(s, d)),
    "graph_trimmed_edges": lambda s, d: tree.trimmed_edges(category_tree(s, d)),
    "graph_trimmed_edges_50_20": lambda s, d: tree.trimmed_edges(category_tree(s, d), 50, 20),
    "graph_layout": lambda s, d: tree.layout(category_tree(s, d)),
    "graph_figure": lambda s, d: figure.figure(category_tree(s, d)),
    "graph_figure_3": lambda s, d: figure.figure(category_tree(s, d), shown=3),
    "graph_crossings": lambda s, d: figure.crossings_by_id_and_in_figure(category_tree(s, d)),
    "user_event_pivot": lambda s, d: users.with_type(users.event_pivot(events(s, d))),
    "user_type_distribution": lambda s, d: users.type_distribution(users.event_pivot(events(s, d))),
    "user_day_type_distribution": lambda s, d: users.type_distribution(dated_pivot(s, d)),
    "user_category_preference": preference,
    "user_top_category": lambda s, d: users.top_category(preference(s, d)),
    "users_with_category_preference": lambda s, d: users.users_with_preference(preference(s, d)),
    "item_features": features,
    "item_visitors_of_days": item_visitors_of_days,
    "item_features_summary": lambda s, d: items.features_summary(features(s, d)),
    "top_items_by_popularity": lambda s, d: items.top_by_popularity(features(s, d)),
    "category_item_stats": lambda s, d: items.category_stats(features(s, d)),
    "top_category_item_stats": lambda s, d: items.category_stats(features(s, d), 10),
    "sessions": event_sequences,
    "sessions_120": lambda s, d: event_sequences(s, d, 120),
    "session_summary": lambda s, d: sessions.summary(session_rows(s, d)),
    "session_pattern_distribution": lambda s, d: sessions.pattern_distribution(session_rows(s, d)),
    "session_length_distribution": lambda s, d: sessions.length_distribution(session_rows(s, d)),
    "session_length_distribution_720": lambda s, d: sessions.length_distribution(session_rows(s, d, 720)),
    "conversion_by_session_length": lambda s, d: sessions.conversion_by_length(session_rows(s, d)),
    "conversion_by_session_length_720": lambda s, d: sessions.conversion_by_length(session_rows(s, d, 720)),
    "streamed_sessions": streamed,
    "item_transitions": lambda s, d: sessions.transitions(marked(s, d), None),
    "item_transitions_720": lambda s, d: sessions.transitions(marked(s, d, 720), None),
    "item_transitions_top": lambda s, d: sessions.transitions(marked(s, d)),
    "user_activity_stats": lambda s, d: users.activity(events(s, d)),
    "user_anomalies": flagged,
    "anomaly_summary": lambda s, d: users.anomaly_summary(flagged(s, d)),
    "top_anomalies": lambda s, d: users.top_anomalies(flagged(s, d)),
}

QUERIES = {name: (lambda s, d, f=f: rounded(f(s, d))) for name, f in PLANS.items()}
