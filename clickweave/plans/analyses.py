"""One full run: every analysis of a clickstream by name, as lazy DataFrames over shared tables; and a command that writes the report.

    python -m clickweave.plans.analyses EVENTS.csv TREE.csv OUT_FOLDER PROPERTIES.csv...
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from clickweave import report
from clickweave.functions.columns import count_event
from clickweave.operators import figure, items, overview, properties, sessions, tree, users
from clickweave.shared import bucketed, discard, stored
from clickweave.sources import tables

STEPS = ("view", "addtocart", "transaction")


class Bases:
    """The tables that results share, each made when a result first asks for it and written once to the shared folder.

    The given events are read once, and once more for the bounds of their ranges; all else comes from these tables:

    * ``events``: the events in ranges of visitor and time; their scalars are observed as they are written;
    * ``periods``: events by date, hour, weekday and type;
    * ``pairs``: counts by visitor and item, in buckets of items; ``visitors`` and ``items`` are folds of it;
    * ``properties``, ``mapping`` (in buckets of items, as ``pairs`` and ``items`` are, so joins by item need no shuffle), ``tree``;
    * ``sessions``: a row a session; ``activity``: a row a visitor.
    """

    def __init__(self, events: DataFrame, item_properties: DataFrame, category_tree: DataFrame, gap_minutes: float):
        self.given = {"events": events, "item_properties": item_properties, "category_tree": category_tree}
        self.gap_minutes, self.made, self.scalars = gap_minutes, {}, None

    def table(self, name: str) -> DataFrame:
        if name not in self.made:
            self.made[name] = getattr(self, f"make_{name}")()
        return self.made[name]

    def close(self) -> None:
        """Deletes the tables; results can't be read any more."""
        for df in self.made.values():
            discard(df)
        self.made.clear()

    def make_events(self) -> DataFrame:
        rows, seen = sessions.in_ranges(self.given["events"]), Observation()
        measures = {f"null_{c}": F.count_if(F.col(c).isNull()) for c in self.given["events"].columns}
        found = stored(rows, seen, n=F.count(F.lit(1)), first_ts=F.min("ts"), last_ts=F.max("ts"), **measures)
        self.scalars = seen.get
        return found

    def observed(self) -> dict:
        """n, first_ts, last_ts and the number of nulls of each column of the events."""
        self.table("events")
        return self.scalars

    def make_periods(self) -> DataFrame:
        return stored(overview.enrich(self.table("events")).groupBy("date", "hour", "dayofweek", "day_name", "event").agg(F.count("*").alias("n")))

    def make_pairs(self) -> DataFrame:
        counts = [F.count("*").alias("n"), F.count("event").alias("n_events"), F.min("ts").alias("first"), F.max("ts").alias("last"), *[count_event(e).alias(e) for e in STEPS]]
        return bucketed(self.table("events").groupBy("visitorid", "itemid").agg(*counts), "itemid")

    def folded(self, by: str, other: str, distinct: str) -> DataFrame:
        sums = [F.sum(c).alias(c) for c in ("n", "n_events", *STEPS)]
        return self.table("pairs").filter(F.col(by).isNotNull()).groupBy(by).agg(F.count(other).alias(distinct), F.min("first").alias("first"), F.max("last").alias("last"), *sums)

    def make_visitors(self) -> DataFrame:
        return stored(self.folded("visitorid", "itemid", "unique_items"))

    def make_items(self) -> DataFrame:
        return bucketed(self.folded("itemid", "visitorid", "unique_users"), "itemid")

    def make_properties(self) -> DataFrame:
        return stored(self.given["item_properties"])

    def make_mapping(self) -> DataFrame:
        return bucketed(properties.category_mapping(self.table("properties")), "itemid")

    def make_tree(self) -> DataFrame:
        return stored(self.given["category_tree"])

    def make_graph(self) -> DataFrame:
        return stored(tree.trimmed_edges(self.table("tree")))

    def make_layout(self) -> DataFrame:
        return stored(tree.layout_of(self.table("graph")))

    def make_drawn(self) -> DataFrame:
        return stored(figure.bounded(self.table("graph")))

    def make_figure(self) -> DataFrame:
        return figure.figure_of(self.table("graph"), self.table("drawn"))

    def make_sessions(self) -> DataFrame:
        return stored(sessions.sessions(self.marked()))

    def marked(self) -> DataFrame:
        return sessions.numbered(self.table("events"), self.gap_minutes)

    def make_activity(self) -> DataFrame:
        seen = self.table("visitors").select("visitorid", F.col("n_events").alias("total_events"), "unique_items", F.col("first").alias("first_activity"), F.col("last").alias("last_activity"))
        return stored(users.anomalies(stored(users.with_daily(seen))))

    # views of the tables in the operators' columns

    def pivot(self) -> DataFrame:
        return self.table("visitors").select("visitorid", *STEPS)

    def item_counts(self, column: str = "n") -> DataFrame:
        return self.table("items").select("itemid", F.col(column).alias("c"))

    def preference(self) -> DataFrame:
        pairs = self.table("pairs").filter("visitorid IS NOT NULL AND itemid IS NOT NULL").select("visitorid", "itemid", F.col("n").alias("c"))
        return users.pair_preference(pairs, self.table("mapping"))

    def features(self) -> DataFrame:
        stats = self.table("items").select("itemid", "unique_users", F.col("n_events").alias("total_events"), F.col("first").alias("first_seen"), F.col("last").alias("last_seen"), *[F.col(e).alias(f"{e}_count") for e in STEPS])
        return items.with_categories(items.with_scores(stats), self.table("mapping"))

    def by_period(self, *columns: str) -> DataFrame:
        counts = F.coalesce(F.sum(F.when(F.col("event").isNotNull(), F.col("n"))), F.lit(0)).alias("n")
        return self.table("periods").filter(F.col(columns[0]).isNotNull()).groupBy(*columns).agg(counts)

    def local(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.given["events"].sparkSession.createDataFrame(rows, schema)

    def shapes(self) -> DataFrame:
        whole = {"item_properties": "properties", "category_tree": "tree"}
        events = self.local([("events", self.observed()["n"], len(self.given["events"].columns), ",".join(self.given["events"].columns))], "dataset string, n_rows long, n_columns int, column_names string")
        rest = [overview.dataset_shape(self.table(t), name) for name, t in whole.items()]
        return events.unionByName(rest[0]).unionByName(rest[1])

    def null_shares(self) -> DataFrame:
        seen = self.observed()
        return self.local([(c, seen[f"null_{c}"] * 100 / seen["n"] if seen["n"] else None) for c in self.given["events"].columns], "column_name string, null_pct double")

    def funnel(self) -> DataFrame:
        counts = [F.coalesce(F.sum(F.when(F.col("event") == e, F.col("n"))), F.lit(0)).alias(name) for e, name in zip(STEPS, ("views", "carts", "transactions"), strict=True)]
        return overview.funnel_rates(self.table("periods").agg(*counts))

    def span(self) -> DataFrame:
        seen = self.observed()
        return overview.span_days(self.local([(seen["first_ts"], seen["last_ts"])], "first_ts timestamp_ntz, last_ts timestamp_ntz"))

    def visitors_and_items(self) -> DataFrame:
        both = self.table("visitors").agg(F.count("*").alias("unique_visitors")).join(F.broadcast(self.table("items").agg(F.count("*").alias("unique_items"))), F.lit(True))  # one row each
        found = both.select("unique_visitors", F.lit(self.observed()["n"]).cast("bigint").alias("total_events"), "unique_items")
        return found.withColumn("avg_events_per_visitor", F.try_divide(F.col("total_events").cast("double"), F.col("unique_visitors")))

    def footprints(self) -> DataFrame:
        return self.local([(name, overview.footprint(df)) for name, df in self.given.items()], "dataset string, megabytes double")


#: How each result comes from the shared tables.
RESULTS: dict[str, Callable[[Bases], DataFrame]] = {
    "dataset_footprints": Bases.footprints,
    "dataset_shapes": Bases.shapes,
    "null_percentages": Bases.null_shares,
    "event_counts": lambda b: b.table("periods").filter("event IS NOT NULL").groupBy("event").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "event"),
    "conversion_funnel": Bases.funnel,
    "time_span": Bases.span,
    "daily_average": lambda b: b.by_period("date").agg(F.avg("n").alias("avg_daily_events")),
    "events_per_hour": lambda b: b.by_period("hour").orderBy("hour"),
    "events_per_weekday": lambda b: b.by_period("dayofweek", "day_name").orderBy("dayofweek"),
    "visitors_and_items": Bases.visitors_and_items,
    "top_items": lambda b: b.table("items").select("itemid", "n").orderBy(F.desc("n"), "itemid").limit(20),
    "concentration": lambda b: overview.concentration_of(b.item_counts("view").filter("c > 0")),
    "item_popularity_histogram": lambda b: overview.histogram_of(b.item_counts()).orderBy("bin"),
    "top_properties": lambda b: overview.value_counts(b.table("properties"), "property", 20),
    "top_item_categories": lambda b: overview.value_counts(b.table("mapping"), "categoryid", 20),
    "category_mapping": lambda b: properties.mapping_summary(b.table("mapping")),
    "availability": lambda b: properties.availability(b.table("properties")),
    "unparsed_values": lambda b: properties.unparsed_values(b.table("properties")),
    "top_event_categories": lambda b: properties.category_counts(b.item_counts(), b.table("mapping")).orderBy(F.desc("n"), "categoryid").limit(20),
    "tree_summary": lambda b: tree.tree_summary(b.table("tree")),
    "top_parents": lambda b: tree.children_counts(b.table("tree"), 10),
    "graph_edges": lambda b: b.table("graph").orderBy("src", "dst"),
    "graph_nodes": lambda b: b.table("layout").orderBy("y", "x"),
    "figure_edges": lambda b: b.table("drawn").orderBy("src", "dst"),
    "figure_nodes": lambda b: b.table("figure").orderBy("y", "x"),
    "user_types": lambda b: users.with_type(b.pivot()),
    "user_type_distribution": lambda b: users.type_distribution(b.pivot()).orderBy(F.desc("n"), "user_type"),
    "user_category_data": lambda b: users.top_category(b.preference()),
    "users_with_category_preference": lambda b: users.users_with_preference(b.preference()),
    "item_features": Bases.features,
    "item_features_summary": lambda b: items.features_summary(b.features()),
    "top_items_by_popularity": lambda b: items.top_by_popularity(b.features()),
    "top_categories_by_popularity": lambda b: items.category_stats(b.features(), 10),
    "session_summary": lambda b: sessions.summary(b.table("sessions")),
    "session_patterns": lambda b: sessions.pattern_distribution(b.table("sessions")).orderBy(F.desc("n"), "session_pattern"),
    "conversion_by_length": lambda b: sessions.conversion_by_length(b.table("sessions")).orderBy("session_length"),
    "frequent_transitions": lambda b: sessions.transitions(b.marked()),
    "anomaly_summary": lambda b: users.anomaly_summary(b.table("activity")),
    "top_anomalies": lambda b: users.top_anomalies(b.table("activity")),
}


class Run(Mapping[str, DataFrame]):
    """The results by name. Nothing runs until one is asked for; then the shared tables that it needs are written, if they aren't yet.

    Use it as a context manager, or call `close`, to delete these tables in the end.
    """

    def __init__(self, bases: Bases):
        self.bases, self.found = bases, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.found:
            self.found[name] = RESULTS[name](self.bases)
        return self.found[name]

    def __iter__(self) -> Iterator[str]:
        return iter(RESULTS)

    def __len__(self) -> int:
        return len(RESULTS)

    def __enter__(self) -> Run:
        return self

    def __exit__(self, *error: object) -> None:
        self.close()

    def close(self) -> None:
        self.bases.close()
        self.found.clear()


def run(events: DataFrame, item_properties: DataFrame, category_tree: DataFrame, gap_minutes: float = sessions.GAP_MINUTES) -> Run:
    """All results of the canonical tables (see `sources.tables`).

    Results named `top_*` or with a fixed number of rows are small; `item_features`, `user_category_data` and `user_types` are as large as the
    items and users and are meant to be written or joined, not collected.
    """
    return Run(Bases(events, item_properties, category_tree, gap_minutes))


def main(events: str, category_tree: str, out: str, *item_properties: str) -> None:
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    with run(tables.csv_events(spark, events), tables.csv_item_properties(spark, *item_properties), tables.csv_category_tree(spark, category_tree)) as results:
        found = report.collected(results)
    report.write(found, out)
    print(report.as_text(found))


if __name__ == "__main__":
    main(*sys.argv[1:])
