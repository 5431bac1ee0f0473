"""Hand-made rows with results worked out by hand."""

from __future__ import annotations

import os
import random
import subprocess
import sys
from datetime import datetime, timedelta
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from clickweave import report
from clickweave.operators import figure, increments, items, overview, properties, sessions, tree, users
from clickweave.operators.quantiles import exact_quantiles
from clickweave.plans import analyses
from clickweave.shared import shared_folder, stored
from clickweave.sources import tables
from clickweave.streaming.sessions import stream_sessions

EVENT = "event_id long, ts timestamp_ntz, visitorid long, event string, itemid long"
T0 = datetime(2024, 1, 1, 12)


def events(spark, rows):
    """rows: (minutes after T0, visitor, event, item)."""
    return spark.createDataFrame([(i, T0 + timedelta(minutes=m), v, e, x) for i, (m, v, e, x) in enumerate(rows)], EVENT)


def rows(df):
    return sorted((r.asDict() for r in df.collect()), key=str)


def test_a_gap_of_thirty_minutes_stays_and_one_millisecond_more_splits(spark):
    marked = sessions.sessionized(events(spark, [(0, 1, "view", 5), (30, 1, "view", 5), (60 + 1 / 60000, 1, "view", 6)]))
    found = {r.session_id: r.event_count for r in sessions.sessions(marked).collect()}
    assert found == {1: 2, 2: 1}
    assert rows(sessions.transitions(marked)) == [{"from_item": 5, "to_item": 5, "n": 1}]


def test_sessions_run_over_midnight_and_number_on(spark):
    late = 12 * 60 - 10
    marked = sessions.sessionized(events(spark, [(0, 1, "view", 1), (late, 1, "addtocart", 2), (late + 20, 1, "x-transaction", 3), (late + 3000, 1, "view", 4), (0, 2, "view", 9), (0, None, "view", 9)]))
    found = {(r.visitorid, r.session_id): r for r in sessions.session_sequences(marked).collect()}
    assert {k: (r.event_count, r.session_pattern, r.item_sequence) for k, r in found.items()} == {(1, 1): (1, "view_only", [1]), (1, 2): (2, "conversion", [2, 3]), (1, 3): (1, "view_only", [4]), (2, 1): (1, "view_only", [9])}
    assert found[1, 2].session_duration_minutes == 20
    assert found[2, 1].session_duration_minutes == 0
    assert rows(sessions.transitions(marked)) == [{"from_item": 2, "to_item": 3, "n": 1}]


def test_cuts_inside_sessions_of_one_visitor_change_nothing(spark):
    rng = random.Random(7)
    minutes, at = [], 0.0
    for _ in range(900):  # one visitor and one day, so every cut but the last lies in it
        minutes.append(at)
        at += rng.choice([0, 0, 0.1, 0.5, 1, 31])
    given = [(m / 10, 1, rng.choice(["view", "addtocart", "transaction"]), i % 40) for i, m in enumerate(minutes)] + [(i, v, "view", i) for v in (0, 2, 3) for i in (0, 5, 90)]
    ev = events(spark, given)
    want, before = [], {}
    for r in sorted(ev.collect(), key=lambda r: (r.visitorid, r.ts, r.event_id)):
        last = before.get(r.visitorid)
        new = last is None or r.ts - last[0] > timedelta(minutes=3)
        session, position = (1 if last is None else last[2] + 1, 1) if new else (last[2], last[3] + 1)
        want.append((r.event_id, session, new, None if new else last[1], position))
        before[r.visitorid] = (r.ts, r.itemid, session, position)
    for ranges in (1, 4, 37):
        dealt = stored(sessions.in_ranges(ev, ranges))
        sizes = [r.n for r in dealt.groupBy("_range").count().withColumnRenamed("count", "n").collect()]
        assert len(sizes) == ranges and max(sizes) < 3 * 909 / ranges
        marked = sessions.numbered(dealt, 3)
        assert sorted((r.event_id, r.session_id, r.is_start, r.prev_item, r.position) for r in marked.collect()) == sorted(want)
    assert max(x[4] for x in want) > 20
    plan = sessions.session_sequences(marked)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list") == 1 and "block" in plan  # the only lists are blocks


def test_the_query_of_sessions_has_one_row_for_a_long_session_and_keeps_the_null_visitor(spark, tmp_path):
    import duckdb

    from clickweave.plans import catalogue

    start = datetime(2024, 1, 1)
    given = [(i, start + timedelta(seconds=i // 2), 1, ("view", "click", "purchase")[i % 3], None if i % 7 == 0 else f'{{"k": {i % 50}}}') for i in range(2500)]
    given += [(3000 + i, start + timedelta(minutes=m), user, "view", '{"k": 4}') for i, (m, user) in enumerate([(0, None), (5, None), (100, None), (0, 2)])]
    given += [(4000 + i, start + timedelta(days=1, minutes=i), 2, "view", None) for i in range(2)]  # no items at all
    spark.createDataFrame(given, "event_id long, ts timestamp, user_id long, event_type string, props string").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"SET TimeZone = 'UTC'; CREATE VIEW events AS SELECT * REPLACE (CAST(ts AS TIMESTAMP) AS ts) FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    for name in ("sessions", "sessions_120"):
        sql = con.execute(catalogue.ORACLE_SQL[name])
        names = [c[0] for c in sql.description]
        df = catalogue.QUERIES[name](spark, str(tmp_path))
        assert sorted(df.columns) == sorted(names) and "block" not in names
        got, want = (sorted((tuple(r) for r in x), key=str) for x in (df.select(*names).collect(), sql.fetchall()))
        assert got == want
        long = {r.visitorid: r for r in df.collect() if r.session_id == 1}
        assert long[1].event_count == 2500 and len(long[1].event_sequence.split(",")) == 2500
        assert long[None].event_count == (2 if name == "sessions" else 3)


def test_no_events(spark):
    none = events(spark, [])
    assert rows(sessions.sessions(sessions.sessionized(none))) == []
    assert rows(overview.conversion_funnel(none))[0]["view_to_cart_rate"] == 0
    assert rows(overview.concentration(none)) == [{"n_items": 0, "n_top_items": 0, "concentration_ratio": None}]
    assert rows(users.anomaly_summary(users.anomalies(users.activity(none))))[0]["anomaly_ratio"] is None


def test_an_item_with_two_categories_doubles_its_events_and_one_without_drops_from_counts(spark):
    ev = events(spark, [(0, 1, "view", 1), (1, 1, "view", 1), (2, 1, "view", 2)])
    pr = spark.createDataFrame([(1, "categoryid", "7"), (1, "categoryid", "3"), (1, "available", "1"), (2, "available", "0"), (2, "categoryid", "no number")], "itemid long, property string, value string")
    mapping = properties.category_mapping(pr)
    assert properties.with_category(ev, mapping.filter("categoryid IS NOT NULL")).count() == 5
    assert rows(properties.category_event_counts(ev, mapping)) == [{"categoryid": 3, "n": 2}, {"categoryid": 7, "n": 2}]
    assert rows(users.top_category(users.category_preference(ev, mapping))) == [{"visitorid": 1, "categoryid": 3, "interaction_count": 2}]
    assert rows(properties.availability(pr)) == [{"available_pct": 50.0}]


def test_conversion_of_an_item_without_views(spark):
    found = rows(items.item_stats(events(spark, [(i, 1, "transaction", 4) for i in range(3)])))[0]
    assert (found["conversion_rate"], found["popularity_score"]) == (300.0, 30)


def test_concentration_takes_whole_items_only(spark):
    ev = [(0, 1, "view", i) for i in range(99)]
    assert rows(overview.concentration(events(spark, ev))) == [{"n_items": 99, "n_top_items": 0, "concentration_ratio": 0.0}]
    more = [*ev, (0, 1, "view", 99), *[(0, 1, "view", 7)] * 4]
    assert rows(overview.concentration(events(spark, more)))[0]["concentration_ratio"] == pytest.approx(500 / 104)


def test_user_types(spark):
    ev = [(0, 1, "view", 1), (0, 1, "transaction", 1), (0, 2, "view", 1), (0, 2, "addtocart", 1), (0, 3, "view", 1), (0, 4, "error", 1)]
    assert {r.visitorid: r.user_type for r in users.with_type(users.event_pivot(events(spark, ev))).collect()} == {1: "buyer", 2: "cart_user", 3: "browser", 4: "inactive"}


def test_fences_are_strict_and_quartiles_interpolate(spark):
    stats = spark.createDataFrame([(i, x, x, float(x)) for i, x in enumerate([1, 2, 3, 10])], "visitorid long, total_events long, unique_items long, daily_avg_events double")
    # quartiles 1.75 and 4.75: the fences are -2.75 and 9.25
    assert {r.visitorid: r.anomaly_score for r in users.anomalies(stats).collect()} == {0: 0, 1: 0, 2: 0, 3: 3}
    edge = spark.createDataFrame([(i, x, x, float(x)) for i, x in enumerate([0, 0, 4, 4, 10])], "visitorid long, total_events long, unique_items long, daily_avg_events double")
    assert {r.anomaly_score for r in users.anomalies(edge).collect()} == {0}  # 10 is on the fence: 4 + 1.5 * 4


def test_tree_depths_with_a_leaf_root_a_chain_and_a_cycle(spark):
    rows_ = [(1, None), (2, None), (3, 2), (4, 3), (5, 4), (6, None), (7, 6), (8, 7), (7, 8)]
    found = tree.root_depths(spark.createDataFrame(rows_, "categoryid long, parentid long"))
    assert {r.root: r.depth for r in found.collect()} == {1: 0, 2: 3, 6: 3}


def test_trimming_keeps_small_graphs_and_neighbours_of_the_core(spark):
    star = [(i, 0) for i in range(1, 6)] + [(i + 10, i) for i in range(1, 6)]
    df = spark.createDataFrame(star, "categoryid long, parentid long")
    assert tree.trimmed_edges(df, 200, 150).count() == 10
    assert tree.trimmed_edges(df, 5, 1).count() == 5
    assert {r.node: (r.out_degree, r.size, r.labelled) for r in tree.degrees(df).collect()}[0] == (5, 10.5, True)


def test_csv_sources(spark, tmp_path):
    (tmp_path / "e.csv").write_text("timestamp,visitorid,event,itemid\n1433221332117,257597,view,355908\n")
    (tmp_path / "t.csv").write_text("categoryid,parentid\n1016,213\n231,\n")
    r = tables.csv_events(spark, str(tmp_path / "e.csv")).collect()[0]
    assert (r.ts, r.visitorid, r.event, r.itemid) == (datetime(2015, 6, 2, 5, 2, 12, 117000), 257597, "view", 355908)
    assert rows(tree.roots(tables.csv_category_tree(spark, str(tmp_path / "t.csv")))) == [{"root": 231}]


def test_csv_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("transactionid,itemid,event,timestamp,visitorid\n,7,view,1433221332117,1\n9,8,transaction,1433221332117,1\n")
    (tmp_path / "b.csv").write_text("timestamp,visitorid,event,itemid\n1433221332117,1,view,9\n1433221332117,x,view,\n")
    found = tables.csv_events(spark, str(tmp_path / "a.csv"), str(tmp_path / "b.csv"))
    assert [(r.visitorid, r.event, r.itemid) for r in found.orderBy("event_id").collect()] == [(1, "view", 7), (1, "transaction", 8), (1, "view", 9), (None, "view", None)]
    # ties of time go by the order of the files
    assert [r.item_sequence for r in sessions.session_sequences(sessions.sessionized(found)).collect()] == [[7, 8, 9]]
    assert {r.column_name: r.n for r in tables.unparsed(spark, tables.EVENTS_CSV, str(tmp_path / "b.csv")).collect()} == {"timestamp": 0, "visitorid": 1, "event": 0, "itemid": 0}
    (tmp_path / "p.csv").write_text("timestamp,itemid,property,value\n1435460400000,460429,categoryid,1338\n1435460500000,460429,categoryid,12\n")
    assert [r.value for r in tables.csv_item_properties(spark, str(tmp_path / "p.csv")).collect()] == ["1338", "12"]
    latest = properties.category_mapping(tables.csv_item_properties(spark, str(tmp_path / "p.csv"), timed=True), "timestamp")
    assert rows(latest) == [{"itemid": 460429, "categoryid": 12}]
    with pytest.raises(ValueError, match="no column parentid"):
        tables.by_name(spark, str(tmp_path / "b.csv"), "timestamp BIGINT, parentid BIGINT")


def test_trees_of_any_depth_and_size(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(1001)], "categoryid long, parentid long")
    assert rows(tree.root_depths(chain)) == [{"root": 0, "depth": 1000}]
    star = spark.range(1_200_001).selectExpr("id AS categoryid", "CASE WHEN id > 0 THEN 0 END AS parentid")
    assert rows(tree.root_depths(star)) == [{"root": 0, "depth": 1}]
    odd = [(1, None), (1, None), (2, 1), (3, 99), (10, 11), (11, 12), (12, 10), (None, 1)]  # a root twice, an orphan, a cycle that no root reaches
    assert rows(tree.root_depths(spark.createDataFrame(odd, "categoryid long, parentid long"))) == [{"root": 1, "depth": 1}]
    assert rows(tree.tree_summary(chain.limit(0)))[0]["max_depth"] == 0


def test_quantiles_are_exact(spark):
    import numpy as np

    values = np.random.default_rng(1).lognormal(size=999).round(2)
    df = spark.createDataFrame([(float(v), 5, None) for v in values], "a double, b long, c double")
    found = exact_quantiles(df, ["a", "b", "c"], [0, 0.25, 0.75, 1]).first()
    assert [found[f"a_{k}"] for k in range(4)] == pytest.approx(list(np.quantile(values, [0, 0.25, 0.75, 1])))
    assert (found.b_1, found.c_1) == (5, None)


def test_positions_and_blocks_of_a_long_session(spark):
    ev = events(spark, [(20 * i, 1, "view", i) for i in range(200)] + [(20 * 200 + 40, 1, "view", 900), (20 * 200 + 50, 1, "view", 901)])
    marked = sessions.sessionized(ev)
    assert [r.position for r in marked.orderBy("ts").collect()] == [*range(1, 201), 1, 2]
    found = {(r.session_id, r.block): r["items"] for r in sessions.sequence_blocks(marked, 64).collect()}
    assert found == {**{(1, b): list(range(64 * b, min(200, 64 * b + 64))) for b in range(4)}, (2, 0): [900, 901]}


def test_states_of_days_merge_to_the_full_count(spark, tmp_path):
    rng = random.Random(3)
    ev = events(spark, [(rng.randrange(5 * 1440), rng.choice([0, 1, 32768, 32769, 70000, -5, None]), "view", rng.choice([1, 2, None])) for _ in range(300)])
    want = {r.itemid: (r.n, r.d) for r in ev.filter("itemid IS NOT NULL AND visitorid IS NOT NULL").groupBy("itemid").agg(F.count("*").alias("n"), F.count_distinct("visitorid").alias("d")).collect()}
    days = increments.day_states(ev)
    for k in range(6):  # each day is written by itself, the first one twice
        for mode in ("overwrite", "overwrite")[: 2 - (k > 0)]:
            days.filter(F.col("day") == (T0 + timedelta(days=k)).date()).write.mode(mode).parquet(str(tmp_path / f"day={k}"))
    read = spark.read.schema(days.drop("day").schema).parquet(*[str(tmp_path / f"day={k}") for k in range(6)])
    assert {r.itemid: (r.n_events, r.n_distinct) for r in increments.merged(read).collect()} == want


def test_the_report_says_what_it_leaves_out(spark):
    found = report.collected({"event_counts": spark.range(30).selectExpr("id AS event", "id AS n"), "top_items": spark.range(3)}, most=20)
    assert len(found["event_counts"]) == 20
    assert report.as_text(found).count("the first 20 rows") == report.as_html(found).count("the first 20 rows") == 1


def deepest_by_hand(rows):
    """The depth of each root by walking every way, where a repeated node counts and ends the way."""
    children = {}
    for c, p in set(rows):
        children.setdefault(p, set()).add(c)

    def depth(node, way):
        return 0 if node in way else max((1 + depth(c, way | {node}) for c in children.get(node, ())), default=0)

    return {c: depth(c, frozenset()) for c, p in rows if p is None and c is not None}


def test_depths_with_several_parents_and_cycles(spark):
    rng = random.Random(11)
    ladder = [(0, None), *[(x, p) for k in range(0, 24, 3) for x, p in ((k + 1, k), (k + 2, k), (k + 3, k + 1), (k + 3, k + 2))]]
    odd = [(1, None), (1, 5), (2, 1), (5, 2), (5, 1), (7, 7), (7, 1), (9, 8), (8, 9), (None, 1), (30, 99), (8, 5), (40, None)]
    graphs = [ladder, odd, *[[(0, None), (1, None), *[(rng.randrange(n), rng.randrange(n)) for _ in range(m)]] for n, m in ((7, 9), (9, 14))]]
    for given in graphs:
        found = tree.root_depths(spark.createDataFrame(given, "categoryid long, parentid long"))
        assert {r.root: r.depth for r in found.collect()} == deepest_by_hand(given)


CANONICAL = "itemid long, property string, value string"


def small_tables(spark):
    ev = events(spark, [(37 * i, i % 7, ("view", "view", "addtocart", "transaction")[i % 4], i % 5) for i in range(60)] + [(5, None, "view", 3), (6, 3, None, 2), (7, 3, "view", None)])
    pr = spark.createDataFrame([(i, "categoryid", str(10 + i % 2)) for i in range(5)] + [(0, "available", "1"), (1, "available", "<b>"), (2, "categoryid", "x")], CANONICAL)
    tr = spark.createDataFrame([(10, 1), (11, 1), (1, None)], "categoryid long, parentid long")
    return ev, pr, tr


def test_a_run_shares_its_tables_and_agrees_with_the_operators(spark):
    ev, pr, tr = small_tables(spark)
    mapping = properties.category_mapping(pr)
    features = items.item_features(ev, mapping)
    marked = sessions.sessionized(ev)
    found, flagged = sessions.sessions(marked), users.anomalies(stored(users.activity(ev)))
    want = {
        "null_percentages": overview.null_percentages(ev), "event_counts": overview.value_counts(ev, "event"), "conversion_funnel": overview.conversion_funnel(ev), "time_span": overview.time_span(ev),
        "daily_average": overview.daily_average(ev), "events_per_hour": overview.per_period(ev, "hour"), "events_per_weekday": overview.per_period(ev, "dayofweek", "day_name"),
        "visitors_and_items": overview.visitor_item_summary(ev), "top_items": overview.value_counts(ev, "itemid", 20), "concentration": overview.concentration(ev), "item_popularity_histogram": overview.popularity_histogram(ev),
        "top_event_categories": properties.category_event_counts(ev, mapping), "user_types": users.with_type(users.event_pivot(ev)), "user_category_data": users.top_category(users.category_preference(ev, mapping)),
        "item_features": features, "top_categories_by_popularity": items.category_stats(features, 10), "session_summary": sessions.summary(found), "session_patterns": sessions.pattern_distribution(found),
        "conversion_by_length": sessions.conversion_by_length(found), "frequent_transitions": sessions.transitions(marked), "anomaly_summary": users.anomaly_summary(flagged), "top_anomalies": users.top_anomalies(flagged),
        "unparsed_values": properties.unparsed_values(pr), "tree_summary": tree.tree_summary(tr), "graph_edges": tree.trimmed_edges(tr), "graph_nodes": tree.layout(tr),
    }
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("run"))
    spark.sparkContext.setJobGroup("run", "a full run")
    try:
        with analyses.run(ev, pr, tr) as results:
            assert jobs() == 0 and set(want) <= set(results)
            plain = lambda df: rows(df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]))
            for name, df in want.items():
                assert plain(results[name].select(*df.columns)) == plain(df), name
            before = jobs()
            results["conversion_funnel"], results["session_summary"], results["item_features"]
            assert jobs() == before  # all tables are there
            # events, items and mapping are in buckets of items: the join by item shuffles nothing
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
            plan = results.bases.features()._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange" not in plan
            kept = [df.stored_at[0] for df in results.bases.made.values()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert kept and not any(os.path.exists(f.removeprefix("file:")) for f in kept)


def test_a_run_reads_its_files_twice_at_most(spark, tmp_path):
    (tmp_path / "e.csv").write_text("timestamp,visitorid,event,itemid\n" + "".join(f"{1433221332117 + 60000 * i},{i % 5},view,{i % 3}\n" for i in range(50)))
    ev, pr, tr = small_tables(spark)
    with analyses.run(tables.csv_events(spark, str(tmp_path / "e.csv")), pr, tr) as results:
        found = report.collected(results)
        made = [n for n, df in results.bases.made.items() if "csv" in df._jdf.queryExecution().executedPlan().toString().lower()]
        shown = [n for n in results if "csv" in results[n]._jdf.queryExecution().executedPlan().toString().lower()]
    assert made == shown == []  # everything but the first table reads Parquet; that one reads the file once, and once for its ranges
    assert found["visitors_and_items"] == [{"unique_visitors": 5, "total_events": 50, "unique_items": 3, "avg_events_per_visitor": 10.0}]


def test_a_full_run_and_its_report(spark, tmp_path):
    ev, pr, tr = small_tables(spark)
    found = report.collected(analyses.run(ev, pr, tr))
    assert found["conversion_funnel"][0]["views"] == 32
    assert found["tree_summary"][0]["max_depth"] == 1
    assert found["unparsed_values"] != []
    report.write(found, str(tmp_path))
    page, text = (tmp_path / "report.html").read_text(), (tmp_path / "report.txt").read_text()
    assert page.count("<circle") == 3 and page.count("<line") == 2
    assert "<svg" in page and "view_to_cart_rate" in page and "50.00" in text
    empty = report.collected(analyses.run(ev.limit(0), pr.limit(0), tr.limit(0)))
    assert "no rows" in report.as_text(empty) and "no rows" in report.as_html(empty)
    assert overview.footprint(ev) >= 0


def test_a_stream_has_the_sessions_of_the_batch(spark, tmp_path):
    given = [(0, 1, "view", 1), (30, 1, "view", 2), (61, 1, "transaction", 3), (5, 2, "view", 1), (500, 3, "view", 1)]
    events(spark, given).selectExpr("visitorid", "CAST(ts AS timestamp) AS ts", "event").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("visitorid long, ts timestamp, event string").parquet(str(tmp_path / "in"))
    query = stream_sessions(stream).writeStream.outputMode("complete").format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    found = {(r.visitorid, r.event_count, r.session_pattern) for r in spark.table("found").collect()}
    assert found == {(1, 2, "view_only"), (1, 1, "conversion"), (2, 1, "view_only"), (3, 1, "view_only")}


def test_late_events_of_a_stream_are_dropped_and_closed_sessions_appended(spark, tmp_path):
    def batch(k, given):
        events(spark, given).selectExpr("visitorid", "CAST(ts AS timestamp) AS ts", "event").coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k}"))

    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("visitorid long, ts timestamp, event string").option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))

    def step():
        query = stream_sessions(stream, delay="5 minutes").writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
        return {(r.visitorid, r.event_count, r.session_pattern) for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    batch(0, [(0, 1, "view", 1), (30, 1, "transaction", 2), (100, 2, "view", 1)])
    assert step() == {(1, 2, "conversion")}  # 60 + 30 minutes lie before the watermark of 95
    batch(1, [(10, 3, "view", 1), (125, 2, "addtocart", 1), (400, 4, "view", 1)])
    assert step() == {(1, 2, "conversion"), (2, 2, "cart_only")}  # visitor 3 came too late; visitor 4 is still open


def test_a_stream_numbers_sessions_as_the_batch_over_batches_and_a_restart(spark, tmp_path):
    from clickweave.streaming.stateful import ROCKSDB, stream_numbered

    rng = random.Random(9)
    given = sorted((round(rng.random() * 600, 2), rng.randrange(3), rng.choice(["view", "addtocart"]), rng.choice([None, 1, 2, 3])) for _ in range(90))
    given += [(5000, 9, "view", 1)]  # takes the watermark past all others
    ev = events(spark, given)
    # of disorder up to the delay: rows come by time and up to nine minutes
    arrival = sorted(ev.collect(), key=lambda r: (r.ts + timedelta(minutes=rng.random() * 9)))
    (tmp_path / "in").mkdir()

    def batch(k, rows_):
        spark.createDataFrame([tuple(r) for r in rows_], EVENT).selectExpr("event_id", "CAST(ts AS timestamp) AS ts", "visitorid", "event", "itemid").coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k}"))

    def step():
        stream = spark.readStream.schema("event_id long, ts timestamp, visitorid long, event string, itemid long").option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        query = stream_numbered(stream, delay="10 minutes").writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(240)
        assert query.exception() is None

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        for k in range(3):  # each start is a restart from the checkpoint
            batch(k, arrival[31 * k : 31 * (k + 1)])
            step()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    found = {(r.event_id, r.visitorid, r.session_id, r.is_start, r.prev_item, r.position) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.event_id, r.visitorid, r.session_id, r.is_start, r.prev_item, r.position) for r in sessions.sessionized(ev).filter("visitorid < 9").collect()}
    assert found == want and len(want) == 90


def test_a_stream_keeps_state_by_bucket_and_numbers_all_visitors_of_one(spark, tmp_path):
    from clickweave.streaming.stateful import ROCKSDB, stream_numbered

    rng = random.Random(11)
    given = [(round(rng.random() * 900, 2), v, rng.choice(["view", "addtocart", None]), rng.choice([None, 1, 2])) for v in range(300) for _ in range(rng.randrange(1, 6))]
    ev = events(spark, [*given, (9000, 1000, "view", 1)])
    ev.selectExpr("event_id", "CAST(ts AS timestamp) AS ts", "visitorid", "event", "itemid").write.parquet(str(tmp_path / "in"))
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        want = {(r.event_id, r.event, r.itemid, r.session_id, r.is_start, r.prev_item, r.position) for r in sessions.sessionized(ev).filter("visitorid < 1000").collect()}
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        stream = spark.readStream.schema("event_id long, ts timestamp, visitorid long, event string, itemid long").parquet(str(tmp_path / "in"))
        query = stream_numbered(stream, buckets=2).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(240)
        assert query.exception() is None
        keys = max(sum(x.numRowsTotal for x in p.stateOperators) for p in query.recentProgress)
        found = {(r.event_id, r.event, r.itemid, r.session_id, r.is_start, r.prev_item, r.position) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert found == want and len(want) == len(given)
    assert keys < 50  # by visitor there would be over 300


def test_times_out_of_range_and_ragged_rows_are_rejected(spark, tmp_path):
    (tmp_path / "e.csv").write_text("timestamp,visitorid,event,itemid\n1433221332117,1,view,7\n9223372036854775807,1,view,8\n253402300800000,2,view,9\n1433221332118,x,view,8,more\n1433221332119,3\n,4,view,1\n")
    found = tables.csv_events(spark, str(tmp_path / "e.csv"))
    assert [(r.ts is None, r.visitorid, r.itemid) for r in found.orderBy("event_id").collect()] == [(False, 1, 7), (True, 1, 8), (True, 2, 9), (False, None, 8), (False, 3, None), (True, 4, 1)]
    assert sessions.sessions(sessions.sessionized(found)).count() == 2
    faults = tables.rejected(spark, tables.EVENTS_CSV, str(tmp_path / "e.csv"))
    assert sorted((r.record or "", r.column_name or "", r.field or "", r.reason) for r in faults.collect()) == sorted([
        ("", "timestamp", "9223372036854775807", "out of range"), ("", "timestamp", "253402300800000", "out of range"), ("1433221332118,x,view,8,more", "visitorid", "x", "not bigint"),
        ("1433221332118,x,view,8,more", "", "", "ragged"), ("1433221332119,3", "", "", "ragged"),
    ])
    assert {r.column_name: r.n for r in tables.unparsed(spark, tables.EVENTS_CSV, str(tmp_path / "e.csv")).collect()} == {"timestamp": 2, "visitorid": 1, "event": 0, "itemid": 0}
    assert all(r.file.endswith("e.csv") for r in faults.collect())


def test_a_cluster_needs_a_shared_folder():
    def session(master):
        none = SimpleNamespace(isEmpty=lambda: True)
        return SimpleNamespace(sparkContext=SimpleNamespace(_jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)), getConf=lambda: {}, master=master))

    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_folder(session(master))


def test_the_entry_works_without_a_library_of_the_corpus_part():
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; assert 'sessions' in e.queries() and not [n for n in e.queries() if n.startswith('op')]; assert set(e.oracle_sql()) <= set(e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__)))).returncode == 0


def crossing_pairs(links, at):
    ends = [(at[a][1], at[a][0], at[b][0]) for a, b in links if a in at and b in at and at[b][1] == at[a][1] + 1]
    return sum(y == z and a < c and b > d for y, a, b in ends for z, c, d in ends)


def test_crossings_are_those_of_all_pairs_of_edges(spark):
    rng = random.Random(3)
    at = {f"{y}-{i}": (i + 1, y) for y in range(3) for i in range(9)}
    links = [(f"{y}-{rng.randrange(9)}", f"{min(2, y + rng.choice((1, 1, 2)))}-{rng.randrange(9)}") for y in range(2) for _ in range(25)]
    edges, placed = spark.createDataFrame(links, "src string, dst string"), spark.createDataFrame([(n, y, x) for n, (x, y) in at.items()], "node string, y int, x int")
    assert figure.crossings(edges, placed).first()[0] == crossing_pairs(links, at) > 0
    assert figure.crossings(edges.limit(0), placed).first()[0] == 0


def test_sweeps_lower_the_crossings_of_graphs_with_several_parents(spark):
    rng = random.Random(8)
    tree_rows = [(i, None) for i in range(4)] + [(10 + i, rng.randrange(4)) for i in range(12) for _ in (0, 1)] + [(30 + i, 10 + rng.randrange(12)) for i in range(14) for _ in (0, 1)]
    tr = spark.createDataFrame(tree_rows, "categoryid bigint, parentid bigint")
    at = {r.node: (r.x, r.y) for r in figure.figure(tr).collect()}
    links = {(str(p), str(c)) for c, p in tree_rows if p is not None}
    assert set(at) == {x for e in links for x in e} and len({(x, y) for x, y in at.values()}) == len(at)
    found = figure.crossings_by_id_and_in_figure(tr).first()
    assert found.in_figure == crossing_pairs(links, at) < found.by_id


def test_a_star_is_drawn_with_a_node_for_the_rest(spark):
    tr = spark.range(6000).selectExpr("id + 1 AS categoryid", "CAST(0 AS BIGINT) AS parentid").union(spark.sql("SELECT 0L, CAST(NULL AS BIGINT)")).union(spark.sql("SELECT 7000L, 6000L"))
    found = {r.node: r for r in figure.figure(tr).collect()}
    assert set(found) == {"0", "6000", "7000", *map(str, range(1, figure.SHOWN)), "children of 0"}  # 6000 has a child, so it comes first
    assert found["children of 0"].n == 6000 - figure.SHOWN and found["0"].size == 25 and not found["0"].parents_left_out
    many = spark.range(30).selectExpr("CAST(100 AS BIGINT) AS categoryid", "id AS parentid")
    top = {r.node: r for r in figure.figure(many).collect()}
    assert top["100"].parents_left_out == 30 - figure.SHOWN
    assert figure.figure(many.limit(0)).count() == 0
    page = report.graph([r.asDict() for r in found.values()], [{"src": "0", "dst": "children of 0"}])
    assert "children of 0: 5,988 more" in page
