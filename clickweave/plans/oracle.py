"""SQL twins of the catalogue, in the dialect of DuckDB."""

from __future__ import annotations

EVENTS = """ev AS (
  SELECT event_id, ts, user_id AS visitorid, CASE event_type WHEN 'click' THEN 'addtocart' WHEN 'purchase' THEN 'transaction' ELSE event_type END AS event,
         CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS itemid
  FROM events)"""
PROPERTIES = """pr AS (
  SELECT p_partkey AS itemid, 'categoryid' AS property, CAST(p_size AS VARCHAR) AS value FROM part
  UNION ALL SELECT p_partkey, 'available', CAST(p_size % 2 AS VARCHAR) FROM part
  UNION ALL SELECT p_partkey, 'categoryid', CAST(100 + CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER) AS VARCHAR) FROM part),
mp AS (SELECT itemid, CAST(value AS BIGINT) AS categoryid FROM pr WHERE property = 'categoryid')"""
TREE = """tr AS (
  SELECT CAST(1000000000 + r_regionkey AS BIGINT) AS categoryid, CAST(NULL AS BIGINT) AS parentid FROM region
  UNION ALL SELECT CAST(2000000000 + n_nationkey AS BIGINT), CAST(1000000000 + n_regionkey AS BIGINT) FROM nation
  UNION ALL SELECT CAST(3000000000 + s_suppkey AS BIGINT), CAST(2000000000 + s_nationkey AS BIGINT) FROM supplier)"""
DEPTHS = """walk(root, node, depth) AS (
  SELECT categoryid, categoryid, 0 FROM tr WHERE parentid IS NULL
  UNION ALL SELECT w.root, t.categoryid, w.depth + 1 FROM walk w JOIN tr t ON t.parentid = w.node),
dp AS (SELECT root, max(depth) AS depth FROM walk GROUP BY root)"""
DEGREES = """ends AS (SELECT parentid AS node, 1 AS o, 0 AS i FROM tr WHERE parentid IS NOT NULL UNION ALL SELECT categoryid, 0, 1 FROM tr WHERE parentid IS NOT NULL),
dg AS (SELECT node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) + sum(i) AS BIGINT) AS degree FROM ends GROUP BY node)"""
PAIRS = """pf AS (SELECT visitorid, categoryid, count(*) AS interaction_count FROM ev JOIN mp USING (itemid) GROUP BY ALL)"""
FEATURES = """st AS (
  SELECT itemid, count(DISTINCT visitorid) AS unique_users, count(event) AS total_events, min(ts) AS first_seen, max(ts) AS last_seen,
    count(*) FILTER (event = 'view') AS view_count, count(*) FILTER (event = 'addtocart') AS addtocart_count, count(*) FILTER (event = 'transaction') AS transaction_count
  FROM ev GROUP BY itemid),
ft AS (
  SELECT s.*, view_count + 3 * addtocart_count + 10 * transaction_count AS popularity_score,
    round(transaction_count * 100.0::DOUBLE / CASE WHEN view_count = 0 THEN 1 ELSE view_count END, 6) AS conversion_rate, categoryid
  FROM st s LEFT JOIN mp USING (itemid))"""


def marks(minutes: int) -> str:
    return f"""gaps AS (SELECT *, lag(ts) OVER w AS before, lag(itemid) OVER w AS prev FROM ev WINDOW w AS (PARTITION BY visitorid ORDER BY ts, event_id)),
starts AS (SELECT *, before IS NULL OR ts - before > INTERVAL {minutes} MINUTE AS is_start FROM gaps),
mk AS (SELECT *, CAST(sum(is_start::INT) OVER (PARTITION BY visitorid ORDER BY ts, event_id) AS BIGINT) AS session_id FROM starts),
ss AS (
  SELECT visitorid, session_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS event_count, count(DISTINCT itemid) AS unique_items,
    CASE WHEN bool_or(contains(event, 'transaction')) THEN 'conversion' WHEN bool_or(contains(event, 'addtocart')) THEN 'cart_only' ELSE 'view_only' END AS session_pattern,
    round(date_diff('microsecond', min(ts), max(ts)) / 60000000.0::DOUBLE, 6) AS session_duration_minutes
  FROM mk GROUP BY visitorid, session_id),
ps AS (SELECT *, (row_number() OVER (PARTITION BY visitorid, session_id ORDER BY ts, event_id) - 1) // 1000 AS block FROM mk),
sq AS (SELECT visitorid, session_id, block, string_agg(CAST(itemid AS VARCHAR), ',' ORDER BY ts, event_id) AS item_sequence, string_agg(event, ',' ORDER BY ts, event_id) AS event_sequence FROM ps GROUP BY ALL)"""


def marks_with_sequences(minutes: int) -> str:
    """`marks` whose sessions have their whole sequences."""
    minutes_of = " AS session_duration_minutes\n"
    lists = "    string_agg(CAST(itemid AS VARCHAR), ',' ORDER BY ts, event_id) AS item_sequence, string_agg(event, ',' ORDER BY ts, event_id) AS event_sequence\n"
    return marks(minutes).replace(minutes_of, minutes_of.replace("\n", ",\n") + lists)


def activity(source: str) -> str:
    return f"""ac AS (
  SELECT visitorid, count(event) AS total_events, count(DISTINCT itemid) AS unique_items, min(ts) AS first_activity, max(ts) AS last_activity,
    date_diff('microsecond', min(ts), max(ts)) / 86400000000.0::DOUBLE AS activity_days FROM {source} GROUP BY visitorid),
us AS (SELECT *, total_events / (activity_days + 1) AS daily_avg_events FROM ac)"""


BOUGHT = """bo AS (SELECT o_custkey AS visitorid, 'transaction' AS event, l_partkey AS itemid, o_orderdate AS ts FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
FLAGS = """qs AS (SELECT """ + ", ".join(f"quantile_cont({m}, 0.25) AS {m}_a, quantile_cont({m}, 0.75) AS {m}_b" for m in ("total_events", "unique_items", "daily_avg_events")) + """ FROM us),
fl AS (SELECT us.*, """ + ", ".join(f"({m} < {m}_a - 1.5 * ({m}_b - {m}_a) OR {m} > {m}_b + 1.5 * ({m}_b - {m}_a)) AS {m}_outlier" for m in ("total_events", "unique_items", "daily_avg_events")) + """ FROM us, qs),
an AS (
  SELECT visitorid, total_events, unique_items, first_activity, last_activity, round(activity_days, 6) AS activity_days, round(daily_avg_events, 6) AS daily_avg_events,
    total_events_outlier, unique_items_outlier, daily_avg_events_outlier, total_events_outlier::INT + unique_items_outlier::INT + daily_avg_events_outlier::INT AS anomaly_score FROM fl)"""
ANOMALIES = f"WITH {BOUGHT}, {activity('bo')}, {FLAGS} "
TYPES = """CASE WHEN transaction > 0 THEN 'buyer' WHEN addtocart > 0 THEN 'cart_user' WHEN view > 0 THEN 'browser' ELSE 'inactive' END"""


def pivot(by: str) -> str:
    return f"""pv AS (SELECT {by}, count(*) FILTER (event = 'view') AS view, count(*) FILTER (event = 'addtocart') AS addtocart, count(*) FILTER (event = 'transaction') AS transaction FROM ev GROUP BY ALL)"""


SHARES = f"""SELECT user_type, n, round(n * 100.0::DOUBLE / sum(n) OVER (), 6) AS pct FROM (SELECT {TYPES} AS user_type, count(*) AS n FROM pv GROUP BY 1)"""
STATS = """SELECT categoryid, round(avg(popularity_score), 6) AS avg_popularity, round(avg(transaction_count * 100.0::DOUBLE / CASE WHEN view_count = 0 THEN 1 ELSE view_count END), 6) AS avg_conversion_rate, round(avg(unique_users), 6) AS avg_unique_users, count(itemid) AS item_count
FROM ft WHERE categoryid IS NOT NULL GROUP BY categoryid"""
RATE = "CASE WHEN {1} > 0 THEN round({0} * 100.0::DOUBLE / {1}, 6) ELSE 0.0::DOUBLE END AS {2}"

ORACLE_SQL = {
    "csv_events": f"WITH {EVENTS} SELECT date_trunc('millisecond', ts) AS ts, visitorid, event, itemid FROM ev",
    "csv_session_lengths": f"WITH {EVENTS}, {marks(30)} SELECT event_count, count(*) AS n FROM ss GROUP BY 1".replace("SELECT event_id, ts,", "SELECT event_id, date_trunc('millisecond', ts) AS ts,"),
    "csv_item_properties": f"WITH {PROPERTIES} SELECT itemid, property, value FROM pr",
    "csv_category_tree": f"WITH {TREE} SELECT categoryid, parentid FROM tr",
    "csv_unparsed_fields": "SELECT 'itemid' AS column_name, count(*) FILTER (try_cast(CAST(p_partkey AS VARCHAR) AS BIGINT) IS NULL) AS n FROM part UNION ALL SELECT 'value', count(*) FILTER (try_cast(p_brand AS BIGINT) IS NULL) FROM part",
    "csv_rejected_records": "SELECT 'timestamp' AS column_name, '9223372036854775807' AS field, 'out of range' AS reason, count(*) AS n FROM events WHERE event_id % 97 = 0 HAVING count(*) > 0 UNION ALL SELECT 'itemid', 'item', 'not bigint', count(*) FROM events WHERE event_id % 89 = 0 HAVING count(*) > 0 UNION ALL SELECT NULL, NULL, 'ragged', count(*) FROM events WHERE event_id % 83 = 0 HAVING count(*) > 0",
    "unparsed_values": f"WITH {PROPERTIES} SELECT property, count(*) FILTER (value IS NOT NULL AND try_cast(value AS BIGINT) IS NULL) AS n FROM pr WHERE property IN ('categoryid', 'available') GROUP BY 1",
    "latest_category_mapping": f"WITH {PROPERTIES} SELECT itemid, arg_max(CAST(value AS BIGINT), length(value) * 1000000 + CAST(value AS BIGINT)) AS categoryid FROM pr WHERE property = 'categoryid' GROUP BY 1",
    "session_sequence_blocks": f"WITH {EVENTS}, {marks(720)}, p4 AS (SELECT *, (row_number() OVER (PARTITION BY visitorid, session_id ORDER BY ts, event_id) - 1) // 4 AS block FROM mk) SELECT visitorid, session_id, block, string_agg(CAST(itemid AS VARCHAR), ',' ORDER BY ts, event_id) AS items, string_agg(event, ',' ORDER BY ts, event_id) AS events FROM p4 GROUP BY 1, 2, 3",
    "dataset_shapes": f"WITH {EVENTS}, {PROPERTIES}, {TREE} SELECT 'events' AS dataset, count(*) AS n_rows, 5::INTEGER AS n_columns, 'event_id,ts,visitorid,event,itemid' AS column_names FROM ev UNION ALL SELECT 'item_properties', count(*), 3, 'itemid,property,value' FROM pr UNION ALL SELECT 'category_tree', count(*), 2, 'categoryid,parentid' FROM tr",
    "events_sample": f"WITH {EVENTS} SELECT * FROM ev ORDER BY event_id LIMIT 5",
    "null_percentages": f"WITH {EVENTS} " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, round(avg(({c} IS NULL)::INT) * 100, 6) AS null_pct FROM ev" for c in ("event_id", "ts", "visitorid", "event", "itemid")),
    "event_type_counts": f"WITH {EVENTS} SELECT event, count(*) AS n FROM ev WHERE event IS NOT NULL GROUP BY event",
    "conversion_funnel": f"WITH {EVENTS}, c AS (SELECT count(*) FILTER (event = 'view') AS views, count(*) FILTER (event = 'addtocart') AS carts, count(*) FILTER (event = 'transaction') AS transactions FROM ev) SELECT *, {RATE.format('carts', 'views', 'view_to_cart_rate')}, {RATE.format('transactions', 'carts', 'cart_to_transaction_rate')}, {RATE.format('transactions', 'views', 'view_to_transaction_rate')} FROM c",
    "event_time_span": "SELECT min(ts) AS first_ts, max(ts) AS last_ts, CAST(floor(date_diff('microsecond', min(ts), max(ts)) / 86400000000.0::DOUBLE) AS BIGINT) AS n_days FROM events",
    "daily_event_counts": "SELECT CAST(ts AS DATE) AS date, count(event_type) AS n FROM events GROUP BY 1",
    "daily_event_average": "SELECT round(avg(n), 6) AS avg_daily_events FROM (SELECT count(event_type) AS n FROM events GROUP BY CAST(ts AS DATE))",
    "hourly_event_counts": "SELECT CAST(hour(ts) AS INTEGER) AS hour, count(event_type) AS n FROM events GROUP BY 1",
    "weekday_event_counts": "SELECT CAST(isodow(ts) - 1 AS INTEGER) AS weekday, dayname(ts) AS day_name, count(event_type) AS n FROM events GROUP BY 1, 2",
    "visitor_item_summary": f"WITH {EVENTS} SELECT count(DISTINCT visitorid) AS unique_visitors, count(*) AS total_events, count(DISTINCT itemid) AS unique_items, round(count(*) / count(DISTINCT visitorid), 6) AS avg_events_per_visitor FROM ev",
    "top_items": f"WITH {EVENTS} SELECT itemid, count(*) AS n FROM ev WHERE itemid IS NOT NULL GROUP BY itemid ORDER BY n DESC, itemid LIMIT 20",
    "longtail_concentration": "WITH c AS (SELECT l_partkey, count(*) AS c FROM lineitem GROUP BY 1), r AS (SELECT c, row_number() OVER (ORDER BY c DESC, l_partkey) AS i, count(*) OVER () AS n FROM c) SELECT max(n) AS n_items, CAST(floor(max(n) * 0.01::DOUBLE) AS BIGINT) AS n_top_items, round(coalesce(sum(c) FILTER (i <= floor(n * 0.01::DOUBLE)), 0) * 100.0::DOUBLE / sum(c), 6) AS concentration_ratio FROM r",
    "item_popularity_histogram": "SELECT CAST(floor(log10(c) / 0.1::DOUBLE) AS BIGINT) AS bin, count(*) AS n_items FROM (SELECT l_partkey, count(*) AS c FROM lineitem GROUP BY 1) GROUP BY 1",
    "property_counts": f"WITH {PROPERTIES} SELECT property, count(*) AS n FROM pr GROUP BY 1",
    "category_item_counts": f"WITH {PROPERTIES} SELECT categoryid, count(*) AS n FROM mp GROUP BY 1",
    "category_mapping_summary": f"WITH {PROPERTIES} SELECT count(*) AS n_rows, count(DISTINCT itemid) AS unique_items, count(DISTINCT categoryid) AS unique_categories FROM mp",
    "availability_ratio": f"WITH {PROPERTIES} SELECT round(avg((value = '1')::INT) * 100, 6) AS available_pct FROM pr WHERE property = 'available'",
    "events_with_category": f"WITH {EVENTS}, {PROPERTIES} SELECT event_id, visitorid, itemid, event, categoryid FROM ev LEFT JOIN mp USING (itemid)",
    "category_event_counts": f"WITH {EVENTS}, {PROPERTIES} SELECT categoryid, count(*) AS n FROM ev JOIN mp USING (itemid) GROUP BY 1",
    "top_categories": f"WITH {EVENTS}, {PROPERTIES} SELECT categoryid, count(*) AS n FROM ev JOIN mp USING (itemid) GROUP BY 1 ORDER BY n DESC, categoryid LIMIT 20",
    "tree_summary": f"WITH RECURSIVE {TREE}, {DEPTHS} SELECT (SELECT count(*) FROM tr) AS total_nodes, (SELECT count(DISTINCT categoryid) FROM tr) AS unique_categories, (SELECT count(*) FROM tr WHERE parentid IS NULL) AS root_categories, CAST(max(depth) AS INTEGER) AS max_depth, round(avg(depth), 6) AS avg_depth FROM dp",
    "tree_root_depths": f"WITH RECURSIVE {TREE}, {DEPTHS} SELECT root, CAST(depth AS INTEGER) AS depth FROM dp",
    "tree_children_counts": f"WITH {TREE} SELECT parentid, count(*) AS n FROM tr WHERE parentid IS NOT NULL GROUP BY 1 ORDER BY n DESC, parentid LIMIT 10",
    "graph_degrees": f"WITH {TREE}, {DEGREES} SELECT *, greatest(8.0::DOUBLE, least(25.0::DOUBLE, 8 + 0.5::DOUBLE * out_degree)) AS size, out_degree >= 5 AS labelled FROM dg",
    "graph_trimmed_edges": f"WITH {TREE}, {DEGREES}, core AS (SELECT node FROM dg ORDER BY degree DESC, node LIMIT 150), ed AS (SELECT parentid AS src, categoryid AS dst FROM tr WHERE parentid IS NOT NULL), kept AS (SELECT node FROM core UNION SELECT dst FROM ed WHERE src IN (SELECT node FROM core) UNION SELECT src FROM ed WHERE dst IN (SELECT node FROM core)) SELECT DISTINCT src, dst FROM ed WHERE (SELECT count(*) FROM dg) <= 200 OR (src IN (SELECT node FROM kept) AND dst IN (SELECT node FROM kept))",
    "graph_layout": f"WITH RECURSIVE {TREE}, {DEGREES}, core AS (SELECT node FROM dg ORDER BY degree DESC, node LIMIT 150), ed AS (SELECT parentid AS src, categoryid AS dst FROM tr WHERE parentid IS NOT NULL), kept AS (SELECT node FROM core UNION SELECT dst FROM ed WHERE src IN (SELECT node FROM core) UNION SELECT src FROM ed WHERE dst IN (SELECT node FROM core)), tm AS (SELECT DISTINCT src, dst FROM ed WHERE (SELECT count(*) FROM dg) <= 200 OR (src IN (SELECT node FROM kept) AND dst IN (SELECT node FROM kept))), lv(node, root, y) AS (SELECT DISTINCT src, src, 0 FROM tm WHERE src NOT IN (SELECT dst FROM tm) UNION ALL SELECT t.dst, l.root, l.y + 1 FROM lv l JOIN tm t ON t.src = l.node), en AS (SELECT src AS node, 1 AS o FROM tm UNION ALL SELECT dst, 0 FROM tm), sz AS (SELECT node, CAST(sum(o) AS BIGINT) AS o FROM en GROUP BY node) SELECT l.node, CAST(row_number() OVER (PARTITION BY y ORDER BY root, l.node) AS INTEGER) AS x, CAST(y AS INTEGER) AS y, greatest(8.0::DOUBLE, least(25.0::DOUBLE, 8 + 0.5::DOUBLE * o)) AS size, o >= 5 AS labelled FROM lv l JOIN sz ON sz.node = l.node",
    "graph_trimmed_edges_50_20": f"WITH {TREE}, {DEGREES}, core AS (SELECT node FROM dg ORDER BY degree DESC, node LIMIT 20), ed AS (SELECT parentid AS src, categoryid AS dst FROM tr WHERE parentid IS NOT NULL), kept AS (SELECT node FROM core UNION SELECT dst FROM ed WHERE src IN (SELECT node FROM core) UNION SELECT src FROM ed WHERE dst IN (SELECT node FROM core)) SELECT DISTINCT src, dst FROM ed WHERE (SELECT count(*) FROM dg) <= 50 OR (src IN (SELECT node FROM kept) AND dst IN (SELECT node FROM kept))",
    "user_event_pivot": f"WITH {EVENTS}, {pivot('visitorid')} SELECT *, {TYPES} AS user_type FROM pv",
    "user_type_distribution": f"WITH {EVENTS}, {pivot('visitorid')} {SHARES}",
    "user_day_type_distribution": f"WITH {EVENTS}, {pivot('visitorid, CAST(ts AS DATE) AS date')} {SHARES}",
    "user_category_preference": f"WITH {EVENTS}, {PROPERTIES}, {PAIRS} SELECT * FROM pf",
    "user_top_category": f"WITH {EVENTS}, {PROPERTIES}, {PAIRS} SELECT visitorid, categoryid, interaction_count FROM (SELECT *, row_number() OVER (PARTITION BY visitorid ORDER BY interaction_count DESC, categoryid) AS i FROM pf) WHERE i = 1",
    "users_with_category_preference": f"WITH {EVENTS}, {PROPERTIES}, {PAIRS} SELECT count(DISTINCT visitorid) AS n_users FROM pf",
    "item_features": f"WITH {EVENTS}, {PROPERTIES}, {FEATURES} SELECT * FROM ft",
    "item_visitors_of_days": f"WITH {EVENTS} SELECT itemid, count(*) AS n_events, count(DISTINCT visitorid) AS n_distinct FROM ev WHERE itemid IS NOT NULL AND visitorid IS NOT NULL AND ts IS NOT NULL GROUP BY itemid",
    "item_features_summary": f"WITH {EVENTS}, {PROPERTIES}, {FEATURES} SELECT count(*) AS total_items_analyzed, count(categoryid) AS items_with_category FROM ft",
    "top_items_by_popularity": f"WITH {EVENTS}, {PROPERTIES}, {FEATURES} SELECT itemid, popularity_score, conversion_rate, categoryid FROM ft ORDER BY popularity_score DESC, itemid, categoryid LIMIT 20",
    "category_item_stats": f"WITH {EVENTS}, {PROPERTIES}, {FEATURES} {STATS}",
    "top_category_item_stats": f"WITH {EVENTS}, {PROPERTIES}, {FEATURES} {STATS} ORDER BY avg_popularity DESC, categoryid LIMIT 10",
    "sessions": f"WITH {EVENTS}, {marks_with_sequences(30)} SELECT * FROM ss",
    "sessions_120": f"WITH {EVENTS}, {marks_with_sequences(120)} SELECT * FROM ss",
    "session_summary": f"WITH {EVENTS}, {marks(30)} SELECT count(*) AS total_sessions, round(avg(event_count), 6) AS avg_session_length, round(avg(date_diff('microsecond', session_start, session_end) / 60000000.0::DOUBLE), 6) AS avg_session_duration, round(avg(unique_items), 6) AS avg_unique_items FROM ss",
    "session_pattern_distribution": f"WITH {EVENTS}, {marks(30)} SELECT session_pattern, n, round(n * 100.0::DOUBLE / sum(n) OVER (), 6) AS pct FROM (SELECT session_pattern, count(*) AS n FROM ss GROUP BY 1)",
    "session_length_distribution": f"WITH {EVENTS}, {marks(30)} SELECT event_count, count(*) AS n FROM ss GROUP BY 1",
    "session_length_distribution_720": f"WITH {EVENTS}, {marks(720)} SELECT event_count, count(*) AS n FROM ss GROUP BY 1",
    "conversion_by_session_length": f"WITH {EVENTS}, {marks(30)} SELECT event_count AS session_length, round(avg((session_pattern = 'conversion')::INT) * 100, 6) AS conversion_rate FROM ss GROUP BY 1 ORDER BY 1 LIMIT 10",
    "conversion_by_session_length_720": f"WITH {EVENTS}, {marks(720)} SELECT event_count AS session_length, round(avg((session_pattern = 'conversion')::INT) * 100, 6) AS conversion_rate FROM ss GROUP BY 1 ORDER BY 1 LIMIT 10",
    "streamed_sessions": f"WITH {EVENTS}, {marks(30)} SELECT visitorid, event_id, event, itemid, session_id, is_start, CASE WHEN NOT is_start THEN prev END AS prev_item, row_number() OVER (PARTITION BY visitorid, session_id ORDER BY ts, event_id) AS position FROM mk WHERE ts < (SELECT date_trunc('millisecond', max(ts)) FROM ev)",
    "item_transitions": f"WITH {EVENTS}, {marks(30)} SELECT prev AS from_item, itemid AS to_item, count(*) AS n FROM mk WHERE NOT is_start GROUP BY 1, 2",
    "item_transitions_720": f"WITH {EVENTS}, {marks(720)} SELECT prev AS from_item, itemid AS to_item, count(*) AS n FROM mk WHERE NOT is_start GROUP BY 1, 2",
    "item_transitions_top": f"WITH {EVENTS}, {marks(30)} SELECT prev AS from_item, itemid AS to_item, count(*) AS n FROM mk WHERE NOT is_start GROUP BY 1, 2 ORDER BY n DESC, from_item, to_item LIMIT 20",
    "user_activity_stats": f"WITH {EVENTS}, {activity('ev')} SELECT visitorid, total_events, unique_items, first_activity, last_activity, round(activity_days, 6) AS activity_days, round(daily_avg_events, 6) AS daily_avg_events FROM us",
    "user_anomalies": ANOMALIES + "SELECT * FROM an",
    "anomaly_summary": ANOMALIES + "SELECT count(*) AS total_users, count(*) FILTER (anomaly_score >= 2) AS anomaly_users, round(count(*) FILTER (anomaly_score >= 2) * 100.0::DOUBLE / count(*), 6) AS anomaly_ratio FROM an",
    "top_anomalies": ANOMALIES + "SELECT * FROM an WHERE anomaly_score >= 2 ORDER BY total_events DESC, visitorid LIMIT 10",
}


def figure(shown: int) -> str:
    """The tree's three layers, each in the order of the mean place of its nodes' parents: a forest arranged so has no crossings to sweep away."""
    return ORACLE_SQL["graph_layout"].split(", lv(")[0] + f""", bl AS (SELECT src AS node, count(*) AS c FROM tm GROUP BY src),
rk AS (SELECT tm.src, tm.dst, row_number() OVER (PARTITION BY tm.src ORDER BY coalesce(d.c, 0) DESC, tm.dst) AS r1, row_number() OVER (PARTITION BY tm.dst ORDER BY s.c DESC, tm.src) AS r2 FROM tm JOIN bl s ON s.node = tm.src LEFT JOIN bl d ON d.node = tm.dst),
fe AS (
  SELECT CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst, 1 AS n FROM rk WHERE r1 <= {shown} AND r2 <= {shown}
  UNION ALL SELECT CAST(node AS VARCHAR), 'children of ' || node, c - {shown} FROM bl WHERE c > {shown}),
l0 AS (SELECT CAST(src AS VARCHAR) AS node, row_number() OVER (ORDER BY src) AS x FROM (SELECT DISTINCT src FROM tm WHERE src NOT IN (SELECT dst FROM tm))),
l1 AS (SELECT dst AS node, row_number() OVER (ORDER BY avg(x), dst) AS x FROM fe JOIN l0 ON node = src GROUP BY dst),
l2 AS (SELECT dst AS node, row_number() OVER (ORDER BY avg(x), dst) AS x FROM fe JOIN l1 ON node = src GROUP BY dst),
pl AS (SELECT node, x, 0 AS y FROM l0 UNION ALL SELECT node, x, 1 FROM l1 UNION ALL SELECT node, x, 2 FROM l2)"""


def figure_nodes(shown: int) -> str:
    return figure(shown) + f""" SELECT pl.node, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(coalesce(r.n, 1) AS BIGINT) AS n, greatest(8.0::DOUBLE, least(25.0::DOUBLE, 8 + 0.5::DOUBLE * coalesce(o.c, 0))) AS size,
  coalesce(o.c, 0) >= 5 OR r.n IS NOT NULL AS labelled, CAST(greatest(0, coalesce(i.c, 0) - {shown}) AS BIGINT) AS parents_left_out
FROM pl LEFT JOIN (SELECT CAST(node AS VARCHAR) AS node, c FROM bl) o USING (node) LEFT JOIN (SELECT CAST(dst AS VARCHAR) AS node, count(*) AS c FROM tm GROUP BY dst) i USING (node)
LEFT JOIN (SELECT dst AS node, n FROM fe WHERE dst LIKE 'children of %') r USING (node)"""


ORACLE_SQL |= {
    "graph_figure": figure_nodes(12),
    "graph_figure_3": figure_nodes(3),
    "graph_crossings": figure(12) + """, ps AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY node) AS i FROM pl),
ee AS (SELECT s.y, s.x AS sx, s.i AS si, d.x AS dx, d.i AS di FROM fe JOIN ps s ON s.node = fe.src JOIN ps d ON d.node = fe.dst AND d.y = s.y + 1)
SELECT (SELECT count(*) FROM ee a JOIN ee b ON a.y = b.y AND a.si < b.si AND a.di > b.di) AS by_id, (SELECT count(*) FROM ee a JOIN ee b ON a.y = b.y AND a.sx < b.sx AND a.dx > b.dx) AS in_figure""",
}
