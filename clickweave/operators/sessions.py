"""Sessions by inactivity, their statistics, and item-to-item transitions.

Events are dealt over ranges of (visitor, time, event) of about the same number of rows, so that neither a busy visitor nor a busy day is one
group. Windows number the starts within a range. What goes on over the cuts is a prefix scan: a range sends on at most two rows, for the visitors at its ends, and
the sums of those give back each range's first session number, last event and place in the session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickweave.functions.columns import MICROS_PER_MINUTE, micros, session_pattern
from clickweave.shared import stored

GAP_MINUTES = 30.0


def in_ranges(events: DataFrame, ranges: int | None = None) -> DataFrame:
    """`events` with `_range`, dealt and sorted by visitor, time and event_id. To be stored before use, as every reading must find the same cuts."""
    n = ranges or int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ("visitorid", "ts", "event_id")
    return events.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id())


def sessionized(events: DataFrame, gap_minutes: float = GAP_MINUTES, ranges: int | None = None) -> DataFrame:
    """Events with session_id (from 1 for each visitor), is_start, prev_item, the item before it in the session, and its position there (from 1).

    A session ends at a gap of more than `gap_minutes`. Equal times are ordered by event_id. Writes the dealt events to the shared folder.
    """
    return numbered(stored(in_ranges(events.filter("visitorid IS NOT NULL AND ts IS NOT NULL"), ranges)), gap_minutes)


def numbered(dealt: DataFrame, gap_minutes: float = GAP_MINUTES) -> DataFrame:
    """`sessionized` of events that are stored in ranges (see `in_ranges`)."""
    given = [c for c in dealt.columns if c != "_range"]
    gap = F.lit(int(gap_minutes * MICROS_PER_MINUTE))
    run = Window.partitionBy("_range", "visitorid").orderBy("ts", "event_id")
    so_far = run.rowsBetween(Window.unboundedPreceding, 0)

    def within(rows: DataFrame) -> DataFrame:
        """Starts after the first event of a visitor's run in a range: `_n` of them so far, the last at row `_at`."""
        rows = rows.withColumns({"_before": F.lag("ts").over(run), "_item": F.lag("itemid").over(run), "_row": F.row_number().over(run)})
        rows = rows.withColumn("_new", F.when(F.col("_before").isNotNull(), micros(F.col("_before"), F.col("ts")) > gap).otherwise(False))
        return rows.withColumns({"_n": F.sum(F.col("_new").cast("int")).over(so_far), "_at": F.max(F.when(F.col("_new"), F.col("_row"))).over(so_far)})

    rows = dealt.filter("visitorid IS NOT NULL AND ts IS NOT NULL")
    ends = rows.groupBy("_range").agg(F.min("visitorid").alias("_low"), F.max("visitorid").alias("_high"))  # a row for each range
    at_ends = within(rows.join(F.broadcast(ends), "_range").filter("visitorid = _low OR visitorid = _high"))
    last = F.struct("ts", "event_id", "itemid")
    runs = at_ends.groupBy("visitorid", "_range").agg(F.min("ts").alias("first"), F.max(last).alias("last"), F.sum(F.col("_new").cast("int")).alias("starts"), F.count("*").cast("bigint").alias("rows"), F.max("_at").alias("at"))
    # the scan, over two rows a range at most; a run's first event is a start if the last event before it is too long ago
    order = Window.partitionBy("visitorid").orderBy("_range")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    runs = runs.withColumn("prior", F.lag("last").over(order))
    runs = runs.withColumn("opens", F.col("prior").isNull() | (micros(F.col("prior.ts"), F.col("first")) > gap))
    runs = runs.withColumns({"offset": F.sum(F.col("starts") + F.col("opens").cast("int")).over(upto) - F.col("starts"), "earlier": F.sum("rows").over(upto) - F.col("rows")})
    # the number, among all of the visitor's events, of the event that starts the session which goes on into the range
    begun = F.max(F.col("earlier") + F.coalesce("at", F.when(F.col("opens"), F.lit(1)))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("origin", F.when(F.col("opens"), F.col("earlier") + 1).otherwise(begun))
    carried = runs.select("visitorid", "_range", F.col("prior.itemid").alias("_prior_item"), "opens", "offset", "earlier", "origin")

    joined = within(rows).join(F.broadcast(carried), ["visitorid", "_range"], "left")
    first, earlier = F.col("_before").isNull(), F.coalesce("earlier", F.lit(0))
    start = F.when(first, F.coalesce("opens", F.lit(True))).otherwise(F.col("_new"))
    position = earlier + F.col("_row") + 1 - F.coalesce(earlier + F.col("_at"), "origin", F.lit(1))
    return joined.select(*given, (F.coalesce("offset", F.lit(1)) + F.col("_n")).cast("bigint").alias("session_id"), start.alias("is_start"), F.when(~start, F.when(first, F.col("_prior_item")).otherwise(F.col("_item"))).alias("prev_item"), position.cast("bigint").alias("position"))


def sequence_blocks(marked: DataFrame, size: int = 1000) -> DataFrame:
    """The items and events of sessions in order, in arrays of `size` at most: visitorid, session_id, block (from 0), items, events.

    However long a session is, no row holds more of it than a block.
    """
    step = F.struct("position", "itemid", "event")
    found = marked.groupBy("visitorid", "session_id", F.floor((F.col("position") - 1) / F.lit(size)).cast("bigint").alias("block")).agg(F.array_sort(F.collect_list(step)).alias("steps"))
    return found.select("visitorid", "session_id", "block", F.transform("steps", lambda x: x["itemid"]).alias("items"), F.transform("steps", lambda x: x["event"]).alias("events"))


def sessions(marked: DataFrame) -> DataFrame:
    """One row a session: its ends, events, distinct items (folded by session and item), pattern and minutes; whatever its length, no row holds a list."""
    found = marked.groupBy("visitorid", "session_id").agg(
        F.min("ts").alias("session_start"), F.max("ts").alias("session_end"), F.count("ts").alias("event_count"), F.count_distinct("itemid").alias("unique_items"), session_pattern(F.col("event")).alias("session_pattern"),
    )
    return found.withColumn("session_duration_minutes", micros(F.col("session_start"), F.col("session_end")) / F.lit(float(MICROS_PER_MINUTE)))


def session_sequences(marked: DataFrame, size: int = 1000) -> DataFrame:
    """`sessions` with their items and events in order: a row for each `block` (from 0) of `size` events, so one row for a session of up to `size`.

    `marked` is stored first, as both sides of the join need it.
    """
    marked = stored(marked)
    blocks = sequence_blocks(marked, size).withColumnsRenamed({"items": "item_sequence", "events": "event_sequence"})
    return sessions(marked).join(blocks, ["visitorid", "session_id"])


def session_texts(marked: DataFrame, size: int = 1000) -> DataFrame:
    """`sessions` with their whole items and events in order, as text parted by commas: one row a session, however long it is.

    A text is put together from those of the session's blocks; as in SQL, nulls are left out, and nothing but nulls is null.
    """
    marked = stored(marked)
    text = lambda c: F.when(F.exists(c, lambda x: x.isNotNull()), F.array_join(F.transform(c, lambda x: x.cast("string")), ","))
    blocks = sequence_blocks(marked, size).select("visitorid", "session_id", F.struct("block", text("items").alias("items"), text("events").alias("events")).alias("b"))
    whole = blocks.groupBy("visitorid", "session_id").agg(F.array_sort(F.collect_list("b")).alias("b"))
    return sessions(marked).join(whole.select("visitorid", "session_id", text("b.items").alias("item_sequence"), text("b.events").alias("event_sequence")), ["visitorid", "session_id"])


def summary(found: DataFrame) -> DataFrame:
    return found.agg(F.count("*").alias("total_sessions"), F.avg("event_count").alias("avg_session_length"), F.avg("session_duration_minutes").alias("avg_session_duration"), F.avg("unique_items").alias("avg_unique_items"))


def pattern_distribution(found: DataFrame) -> DataFrame:
    counts = found.groupBy("session_pattern").agg(F.count("*").alias("n"))
    return counts.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()))


def length_distribution(found: DataFrame) -> DataFrame:
    return found.groupBy("event_count").agg(F.count("*").alias("n"))


def conversion_by_length(found: DataFrame, top: int = 10) -> DataFrame:
    """Per cent of converting sessions for the `top` shortest lengths."""
    rate = F.avg((F.col("session_pattern") == "conversion").cast("int")) * 100
    return found.groupBy(F.col("event_count").alias("session_length")).agg(rate.alias("conversion_rate")).orderBy("session_length").limit(top)


def transitions(marked: DataFrame, top: int | None = 20) -> DataFrame:
    """How often an item follows another (or itself) in a session."""
    found = marked.filter("NOT is_start AND prev_item IS NOT NULL AND itemid IS NOT NULL").groupBy(F.col("prev_item").alias("from_item"), F.col("itemid").alias("to_item")).agg(F.count("*").alias("n"))
    return found if top is None else found.orderBy(F.desc("n"), "from_item", "to_item").limit(top)
