"""Numbered sessions over a stream: the batch's session numbers, previous items and positions, event by event.

State by bucket of visitors: the open session of each, and the events that may still be overtaken. An event waits until the watermark has passed its time, so
events come out in order whatever the disorder within the delay, and the result is that of `operators.sessions.sessionized`. A call to Python or to the
state costs far more than an event, so a bucket makes them once for all of its visitors, and keeps its rows as Arrow tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from clickweave.operators.sessions import GAP_MINUTES

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MARKED = "visitorid long, event_id long, at long, event string, itemid long, session_id long, is_start boolean, prev_item long, position long"
COLUMNS = ["visitorid", "event_id", "ts", "event", "itemid", "session_id", "is_start", "prev_item", "position"]
#: Buckets of visitors: a batch rewrites the open sessions of the buckets that it meets, and a task holds one bucket at a time.
BUCKETS = 1024
#: Rows in one value of the state.
CHUNK = 20_000
WAITING = pa.schema([("visitorid", pa.int64()), ("at", pa.int64()), ("event_id", pa.int64()), ("event", pa.string()), ("itemid", pa.int64())])
OPEN = pa.schema([("visitorid", pa.int64()), ("session", pa.int64()), ("at", pa.int64()), ("itemid", pa.int64()), ("position", pa.int64())])


def packed(rows: pa.Table) -> list[tuple[bytes]]:
    """`rows` as values of the state."""
    values = []
    for i in range(0, len(rows), CHUNK):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema) as out:
            out.write_table(rows.slice(i, CHUNK))
        values.append((sink.getvalue().to_pybytes(),))
    return values


def unpacked(values: Iterator[tuple], schema: pa.Schema) -> pa.Table:
    return pa.concat_tables([schema.empty_table(), *[pa.ipc.open_stream(bytes(x[0])).read_all() for x in values]])


def ints(column: pa.ChunkedArray) -> np.ndarray:
    return column.fill_null(0).to_numpy()


def number(ready: pa.Table, before: pa.Table, gap: int) -> tuple[pa.Table, pa.Table]:
    """Marked rows of `ready`, in order, and the open sessions `before` them as they are after them; times are microseconds since 1970."""
    ready = ready.sort_by([("visitorid", "ascending"), ("at", "ascending"), ("event_id", "ascending")])
    n, visitor, at = len(ready), ints(ready["visitorid"]), ints(ready["at"])
    row = np.arange(n)
    first = np.append(True, visitor[1:] != visitor[:-1])
    last = np.append(first[1:], True)
    begin = np.maximum.accumulate(np.where(first, row, 0))  # the first row of the visitor
    # each visitor's open session, if it has one
    before = before.sort_by("visitorid")
    known = ints(before["visitorid"])
    place = np.searchsorted(known, visitor)
    has = np.append(known, 0)[place] == visitor if len(known) else np.zeros(n, bool)
    has &= place < len(known)
    place = np.where(has, place, len(known))
    session, then, position = (np.append(ints(before[c]), 0)[place] for c in ("session", "at", "position"))
    held = pa.chunked_array([*before["itemid"].chunks, pa.nulls(1, pa.int64())])
    earlier = np.where(first, then, np.append(0, at[:-1]))
    start = (first & ~has) | (at - earlier > gap)
    starts = np.cumsum(start)
    session = session + starts - (starts - start)[begin]
    since = np.maximum.accumulate(np.where(start, row, -1))  # the last start, of this visitor or one before
    position = np.where(since >= begin, row - since + 1, position + row - begin + 1)
    # the item before, from the rows or from the open session
    items = pa.chunked_array([*ready["itemid"].chunks, *held.chunks])
    source = np.where(first, n + place, row - 1)
    previous = items.take(pa.array(source, mask=start))
    marked = pa.table({
        "visitorid": visitor, "event_id": ready["event_id"], "at": at, "event": ready["event"], "itemid": ready["itemid"], "session_id": session, "is_start": start, "prev_item": previous, "position": position,
    })
    left = before.filter(pa.array(~np.isin(known, visitor)))
    ends = pa.table({"visitorid": visitor[last], "session": session[last], "at": at[last], "itemid": ready["itemid"].filter(pa.array(last)), "position": position[last]}, schema=OPEN)
    return marked, pa.concat_tables([left, ends])


class Numbering(StatefulProcessor):
    """Numbers the sessions of one bucket's visitors."""

    def __init__(self, gap_minutes: float):
        self.gap = int(gap_minutes * 60_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "rows binary")
        self.waiting = handle.getListState("waiting", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            came = pa.table({f.name: pa.array(part[f.name], f.type, from_pandas=True) for f in WAITING}, schema=WAITING)
            self.waiting.appendList(packed(came))
            self.wake(ints(came["at"]))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = 1000 * timerValues.getCurrentWatermarkInMs()
        held = unpacked(self.waiting.get(), WAITING)
        due = ints(held["at"]) < passed
        ready, left = held.filter(pa.array(due)), held.filter(pa.array(~due))
        if len(left):
            self.waiting.put(packed(left))
        else:
            self.waiting.clear()
        self.wake(ints(left["at"]))
        if len(ready):
            marked, after = number(ready, unpacked(self.open.get(), OPEN), self.gap)
            self.open.put(packed(after))
            for i in range(0, len(marked), CHUNK):
                yield marked.slice(i, CHUNK).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)

    def wake(self, times: np.ndarray) -> None:
        """A timer for the moment after the earliest of `times` and, as timers are few, for no other."""
        if len(times):
            due = int(times.min()) // 1000 + 1
            if all(t > due for t in self.handle.listTimers()):
                self.handle.registerTimer(due)

    def close(self) -> None:
        pass


def stream_numbered(events: DataFrame, gap_minutes: float = GAP_MINUTES, delay: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """`sessionized` of a streaming frame with event_id, visitorid, ts (timestamp), event and itemid; append mode.

    `delay` must cover the disorder of the stream; later events are dropped. An event comes out when the watermark has passed it. Rows without a visitor or
    a time are left out. The session needs RocksDB as its state store (`ROCKSDB` as ``spark.sql.streaming.stateStore.providerClass``). `buckets` must stay
    the same over restarts.
    """
    rows = events.filter("visitorid IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", delay)
    # numbers of the time, as pandas has times of the session's zone, and the watermark none
    rows = rows.select(F.pmod(F.xxhash64("visitorid"), F.lit(buckets)).cast("int").alias("bucket"), "visitorid", "event_id", "ts", F.unix_micros("ts").alias("at"), "event", "itemid")
    found = rows.groupBy("bucket").transformWithStateInPandas(Numbering(gap_minutes), MARKED, "Append", "EventTime")
    return found.withColumn("ts", F.timestamp_micros("at")).select(*COLUMNS)
