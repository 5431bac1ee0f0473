"""Filter interaction audit: what each filter of a chain removes, in every order of the filters, by part of the corpus.

Each partition packs its rows into a bitmap index: one bitset of 64-bit words for each filter and each label, in which the rows of a part
fill words of their own, so a part's bitset is a run of words. For each subset of filters, the rows that none of them fails are the part's
bits AND NOT the filters' bits; popcounts of these words, with and without each label, are all that a partition sends on. Sums of them over
the partitions give each order's steps: what a step removes depends only on which filters stand before it.

Repeated texts are told by SHA-256: the smallest id of each text is found by an aggregate with map-side combination, and joined back by id and
digest, so that a text which a third of all rows share is no group of rows anywhere.

Defined results: a null text is empty, a null part is the empty string; rows without an id never count as repeats; rows of one id and one text
are no repeats of each other; of several labels of one id, any 1 counts; repeated rows count each; an empty table gives no rows; columns of
other names take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Rows, discard, stored, table

#: The five filters of the query, as letters.
FILTERS = "ABCDE"
#: Bytes that filters C and D look for.
CAPITALS, MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
#: Parts that a partition adds up before it sends them on.
HELD = 4096


def failures(text: bytes, code_points: int) -> tuple[bool, bool, bool, bool]:
    """Whether a text fails filters A to D; bytes.split() parts at the white space of ASCII alone."""
    words = text.split()
    n = len(words)
    return n < 50, 100 * len(set(words)) < 65 * n, 100 * (len(text) - len(text.translate(None, CAPITALS))) > 5 * code_points, len(text.translate(None, MARKS)) < len(text)


def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        fails = [failures(b, n) for b, n in zip(texts, batch.column("n").to_pylist(), strict=True)]
        columns = [pa.array([f[i] for f in fails], pa.bool_()) for i in range(4)]
        digests = pa.array([hashlib.sha256(b).digest() for b in texts], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("part"), digests, *columns], ["id", "part", "digest", *FILTERS[:4]])


def flags(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """part, one boolean a filter (true: fails) and the booleans good and toxic, for each document. The texts are read once."""
    given, tags = Rows(docs), Rows(labels)
    value = F.coalesce(given.col(text), F.lit(""))
    rows = given.df.select(given.col(key).alias("id"), F.coalesce(given.col(part).cast("string"), F.lit("")).alias("part"), value.cast("binary").alias("text"), F.char_length(value).alias("n"))
    kind = rows.schema["id"].dataType.simpleString()
    rows = stored(rows.mapInArrow(judged, f"id {kind}, part string, digest binary, A boolean, B boolean, C boolean, D boolean"))
    first = rows.groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    known = tags.df.filter(tags.col(key).isNotNull()).groupBy(tags.col(key).alias("id")).agg(*[F.coalesce(F.bool_or(tags.col(c) == 1), F.lit(False)).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))])
    found = rows.join(known, "id", "left").join(first, ["id", "digest"], "left")
    repeat = F.col("first").isNull() & F.col("id").isNotNull()
    done = stored(found.select("part", *FILTERS[:4], repeat.alias("E"), *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]))
    discard(rows)
    return done


def tallies(filters: Sequence[str], classes: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of the rows that pass each subset of filters, by part: all of them, and those of each class."""
    subsets = 1 << len(filters)
    names = ["part", "subset", "passing", *[f"passing_{c}" for c in classes]]

    def rows(held: dict[str, np.ndarray]) -> pa.RecordBatch:
        parts = [p for p in held for _ in range(subsets)]
        counts = np.concatenate([*held.values(), np.zeros((0, 1 + len(classes)), np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(parts, pa.string()), pa.array(np.tile(np.arange(subsets, dtype=np.int32), len(held))), *[pa.array(c) for c in counts.T.astype(np.int64)]], names)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column("part").dictionary_encode()
            code = coded.indices.to_numpy()
            order = np.argsort(code, kind="stable")
            sizes = np.bincount(code)
            words = -(-sizes // 64)
            starts = np.cumsum(words) - words
            place = np.arange(len(code)) + np.repeat(64 * starts - (np.cumsum(sizes) - sizes), sizes)

            def bitset(column: np.ndarray, order=order, place=place, n=64 * int(words.sum())) -> np.ndarray:
                bits = np.zeros(n, bool)
                bits[place] = column[order]
                return np.packbits(bits).view(np.uint64)

            fails = [bitset(batch.column(f).to_numpy(zero_copy_only=False)) for f in filters]
            index = [bitset(np.ones(len(code), bool)), *[bitset(batch.column(c).to_numpy(zero_copy_only=False)) for c in classes]]
            failing = [np.zeros_like(index[0])]
            counts = np.zeros((len(sizes), subsets, len(index)), np.int64)
            for s in range(subsets):
                if s:
                    lowest = (s & -s).bit_length() - 1
                    failing.append(failing[s & (s - 1)] | fails[lowest])
                for c, bits in enumerate(index):
                    counts[:, s, c] = np.add.reduceat(np.bitwise_count(bits & ~failing[s]).astype(np.int64), starts)
            for p, x in zip(coded.dictionary.to_pylist(), counts, strict=True):
                held[p] = held[p] + x if p in held else x
            if len(held) > HELD:
                yield rows(held)
                held = {}
        yield rows(held)

    return made


def interactions(marked: DataFrame, filters: str = FILTERS, classes: Sequence[str] = ("good", "toxic"), part: str = "part") -> DataFrame:
    """part and `passing`: for each subset of the filters (a number, bit i for the i-th), a struct of the rows that fail none of them.

    `marked` has a boolean column for each filter (a letter) and each class.
    """
    names = ["passing", *[f"passing_{c}" for c in classes]]
    schema = "part string, subset int, " + ", ".join(f"{n} long" for n in names)
    counts = marked.select(F.col(part).alias("part"), *filters, *classes).mapInArrow(tallies(filters, classes), schema).groupBy("part", "subset").agg(*[F.sum(n).alias(n) for n in names])
    # as many structs as there are subsets
    return counts.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("subset", *names))).alias("passing"))


def orders(found: DataFrame, filters: str = FILTERS, classes: Sequence[str] = ("good", "toxic")) -> DataFrame:
    """A row for each part, order of the filters and step, with what the step keeps and removes; see `interactions`."""
    n = len(filters)

    def bits(letters: str) -> Column:
        """The subset of the letters, as a number."""
        return F.expr(f"aggregate(filter(split({letters}, ''), x -> x != ''), 0, (a, x) -> a | shiftleft(1, instr('{filters}', x) - 1))")

    every = F.array(*[F.lit("".join(p)) for p in permutations(filters)])
    rows = found.select("part", "passing", F.explode(every).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    rows = rows.withColumns({"before": bits("substring(filter_order, 1, step - 1)"), "own": bits("substring(filter_order, step, 1)")})
    at = lambda subset, c="passing": F.get("passing", subset)[c]
    before, own = F.col("before"), F.col("own")
    after, full = before.bitwiseOR(own), F.lit((1 << n) - 1)
    removed = at(before) - at(after)
    weights = F.array(*[F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n)])
    share = lambda s: F.when(s.bitwiseAND(own) == 0, F.get(weights, F.bit_count(s)) * (at(s) - at(s.bitwiseOR(own)))).otherwise(F.lit(0))
    return rows.select(
        "part", "filter_order", "step", at(after).alias("kept"), removed.alias("removed"),
        (at(F.lit(0)) - at(own) - removed).alias("redundant"), (at(full.bitwiseXOR(own)) - at(full)).alias("unique_fails"),
        *[(at(before, f"passing_{c}") - at(after, f"passing_{c}")).alias(f"{c}_lost") for c in classes],
        F.aggregate(F.sequence(F.lit(0), full), F.lit(0).cast("long"), lambda a, s: a + share(s).cast("long")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """Every order of the five filters over `docs`, by part; the small result is stored, and the rows that led to it are deleted."""
    marked = flags(docs, labels, key, text, part)
    counts = stored(interactions(marked))
    discard(marked)
    return orders(counts)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS words FROM documents),
f AS (SELECT doc_id, part, len(words) < 50 AS a, 100 * len(list_distinct(words)) < 65 * len(words) AS b, 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) AS c,
  regexp_matches(text, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), FALSE) AS e FROM w),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, a, b, c, d, e, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
ps AS (SELECT DISTINCT part FROM m),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
os AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM letters p, letters q, letters r, letters s, letters t WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
st AS (SELECT filter_order, step, substr(filter_order, step, 1) AS own, substr(filter_order, 1, step - 1) AS earlier FROM os, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (
  SELECT st.filter_order, st.step, st.own, m.*, CASE own WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END AS fails,
    (a AND contains(earlier, 'A')) OR (b AND contains(earlier, 'B')) OR (c AND contains(earlier, 'C')) OR (d AND contains(earlier, 'D')) OR (e AND contains(earlier, 'E')) AS gone,
    a::INT + b::INT + c::INT + d::INT + e::INT AS n_fails
  FROM st, m),
g AS (
  SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT gone AND fails), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (gone AND fails), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails AND n_fails = 1), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (NOT gone AND fails), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND fails), 0)::BIGINT AS toxic_lost
  FROM r GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM g
"""
