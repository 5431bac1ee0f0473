"""Mixing sources to target weights: iterative proportional fitting, then sampling by calibrated probabilities.

Documents fall into cells of source, language and topic; a cell's first weight is its number of tokens. Each round scales
the weights so that the sums of each source, then each language, then each topic are its target share. A cell's
probability is its weight over its tokens, times one factor that makes the expected number of tokens the budget, and at most 1;
what the cap takes from a cell goes to the others through that factor. A document stays if a hash of its id is below its cell's probability.

A topic is a column that the caller gives, or learned (`Topics`): spherical k-means over hashed words, weighted by their rarity, after
the mean of the document's language is taken off, so that topics aren't the languages again. Rarity, means and centres are learned from every whole
text: words are counted once, into a table of slots with a row a block of documents, and each round is one pass over it that adds whole numbers up; a pass
for the first centres gives several of them. Every whole text is then given a topic. The words of a block are hashed together (`xxh64`), and a block meets the centres in one product.

The texts are read once: cell, tokens and draw are written beside the rows, and both the cells and the decisions are made from that table.
The weights are a DataFrame of cells, not of documents: of more than `CELLS` cells a round is three windows over it, and rounds are written by fours;
fewer are fitted as arrays. Only sums come to the driver. `target_error` in the result is the largest relative error of the cell's three margins after the last
round: below `TOLERANCE` if the targets could be met together, else what the compromise misses. `margins` lists them.

Defined results: null sources, languages and texts form cells of their own (empty string, `und`, topic `empty`); documents without
tokens get their cell's probability like others, those of a cell without any token the overall share; repeated rows with one
id share one fate, a row without an id is drawn by its text; an empty table gives an empty table; columns of any other names pass. Of given targets only
values with tokens count, in proportion; values that they leave out get share 0; a dimension none of whose targets has tokens is treated as
without targets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BLOCK, Rows, discard, join_small, let, stored, table

DIMENSIONS = ("source", "lang", "topic")
#: Without given targets a value's target is its tokens to this power, over the sum of these.
TEMPER = 0.5
#: Expected share of all tokens that stays; rounds of fitting; largest relative error of a margin that ends the fitting.
SHARE, ROUNDS, TOLERANCE = 0.5, 40, 1e-6
DRAW = 1 << 52
#: Cells up to which the rounds of fitting run over arrays of their sums; more stay a DataFrame.
CELLS = 100_000
#: Topics, hash slots of words, and languages with a mean of their own (the commonest; the others have that of all documents).
TOPICS, SLOTS, LANGUAGES = 12, 4096, 1000
#: Words that are hashed at once.
WORDS = 1 << 17
#: The rounds of the topics end when no centre turns by more than this (1 less the cosine).
SETTLED = 1e-4
EMPTY = "empty"


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def counted(text: Column) -> Column:
    """Struct of a text's number of words and their hash slots."""
    return let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.transform(w, lambda x: F.pmod(F.xxhash64(F.lower(x)), F.lit(SLOTS)).cast("int")).alias("slots")))


#: What parts words, the primes of XXH64, and the seed of Spark's `xxhash64`.
BLANK = np.isin(np.arange(256), list(b" \t\n\x0b\f\r"))
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
SEED = 42


def turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def xxh64(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """XXH64 of the words at `start` in `data`, which has 8 bytes or more after the last; all words of up to 31 bytes at once."""
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))  # the 8 bytes from each place on
    h = size.astype(np.uint64) + (P5 + np.uint64(SEED))
    for j in range(3):
        at = np.flatnonzero(size >= 8 * j + 8)
        h[at] = turned(h[at] ^ (turned(eight[start[at] + 8 * j] * P2, 31) * P1), 27) * P1 + P4
    at = np.flatnonzero(size & 4)
    h[at] = turned(h[at] ^ ((eight[start[at] + (size[at] & ~7)] & np.uint64(0xFFFFFFFF)) * P1), 23) * P2 + P3
    for j in range(3):
        at = np.flatnonzero((size & 3) > j)
        h[at] = turned(h[at] ^ (data[start[at] + (size[at] & ~3) + j] * P5), 11) * P1
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    h ^= h >> np.uint64(32)
    at = np.flatnonzero(size > 31)
    h[at] = [xxhash.xxh64_intdigest(data[i : i + n].tobytes(), SEED) for i, n in zip(start[at].tolist(), size[at].tolist(), strict=True)]
    return h


def slotted(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the words of lower-cased texts, which stand in `data` one after the other (8 bytes more at its end), as `counted` gives them, and each text's number of words."""
    inside = np.concatenate([[False], ~BLANK[data[ends[0] : ends[-1]]], [False]])
    cut = ends - ends[0]
    last, first = inside[:-1].copy(), inside[1:].copy()
    last[cut], first[cut] = False, False  # a text's first byte has none before it, its last none after it
    start, stop = np.flatnonzero(inside[1:] & ~last), np.flatnonzero(inside[:-1] & ~first)
    slots = np.empty(len(start), np.uint16)
    for i in range(0, len(start), WORDS):
        part = slice(i, i + WORDS)
        slots[part] = xxh64(data, start[part] + ends[0], stop[part] - start[part]) & np.uint64(SLOTS - 1)
    return slots, np.diff(np.searchsorted(start, cut))


def tallied(slots: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of documents with `words` slots each: number of distinct slots, these in order, and their counts."""
    n = len(words)
    counts = np.bincount(np.repeat(np.arange(n) * SLOTS, words) + slots, minlength=n * SLOTS)
    at = np.flatnonzero(counts)
    return np.diff(np.searchsorted(at, np.arange(n + 1) * SLOTS)), (at % SLOTS).astype(np.uint16), counts[at]


#: Counts from this one on stand after the bytes of all, in four bytes each; logarithms of 1 + the others.
MANY = 255
LOGS = np.log1p(np.arange(MANY + 1)).astype(np.float32)


def in_bytes(counts: np.ndarray) -> np.ndarray:
    """Most counts of words are small: a byte each, and four more for those that don't fit."""
    return np.concatenate([np.minimum(counts, MANY).astype(np.uint8), counts[counts >= MANY].astype("<u4").view(np.uint8)])


def logs_of(given: np.ndarray, n: int) -> np.ndarray:
    """Logarithms of 1 + the `n` counts that `in_bytes` gave."""
    logs = LOGS.take(given[:n], mode="clip")
    if len(given) > n:
        logs[given[:n] == MANY] = np.log1p(given[n:].view("<u4"))
    return logs


def texts_in_blocks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of up to BLOCK lower-cased texts at a time: the first one's row, slots of all words, and each text's number of words."""
    data, ends = numbers_of(column, np.uint8)
    data = np.concatenate([data, np.zeros(8, np.uint8)])
    for i in range(0, len(column), BLOCK):
        yield i, *slotted(data, ends[i : i + BLOCK + 1])


def lowered(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit(""))).cast("binary")


#: Centres that a block meets at once.
ABREAST = 16


class Likeness:
    """Cosines of documents, their language's mean taken off, with the centres: dense blocks of one size, whatever the documents and however many
    centres, so that a row's result is the same in any block and beside any other centres.
    """

    def __init__(self, means: np.ndarray, centres: np.ndarray):
        groups = [np.vstack([x, np.zeros((ABREAST - len(x), x.shape[1]))]) for x in (centres[i : i + ABREAST] for i in range(0, len(centres), ABREAST))]
        self.turned = [np.ascontiguousarray(x.T, np.float32) for x in groups]
        self.mean = np.concatenate([means @ x.T for x in groups], 1)[:, : len(centres)]
        self.x = np.zeros((BLOCK, means.shape[1]), np.float32)

    def __call__(self, own: np.ndarray, sizes: np.ndarray, slots: np.ndarray, values: np.ndarray, off: np.ndarray) -> np.ndarray:
        at, flat = np.repeat(np.arange(len(sizes)) * self.x.shape[1], sizes) + slots, self.x.reshape(-1)
        flat[at] = values
        cosines = np.concatenate([(self.x @ x)[: len(sizes)] for x in self.turned], 1)[:, : self.mean.shape[1]]
        flat[at] = 0
        off = off[:, None]
        return np.where(off > NEAR, (cosines - self.mean[own]) / np.maximum(NEAR, off), 0.0)


def unit(sizes: np.ndarray, slots: np.ndarray, logs: np.ndarray, rarity: np.ndarray, norms: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Values of the unit vectors of documents of one word or more, and the norms that they were divided by, if these aren't known."""
    v = logs * rarity.take(slots, mode="clip")
    if norms is None:
        norms = np.maximum(1e-9, np.sqrt(np.add.reduceat(v * v, np.cumsum(sizes) - sizes)))
    return (v / np.repeat(norms, sizes)).astype(np.float32), norms


def distance(own: np.ndarray, sizes: np.ndarray, slots: np.ndarray, v: np.ndarray, means: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """Of documents from their language's mean."""
    first, v = np.cumsum(sizes) - sizes, v.astype(float)
    return np.sqrt(np.maximum(0, np.add.reduceat(v * v, first) - 2 * np.add.reduceat(v * means.ravel()[np.repeat(own * means.shape[1], sizes) + slots], first) + squares[own]))


@dataclass
class Topics:
    """Rarity of each slot, mean vector of each language, and unit centres of the topics."""

    rarity: np.ndarray
    means: dict[str, np.ndarray]
    centres: np.ndarray

    def vectors(self, slots: list, langs: list) -> np.ndarray:
        """Unit vectors of documents, their language's mean taken off; zero without words."""
        x = np.zeros((len(slots), len(self.rarity)), np.float32)
        for row, s, lang in zip(x, slots, langs, strict=True):
            if len(s):
                row[:] = np.log1p(np.bincount(s, minlength=len(row))) * self.rarity
                row /= max(1e-9, np.linalg.norm(row))
                row -= self.means.get(lang, self.means[""])
                row /= max(1e-9, np.linalg.norm(row))
        return x

    def namer(self) -> Callable[[np.ndarray, np.ndarray, list], np.ndarray]:
        """Gives the topics of up to BLOCK documents: from all their words' slots, their numbers of words, and their languages."""
        numbers = {x: i for i, x in enumerate(self.means)}
        means, rarity = np.stack([*self.means.values()]).astype(float), self.rarity.astype(float)
        squares, likeness, others = (means**2).sum(1), Likeness(means, self.centres), numbers[""]

        def names(slots: np.ndarray, words: np.ndarray, langs: list) -> np.ndarray:
            found, some = np.full(len(words), EMPTY, object), np.flatnonzero(words)
            if len(some):
                sizes, s, counts = tallied(slots, words[some])
                own, (v, _) = np.array([numbers.get(langs[i], others) for i in some]), unit(sizes, s, logs_of(in_bytes(counts), len(s)), rarity)
                best = likeness(own, sizes, s, v, distance(own, sizes, s, v, means, squares)).argmax(1)
                found[some] = [f"topic-{k}" for k in best]
            return found

        return names

    def names(self, slots: list, langs: list) -> list[str]:
        named, found = self.namer(), []
        for i in range(0, len(slots), BLOCK):
            part = slots[i : i + BLOCK]
            found += [*named(np.concatenate([np.zeros(0, np.int64), *part]).astype(np.int64), np.array([len(s) for s in part]), langs[i : i + BLOCK])]
        return found

    def column(self, spark: SparkSession, text: Column, lang: Column) -> Column:
        """Struct of a text's number of words and its topic."""
        shared = spark.sparkContext.broadcast(self)

        @F.arrow_udf("n long, topic string")
        def named(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            names = shared.value.namer()
            for texts, langs in batches:
                langs, sizes, found = langs.to_pylist(), [np.zeros(0, np.int64)], [np.zeros(0, object)]
                for i, slots, words in texts_in_blocks(texts):
                    sizes.append(words)
                    found.append(names(slots, words, langs[i : i + BLOCK]))
                yield pa.StructArray.from_arrays([pa.array(np.concatenate(sizes).astype(np.int64)), pa.array(np.concatenate(found), pa.string())], ["n", "topic"])

        return named(lowered(text), lang)


def packed(**columns: np.ndarray | list) -> pa.RecordBatch:
    """A row of a block of documents: numbers as bytes, and their languages."""
    return pa.RecordBatch.from_arrays([pa.array([x], pa.list_(pa.string())) if isinstance(x, list) else pa.array([x.tobytes()], pa.binary()) for x in columns.values()], [*columns])


def unpacked(batches: Iterator[pa.RecordBatch], **kinds: type) -> Iterator[tuple]:
    """The columns of `kinds` of each block, as numbers of these types or as a list."""
    for batch in batches:
        columns = [(batch.column(name), kind) for name, kind in kinds.items()]
        for i in range(batch.num_rows):
            yield tuple(x[i].as_py() if kind is list else np.frombuffer(x[i].as_buffer(), kind) for x, kind in columns)


#: Columns of the fit's two tables, a row for up to BLOCK documents: languages, numbers of distinct slots, these, their counts (`in_bytes`); and numbers of the
#: languages, numbers of distinct slots, distances from the mean and then norms, slots, and counts again: every pass makes the unit vectors' values from them,
#: as reading these would take a pass more time than that.
COUNTS = {"langs": list, "sizes": np.int64, "slots": np.uint16, "counts": np.uint8}
VECTORS = {"own": np.int64, "sizes": np.int64, "off": np.float64, "slots": np.uint16, "values": np.uint8}


def features(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """COUNTS of every text with words; a stored table, as the fit reads it several times."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for i, slots, words in texts_in_blocks(batch.column("text")):
                some = np.flatnonzero(words)
                if len(some):
                    sizes, s, counts = tallied(slots, words[some])
                    yield packed(langs=[langs[i + j] for j in some], sizes=sizes, slots=s, counts=in_bytes(counts))

    given = docs.select(language(F.col(lang)).alias("lang"), lowered(F.col(text)).alias("text"))
    return stored(given.mapInArrow(made, "langs array<string>, sizes binary, slots binary, counts binary"))


def numbers_of(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers that a column of bytes holds, and where each row's begin and end."""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    size = np.dtype(kind).itemsize
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].view(kind), (ends - ends[0]) // size


#: Parts of 1 in which the fit adds up, so that its sums are exact and the same in any order; documents nearer to their language's mean than this have no direction.
UNIT, NEAR = 1 << 24, 1e-3


@dataclass
class Fit:
    """What a pass of the fit knows so far: rarity of the slots, means by number of the language (the last: all others'), and centres."""

    langs: dict[str, int]
    rarity: np.ndarray
    means: np.ndarray
    centres: np.ndarray

    def counts(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Of a block: numbers of the languages, sizes, slots, counts, unit vectors' values, and norms."""
        for langs, sizes, slots, counts in unpacked(batches, **COUNTS):
            yield np.array([self.langs.get(x, len(self.langs)) for x in langs]), sizes, slots, counts, *unit(sizes, slots, logs_of(counts, len(slots)), self.rarity)

    def known(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Of a block of VECTORS: numbers of the languages, sizes, distances from the mean, slots, and unit vectors' values."""
        for own, sizes, off, slots, counts in unpacked(batches, **VECTORS):
            off, norms, slots = *off.reshape(2, -1), slots.astype(np.intp)  # numpy's indices: converted once
            yield own, sizes, off, slots, unit(sizes, slots, logs_of(counts, len(slots)), self.rarity, norms)[0]

    def vector(self, own: int, slots: np.ndarray, values: np.ndarray) -> np.ndarray:
        x = -self.means[own]
        x[slots] += values
        norm = np.linalg.norm(x)
        return x / norm if norm > NEAR else 0 * x

    # the passes over COUNTS and then over VECTORS: each gives keys and whole numbers that Spark adds up, or a few documents a task

    def holding(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents that hold a slot."""
        found = np.zeros((len(self.rarity), 1), np.int64)
        for (slots,) in unpacked(batches, slots=np.uint16):
            found[:, 0] += np.bincount(slots, minlength=len(found))
        yield keyed(found)

    def by_language(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of unit vectors by language."""
        size = len(self.rarity)
        found = np.zeros((self.means.size, 1), np.int64)
        for own, sizes, slots, _, v, _ in self.counts(batches):
            np.add.at(found[:, 0], np.repeat(own * size, sizes) + slots, np.rint(v * UNIT).astype(np.int64))
        yield keyed(found)

    def first(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The task's document whose language, slots and logarithms have the least hash, as Spark's `xxhash64`."""
        best = None
        for langs, sizes, slots, counts in unpacked(batches, **COUNTS):
            ends, logs = np.cumsum([0, *sizes]).tolist(), logs_of(counts, len(slots))
            for lang, i, j in zip(langs, ends, ends[1:]):
                s, n = slots[i:j].tobytes(), logs[i:j].tobytes()
                h = xxhash.xxh64_intdigest(n, xxhash.xxh64_intdigest(s, xxhash.xxh64_intdigest(lang.encode("utf-8", "replace"), SEED)))
                this = ((h ^ 1 << 63) - (1 << 63), s, n, lang)
                best = this if best is None else min(best, this)
        if best:
            h, s, n, lang = best
            s, n = np.frombuffer(s, np.uint16), np.frombuffer(n, np.float32)
            yield documents([(h, s.tobytes(), unit(np.array([len(s)]), s, n, self.rarity)[0].tobytes(), self.langs.get(lang, len(self.langs)))])

    def vectors(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squares = (self.means**2).sum(1)
        for own, sizes, slots, counts, v, norms in self.counts(batches):
            yield packed(own=own, sizes=sizes, off=np.concatenate([distance(own, sizes, slots, v, self.means, squares), norms]), slots=slots, values=counts)

    def by_centre(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of documents by their nearest centre: by slot, and what of each language's mean they are without."""
        size, k, langs = len(self.rarity), len(self.centres), len(self.means)
        found, without, likeness = np.zeros(size * k), np.zeros(langs * k), Likeness(self.means, self.centres)
        for own, sizes, off, slots, v in self.known(batches):
            owner = likeness(own, sizes, slots, v, off).argmax(1)
            share = np.where(off > NEAR, UNIT / np.maximum(NEAR, off), 0.0)
            found += np.bincount(np.repeat(owner * size, sizes) + slots, np.rint(v * np.repeat(share, sizes)), size * k)  # whole numbers below 2^53: exact
            without += np.bincount(owner * langs + own, np.rint(share), langs * k)
        yield keyed(np.concatenate([found.reshape(k, size), without.reshape(k, langs)], 1).T.astype(np.int64))

    def farthest(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The task's AHEAD documents that are least like any centre, copies once; of equal ones the first by their bytes."""
        best, likeness = [], Likeness(self.means, self.centres)
        for own, sizes, off, slots, v in self.known(batches):
            near = np.rint(likeness(own, sizes, slots, v, off).max(1) * UNIT).astype(np.int64)
            ends = np.cumsum([0, *sizes])
            few = np.flatnonzero(near <= (best[-1][0] if len(best) == AHEAD else 2 * UNIT))
            found = {(int(near[j]), slots[ends[j] : ends[j + 1]].astype(np.uint16).tobytes(), v[ends[j] : ends[j + 1]].tobytes(), int(own[j])) for j in few}
            best = sorted(found.union(best))[:AHEAD] if found else best
        yield documents(best)

    def nearer(self, ahead: list[tuple], last: int) -> list[tuple]:
        """The documents of `farthest`, with the centres after the first `last` ones as well."""
        likeness, squares = Likeness(self.means, self.centres), (self.means**2).sum(1)
        sizes, own = np.array([len(x[1]) // 2 for x in ahead]), np.array([x[3] for x in ahead])
        slots, v = np.frombuffer(b"".join(x[1] for x in ahead), np.uint16), np.frombuffer(b"".join(x[2] for x in ahead), np.float32)
        near = np.rint(likeness(own, sizes, slots, v, distance(own, sizes, slots, v, self.means, squares))[:, last:].max(1) * UNIT).astype(np.int64)
        return sorted((max(x[0], int(k)), *x[1:]) for x, k in zip(ahead, near, strict=True))

    def first_centres(self, vectors: DataFrame, most: int) -> None:
        """Each next centre is the document that is least like those before. A pass gives AHEAD documents, and all others come after the last of them. More
        centres only make a document more like them: while one of those given comes before that bound, it is the next, and no pass is needed.
        """
        while len(self.centres) < most:
            ahead = least(vectors, self.farthest, AHEAD)
            bound = ahead[-1] if len(ahead) == AHEAD else None
            while len(self.centres) < most and (bound is None or ahead[0] <= bound):
                self.centres = np.vstack([self.centres, self.vector(*numbers_in(ahead[0]))])
                ahead = self.nearer(ahead, len(self.centres) - 1)


#: Documents that a pass for the first centres gives; the driver holds so many.
AHEAD = 64


def documents(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.int64(), pa.binary(), pa.binary(), pa.int64()))], ["rank", "slots", "values", "own"])


def numbers_in(found: tuple) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of the language, slots and values of a document."""
    return found[3], np.frombuffer(found[1], np.uint16), np.frombuffer(found[2], np.float32)


def least(table: DataFrame, made: Callable, most: int = 1) -> list[tuple]:
    """Rank, slots, values and number of the language of the documents of least rank, in order."""
    names = ["rank", "slots", "values", "own"]
    found = table.mapInArrow(made, "rank long, slots binary, values binary, own long").orderBy(*names).limit(most).toArrow()
    return sorted(zip(*(found[x].to_pylist() for x in names), strict=True))


def keyed(sums: np.ndarray) -> pa.RecordBatch:
    """The rows of `sums` that have anything, by number."""
    at = np.flatnonzero(sums.any(1))
    return pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(np.ascontiguousarray(x)) for x in sums[at].T)], ["key", *(f"n{i}" for i in range(sums.shape[1]))])


def added(table: DataFrame, made: Callable, size: int, width: int = 1) -> np.ndarray:
    """The sums by key of what the tasks of a pass give: `size` rows of `width` numbers."""
    names = [f"n{i}" for i in range(width)]
    found = table.mapInArrow(made, ", ".join(f"{x} long" for x in ("key", *names))).groupBy("key").agg(*[F.sum(x).alias(x) for x in names]).toArrow()
    sums = np.zeros((size, width), np.int64)
    if found.num_rows:
        sums[found["key"].to_numpy()] = np.stack([found[x].to_numpy() for x in names], 1)
    return sums


def learn_topics(docs: DataFrame, text: str = "text", lang: str = "lang", topics: int = TOPICS, rounds: int = 25) -> Topics:
    """Spherical k-means of all documents: counts, means, first centres and every round are sums over the whole table; the same for the same rows in any order."""
    counts = features(docs, text, lang)
    each = counts.select(F.explode("langs").alias("lang")).groupBy("lang").agg(F.count("*").alias("n"))
    rows = {r["lang"]: r["n"] for r in each.orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    total = counts.agg(F.sum(F.size("langs"))).first()[0] or 0
    fit = Fit({x: i for i, x in enumerate(rows)}, np.zeros(SLOTS), np.zeros((len(rows) + 1, SLOTS)), np.zeros((1, SLOTS)))
    fit.rarity = np.log((1 + total) / (1 + added(counts.select("slots"), fit.holding, SLOTS)[:, 0]))
    if total:
        sums = added(counts, fit.by_language, fit.means.size).reshape(fit.means.shape) / UNIT
        fit.means = np.stack([*(sums[i] / n for i, n in enumerate(rows.values())), sums.sum(0) / total])
        fit.centres = np.stack([fit.vector(*numbers_in(least(counts, fit.first)[0]))])
        vectors = stored(counts.mapInArrow(fit.vectors, "own binary, sizes binary, off binary, slots binary, values binary"))
        fit.first_centres(vectors, min(topics, total))
        k = len(fit.centres)
        for _ in range(rounds):
            sums = added(vectors, fit.by_centre, SLOTS + len(fit.means), k).T / UNIT
            moved = sums[:, :SLOTS] - sums[:, SLOTS:] @ fit.means
            norm = np.linalg.norm(moved, axis=1, keepdims=True)
            before, fit.centres = fit.centres, np.where(norm > 0, moved / np.maximum(1e-9, norm), fit.centres)
            if (1 - (before * fit.centres).sum(1))[norm[:, 0] > 0].max(initial=0.0) < SETTLED:
                break
        discard(vectors)
    discard(counts)
    means = {x: m.astype(np.float32) for x, m in zip([*fit.langs, ""], fit.means, strict=True)}
    return Topics(fit.rarity.astype(np.float32), means, fit.centres.astype(np.float32))


def language(lang: Column) -> Column:
    return F.coalesce(lang.cast("string"), F.lit("und"))


def sums(dimension: str, value: str) -> Column:
    return F.sum(value).over(Window.partitionBy(dimension))


def rake(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, temper: float = TEMPER, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """`cells` (source, lang, topic, n_tokens) with a weight, want_* and error, stored; the weights' margins are the targets' shares of 1."""
    targets = targets or {}
    cells = cells.withColumn("weight", F.col("n_tokens").cast("double"))
    alive = F.col("n_tokens") > 0
    for d in DIMENSIONS:
        given = targets.get(d) or {}
        named = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in given.items() for x in (k, float(v))]), F.col(d)), F.lit(0.0)) if given else F.lit(0.0)
        # a margin's want stands in each of its cells and counts once
        here = F.count_if(alive).over(Window.partitionBy(d))
        cells = cells.withColumns({f"named_{d}": named, f"free_{d}": F.pow(sums(d, "n_tokens").cast("double"), temper), f"cells_{d}": here})
    before = cells = stored(cells)
    totals = cells.filter(alive).agg(*[F.coalesce(F.sum(F.col(f"{kind}_{d}") / F.col(f"cells_{d}")), F.lit(0.0)).alias(f"{kind}_{d}") for kind in ("named", "free") for d in DIMENSIONS]).first()
    for d in DIMENSIONS:
        kind = "named" if totals[f"named_{d}"] > 0 else "free"
        cells = cells.withColumn(f"want_{d}", F.when(alive | (F.col(f"cells_{d}") > 0), F.col(f"{kind}_{d}") / F.lit(totals[f"{kind}_{d}"] or 1.0)).otherwise(0.0))
    cells = cells.drop(*[f"{kind}_{d}" for kind in ("named", "free", "cells") for d in DIMENSIONS])
    if before.count() <= CELLS:
        found = stored(raked(cells, rounds, tolerance))
        discard(before)
        return found
    for done in range(rounds):
        for d in DIMENSIONS:
            cells = cells.withColumn("weight", F.coalesce(F.try_divide(F.col("weight") * F.col(f"want_{d}"), sums(d, "weight")), F.lit(0.0)))
        if done % 4 == 3 or done == rounds - 1:
            off = [F.when(F.col(f"want_{d}") > 0, F.abs(sums(d, "weight") / F.col(f"want_{d}") - 1)).otherwise(0.0) for d in DIMENSIONS]
            cells = stored(cells.withColumn("error", F.greatest(*off)))
            discard(before)
            before = cells
            if (cells.filter(alive).agg(F.max("error")).first()[0] or 0.0) <= tolerance:
                break
    return cells


def raked(cells: DataFrame, rounds: int, tolerance: float) -> DataFrame:
    """The rounds of `rake` over at most CELLS cells, which are sums already: three sums of arrays instead of three shuffles a round."""
    table = cells.toArrow()
    weight, alive = table["weight"].to_numpy().copy(), table["n_tokens"].to_numpy() > 0
    codes = {d: table[d].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False) for d in DIMENSIONS}
    want, error = {d: table[f"want_{d}"].to_numpy() for d in DIMENSIONS}, np.zeros(len(weight))
    of = lambda d: np.bincount(codes[d], weight)[codes[d]] if len(weight) else weight
    for done in range(rounds):
        for d in DIMENSIONS:
            sums = of(d)
            weight = np.divide(weight * want[d], sums, out=np.zeros(len(weight)), where=sums != 0)
        if done % 4 == 3 or done == rounds - 1:
            error = np.max([np.where(want[d] > 0, np.abs(np.divide(of(d), want[d], out=np.zeros(len(weight)), where=want[d] > 0) - 1), 0.0) for d in DIMENSIONS], 0)
            if error[alive].max(initial=0.0) <= tolerance:
                break
    table = table.set_column(table.column_names.index("weight"), "weight", pa.array(weight)).append_column("error", pa.array(error))
    return cells.sparkSession.createDataFrame(table, schema=cells.withColumn("error", F.lit(0.0)).schema)


def calibrate(cells: DataFrame, share: float = SHARE) -> DataFrame:
    """`cells` with a probability, so that the expected tokens are `share` of all (or as many as weights above 0 allow)."""
    cells = cells.withColumn("rate", F.when(F.col("n_tokens") > 0, F.col("weight") / F.col("n_tokens")).otherwise(0.0))
    factor, capped = 0.0, -1
    while True:  # the expected tokens are concave and piecewise linear in the factor: each step from below caps more cells, or is the exact one
        low = F.col("rate") * F.lit(factor) < 1
        now, fixed, slope, total = cells.agg(F.count_if(~low), F.sum(F.when(low, 0).otherwise(F.col("n_tokens"))), F.sum(F.when(low, F.col("rate") * F.col("n_tokens"))), F.sum("n_tokens")).first()
        if not total or not slope or now <= capped:
            break
        factor, capped = max(factor, (share * total - fixed) / slope), now
    return cells.withColumn("probability", F.when(F.col("n_tokens") > 0, F.least(F.lit(1.0), F.col("rate") * F.lit(factor))).otherwise(F.lit(share))).drop("rate")


def margins(fitted: DataFrame) -> DataFrame:
    """dimension, value, share of tokens given, wanted and weighted, and tokens expected, of the cells of `calibrate`."""
    parts = [
        fitted.groupBy(F.lit(d).alias("dimension"), F.col(d).alias("value")).agg(F.sum("n_tokens").alias("n_tokens"), F.max(f"want_{d}").alias("wanted"), F.sum("weight").alias("reached"), F.sum(F.col("probability") * F.col("n_tokens")).alias("expected_tokens"))
        for d in DIMENSIONS
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def drawn(key: Column, text: Column, seed: int) -> Column:
    """A number from 0 to 1 that depends on the id (or else the text) and the seed alone."""
    given = F.coalesce(key.cast("string"), F.sha2(F.coalesce(text, F.lit("")), 256))
    return F.pmod(F.xxhash64(given, F.lit(seed)), F.lit(DRAW)) / F.lit(float(DRAW))


def decide(
    docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", lang: str = "lang", topic_of: Column | None = None, topics: Topics | None = None,
    targets: dict[str, dict[str, float]] | None = None, share: float = SHARE, seed: int = 42, leave_out: Iterable[str] = (),
) -> DataFrame:
    """`docs` with topic, n_tokens, weight, probability, target_error and sampled; input columns of these names are replaced, and
    those of `leave_out` aren't returned.
    """
    rows = Rows(docs if topic_of is None else docs.select("*", topic_of.cast("string").alias("topic")))
    # names are looked up among the given columns, as the topic's may be one of them
    own = Rows(docs)
    given = rows.df.withColumns({"source": F.coalesce(own.col(source).cast("string"), F.lit("")), "lang": language(own.col(lang)), "u": drawn(own.col(key), own.col(text), seed)})
    if topic_of is None:
        model = topics or learn_topics(own.df, own.name(text), own.name(lang))
        given = given.withColumn("named", model.column(docs.sparkSession, own.col(text), F.col("lang")))
        given = given.withColumns({"n_tokens": F.col("named.n"), "topic": F.col("named.topic")}).drop("named")
    else:
        given = given.withColumns({"n_tokens": F.size(words(own.col(text))).cast("long"), "topic": F.coalesce(f"c{len(docs.columns)}", F.lit(""))})
    gone = {n.lower() for n in leave_out}
    given = stored(given.drop(*[f"c{i}" for i, n in enumerate(rows.names) if n.lower() in gone]))
    cells = stored(given.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_docs")))
    raked = rake(cells, targets)
    fitted = stored(calibrate(raked, share).select(*DIMENSIONS, "weight", "probability", "error"))
    discard(raked)
    discard(cells)
    found = join_small(given, fitted, list(DIMENSIONS), "u")
    return rows.restored(found, leave_out, topic=F.col("topic"), n_tokens=F.col("n_tokens"), weight=F.col("weight"), probability=F.col("probability"), target_error=F.col("error"), sampled=F.col("u") < F.col("probability"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The sampled documents, with their topic, tokens, weight, probability and target_error."""
    return decide(docs, **how).filter("sampled").drop("sampled")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"), leave_out=["text"])
