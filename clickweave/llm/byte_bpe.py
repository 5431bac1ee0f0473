"""Byte-level BPE: texts to token ids and back, as a monoid reduced over a tree of halves.

A text is halved down to stretches of `LEAF` characters. A stretch is matched by the tokenizer's pattern and each match is encoded by itself;
neighbours are then joined pairwise up the tree. Two facts say how far a join must look:

* Matching goes from left to right and reads no further than two characters past the start of the next match. So every start of a match that
  lies two or more characters before the seam stays one, and a join matches anew from the last such start. As soon as a new match ends, away from the window's
  end, where the right side has a start, all later ones are the right side's own. Until then the window is doubled.
* Merging takes the pair of lowest rank, the leftmost of several. If every two neighbours of a token sequence, encoded as one string, give these two tokens
  again, then the sequence is the encoding of its whole string: the first merge across a boundary would be the lowest of the two
  neighbours' merges too, and so happen in their string as well. So where a long match is halved or grows over a seam, a window of tokens around
  the seam is encoded anew, and doubled on a side until the tokens at its edges fit the ones outside; the tokens outside are then final.

Decoding maps ids to bytes and concatenates halves up the same tree. A text lies in one row, so its tree is reduced in one task, without a shuffle; ids take
four bytes each and nothing is kept for a match but its start and its number of tokens.

Defined results: a null or empty text has no ids, which decode to no bytes; bytes that are no UTF-8 are read with replacement characters, as
Spark does; very long texts and matches are whole; an id that the vocabulary lacks is an error; equal texts have equal ids; an empty table gives an empty table;
columns of any other names pass.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Rows, table

#: Characters of a stretch that isn't halved, and bytes of a match that isn't.
LEAF, LEAF_BYTES = 4096, 256
#: Bytes up to which merging keeps its pairs in a list; a rank that stands for none.
SHORT, NONE = 64, 1 << 62
#: Characters right of a seam that a join matches anew at first.
WINDOW = 32
#: Matches, of up to 64 characters, in each of the two generations that a worker remembers.
REMEMBERED = 300_000
#: Rows of a result that a worker holds at a time.
ROWS = 128


class Stretch(NamedTuple):
    """An encoded part of a text: where it begins and ends, the starts of its matches, their numbers of tokens, and the ids."""

    begin: int
    end: int
    starts: np.ndarray
    sizes: np.ndarray
    ids: np.ndarray


class Remembered(dict):
    """Ids of matches, as bytes of int32. When it is full, what it has becomes the older generation, of which only what is asked for again is kept."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec, self.older = codec, {}

    def __missing__(self, match: str) -> bytes:
        ids = self.older.get(match) or np.array(self.codec.of_match(match), np.int32).tobytes()
        if len(match) <= 64:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[match] = ids
        return ids


class Codec:
    """A vocabulary of byte strings by rank, and a pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.strings = {i: b for b, i in ranks.items()}
        self.leaf_bytes = max(LEAF_BYTES, *map(len, ranks))
        self.known = Remembered(self)
        self.fits = lru_cache(REMEMBERED)(lambda a, b: self.merged(self.strings[a] + self.strings[b]) == [a, b])

    # bytes of one match

    def merged(self, data: bytes) -> list[int]:
        """Ids of a byte string by merging the pair of lowest rank, leftmost first, until no pair is in the vocabulary."""
        return self.merged_short(data) if len(data) <= SHORT else self.merged_long(data)

    def merged_short(self, data: bytes) -> list[int]:
        """With the ranks of all pairs in a list."""
        rank = self.ranks.get
        cuts = list(range(len(data) + 1))
        pairs = [rank(data[i : i + 2], NONE) for i in range(len(data) - 1)]
        while pairs and (least := min(pairs)) != NONE:
            i = pairs.index(least)
            del cuts[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = rank(data[cuts[i] : cuts[i + 2]], NONE)
            if i:
                pairs[i - 1] = rank(data[cuts[i - 1] : cuts[i + 1]], NONE)
        return [self.ranks[data[a:b]] for a, b in pairwise(cuts)]

    def merged_long(self, data: bytes) -> list[int]:
        """With the ranks of pairs in a heap."""
        n = len(data)
        ends, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts at a place; None once it is merged away
        pairs = [(r, i) for i in range(n - 1) if (r := self.ranks.get(data[i : i + 2])) is not None]
        heapify(pairs)
        while pairs:
            rank, i = heappop(pairs)
            j = ends[i]
            if j is None or j >= n or self.ranks.get(data[i : ends[j]]) != rank:
                continue  # one of the two parts has changed since
            ends[i], ends[j] = ends[j], None
            if ends[i] < n:
                before[ends[i]] = i
                if (r := self.ranks.get(data[i : ends[ends[i]]])) is not None:
                    heappush(pairs, (r, i))
            if (k := before[i]) >= 0 and (r := self.ranks.get(data[k : ends[i]])) is not None:
                heappush(pairs, (r, k))
        return [self.ranks[data[i:j]] for i, j in enumerate(ends) if j is not None]

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two encoded strings' concatenation; see the second fact above."""
        i, j = min(1, len(left)), min(1, len(right))
        while True:
            window = self.merged(b"".join(map(self.strings.__getitem__, left[len(left) - i :] + right[:j])))
            fits_left = i == len(left) or self.fits(left[-i - 1], window[0])
            fits_right = j == len(right) or self.fits(window[-1], right[j])
            if fits_left and fits_right:
                return left[: len(left) - i] + window + right[j:]
            i, j = i if fits_left else min(2 * i, len(left)), j if fits_right else min(2 * j, len(right))

    def of_bytes(self, data: bytes) -> list[int]:
        if len(data) <= self.leaf_bytes:
            return self.merged(data)
        half = len(data) // 2
        return self.joined(self.of_bytes(data[:half]), self.of_bytes(data[half:]))

    def of_match(self, match: str) -> list[int]:
        data = match.encode("utf-8", "replace")
        whole = self.ranks.get(data)
        return self.of_bytes(data) if whole is None else [whole]

    # stretches of a text

    def leaf(self, text: str, begin: int, end: int) -> Stretch:
        matches = self.pattern.findall(text, begin, end)
        ids = [*map(self.known.__getitem__, matches)]
        lengths = np.array([*map(len, matches)], np.int64)
        return Stretch(begin, end, begin + np.cumsum(lengths) - lengths, np.array([*map(len, ids)], np.int64) // 4, np.frombuffer(b"".join(ids), np.int32))

    def join(self, text: str, left: Stretch, right: Stretch) -> Stretch:
        """Two neighbouring stretches as one; see the first fact above."""
        seam = right.begin
        kept = max(0, int(np.searchsorted(left.starts, seam - 2, "right")) - 1)  # matches of the left side that stay
        first, window = int(left.starts[kept]), WINDOW
        while True:
            stop = min(right.end, seam + window)
            found = [first]
            for m in self.pattern.finditer(text, first, stop):
                found.append(m.end())
                at = int(np.searchsorted(right.starts, m.end()))
                meets = m.end() == right.end or at < len(right.starts) and right.starts[at] == m.end()
                if m.end() >= seam and meets and (stop == right.end or m.end() <= stop - 2):
                    break
            else:
                window *= 2
                continue
            break
        n_left, n_right = int(left.sizes[:kept].sum()), int(right.sizes[:at].sum())
        old = Old(text, left, kept, n_left, right, at)
        ids = [self.of_new(old, a, b) for a, b in pairwise(found)]
        new, sizes = np.frombuffer(b"".join(ids), np.int32), np.array([*map(len, ids)], np.int64) // 4
        return Stretch(left.begin, right.end, np.concatenate([left.starts[:kept], found[:-1], right.starts[at:]]).astype(np.int64), np.concatenate([left.sizes[:kept], sizes, right.sizes[at:]]), np.concatenate([left.ids[:n_left], new, right.ids[n_right:]]))

    def of_new(self, old: Old, begin: int, end: int) -> bytes:
        """Ids, as bytes, of a match that a join found: a long one is put together from what was encoded before."""
        if end - begin <= LEAF:
            return self.known[old.text[begin:end]]
        ids, at = [], begin
        for a, b, found in old.matches():
            if begin <= a and b <= end:
                for part in (self.of_bytes(old.text[at:a].encode("utf-8", "replace")), found):
                    ids = self.joined(ids, part) if part else ids
                at = b
        rest = self.of_bytes(old.text[at:end].encode("utf-8", "replace"))
        return np.array(self.joined(ids, rest) if rest else ids, np.int32).tobytes()

    def encode(self, text: str, begin: int = 0, end: int | None = None) -> Stretch:
        end = len(text) if end is None else end
        if end - begin <= LEAF:
            return self.leaf(text, begin, end)
        half = (begin + end) // 2
        return self.join(text, self.encode(text, begin, half), self.encode(text, half, end))

    def decode(self, ids: list[int] | np.ndarray) -> bytes:
        if len(ids) <= LEAF:
            return b"".join(map(self.strings.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


class Old(NamedTuple):
    """What a join has at hand around its seam: matches of the left side from one on, and of the right side up to one."""

    text: str
    left: Stretch
    kept: int
    skipped: int
    right: Stretch
    upto: int

    def matches(self) -> Iterator[tuple[int, int, list[int]]]:
        for side, low, high, at in ((self.left, self.kept, len(self.left.starts), self.skipped), (self.right, 0, self.upto, 0)):
            for i in range(low, high):
                stop = side.starts[i + 1] if i + 1 < len(side.starts) else side.end
                yield int(side.starts[i]), int(stop), side.ids[at : at + side.sizes[i]].tolist()
                at += side.sizes[i]


def read_ranks(path: str) -> bytes:
    """A vocabulary file, read on the driver; workers get its bytes."""
    with open(path, "rb") as f:
        return f.read()


@lru_cache(2)
def codec(vocabulary: bytes, pattern: str) -> Codec:
    """The codec of a vocabulary's lines of base64 and rank; made once in each worker."""
    return Codec({base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}, pattern)


def in_parts(column: pa.Array) -> Iterator[list]:
    """The values of an Arrow array, `ROWS` at a time."""
    for i in range(0, len(column), ROWS):
        yield column.slice(i, ROWS).to_pylist()


def lists(ids: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, ids)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)]), pa.int32()))


def encoded(spark: SparkSession, text: Column, path: str, pattern: str = public_tokenizers.PATTERN) -> Column:
    """The ids of a text column, as array<int>. The vocabulary goes to the workers by broadcast: its size is that of the file."""
    held = spark.sparkContext.broadcast(read_ranks(path))

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(held.value, pattern)
        for batch in batches:
            for texts in in_parts(batch):
                yield lists([own.encode(t).ids for t in texts])

    return ids(F.coalesce(text, F.lit("")))


def decoded(spark: SparkSession, ids: Column, path: str, pattern: str = public_tokenizers.PATTERN) -> Column:
    """The bytes of an array<int> column of ids."""
    held = spark.sparkContext.broadcast(read_ranks(path))

    @F.arrow_udf("binary")
    def data(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(held.value, pattern)
        for batch in batches:
            for rows in in_parts(batch):
                yield pa.array([own.decode(x) for x in rows], pa.binary())

    return data(F.coalesce(ids, F.array().cast("array<int>")))


def round_trip(spark: SparkSession, text: Column, path: str, pattern: str = public_tokenizers.PATTERN) -> Column:
    """A struct of a text's ids and of the bytes that these decode to, by one reading of the text."""
    held = spark.sparkContext.broadcast(read_ranks(path))

    @F.arrow_udf("ids array<int>, data binary")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(held.value, pattern)
        for batch in batches:
            for texts in in_parts(batch):
                ids = [own.encode(t).ids for t in texts]
                yield pa.StructArray.from_arrays([lists(ids), pa.array([own.decode(x.tolist()) for x in ids], pa.binary())], ["ids", "data"])

    return both(F.coalesce(text, F.lit("")))


def tokenize(docs: DataFrame, path: str, text: str = "text", pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """`docs` with `token_ids`."""
    given = Rows(docs)
    return given.restored(given.df, token_ids=encoded(docs.sparkSession, given.col(text), path, pattern))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = table(spark, sf_dir, "documents").select("doc_id", round_trip(spark, F.col("text"), path).alias("x")).select("doc_id", "x.ids", "x.data")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256"))
