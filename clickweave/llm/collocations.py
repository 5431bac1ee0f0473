"""Phrase collocations: frequent phrases of two to five words by hash-filtered passes (PCY, DHP), scored and ranked by language.

One pass a length over the texts. The pass for length k counts phrases of k words exactly and, on the side, adds the phrases of k + 1 words up in
hashed buckets. A phrase is counted exactly only if

* the bucket that it fell into in the pass before holds at least `least` occurrences (PCY),
* both of its parts of k - 1 words are frequent (Apriori), which is looked up in a bitmap of the frequent parts' hashes,

and adds to a bucket of the next length only if both of its own parts passed these tests (DHP). Both bitmaps have a fixed size and are broadcast; a
bit set by chance costs a count and changes no result, as the exact counts decide. On a corpus so large that all buckets fill, the pass becomes an
exact count with Apriori pruning.

Within a task, a pass hashes all words of a block's bytes at once and numbers only those of phrases that pass,
after comparing them byte by byte. Phrases are counted by NumPy in blocks of bounded size; what leaves a task is one row a distinct phrase
and block and one for 16 buckets, summed by Spark. A text of any length is cut into slices that overlap by the words a phrase can
reach, so no phrase is lost or counted twice.

Scores use decimals of 38 digits: exact up to 10^17 words. A phrase inside a longer one of the same count is dropped; it is enough to look at
those with one word more, as the counts between the two are equal too.

Defined results: a null or empty text has no words; a null language is `und`; repeated rows count each; ties of score go to the larger count, then to
the smaller phrase by bytes; an empty table gives no rows; columns of other names take no part; the byte FF, which no UTF-8 has, parts pieces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Rows, discard, join_small, stored, table

#: Occurrences from which a phrase is frequent, words of the longest one, and phrases that are returned a language.
LEAST, LONGEST, TOP = 100, 5, 2000
#: Buckets of a pass, and bits of the bitmap of frequent parts; powers of two.
BUCKETS, PARTS = 1 << 22, 1 << 24
#: Columns of a row of 16 buckets, each with the counts of two, 31 bits apart; exact up to 2^31 / LEAST tasks.
LANES = [f"lane{i}" for i in range(8)]
#: Words, and distinct words, of a block; bytes of a slice of a text; rows of an Arrow batch.
BLOCK_WORDS, BLOCK_DISTINCT, SLICE, BATCH = 1_000_000, 150_000, 1 << 20, 50_000
#: The bytes that part pieces, each as the byte that stands for them; a tabulator is a blank.
END = b"\xff"
PLAIN = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", END * 10 + b" ")
#: Salts of the first of two rankings.
SALTS = 32

Kind = tuple[str, bytes]


def words(text: bytes, reach: int) -> Iterator[tuple[list[bytes], int]]:
    """The words of a text in slices, with END between pieces, and how many of them start a phrase; the others come again in the next slice."""
    text, at, carried = text.lower().translate(PLAIN), 0, []  # bytes.lower() takes A-Z alone
    while True:
        ends = [i for i in (text.find(b" ", at + SLICE), text.find(END, at + SLICE)) if i >= 0]
        stop = min(ends, default=len(text))
        found = carried + text[at:stop].replace(END, b" \xff ").split()
        if not ends:
            yield found, len(found)
            return
        own = max(0, len(found) - reach)
        yield found, own
        carried, at = found[own:], stop


def slices(text: bytes, reach: int) -> Iterator[tuple[bytes, int]]:
    """`words` without splitting: the bytes of a slice, with at least `reach` words after it, and how many of them are its own."""
    text, at = text.lower().translate(PLAIN), 0
    while True:
        ends = [i for i in (text.find(b" ", at + SLICE), text.find(END, at + SLICE)) if i >= 0]
        if not ends:
            yield text[at:], len(text) - at
            return
        stop, more = min(ends), 64
        while stop + more < len(text) and len(text[stop : stop + more].replace(END, b" ").split()) <= reach:
            more *= 2
        yield text[at : stop + more], stop - at
        at = stop


#: A number for each byte, and what a byte's number is multiplied by from place to place of a word; both odd.
BYTE = np.random.default_rng(11).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
STEP = np.uint64(0xD6E8FEB86659FD93)


def seed(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(lang.encode("utf-8", "replace")))


def hashed_words(data: np.ndarray, sizes: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Hashes of words of one byte or more, which stand in `data` without anything between them."""
    if not len(sizes):
        return np.zeros(0, np.uint64)
    first = np.cumsum(sizes) - sizes
    steps = np.multiply.accumulate(np.full(sizes.max(), STEP))
    x = np.add.reduceat(BYTE[data] * steps[np.arange(len(data)) - np.repeat(first, sizes)], first) ^ seeds
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class Hashed:
    """Words of many texts by their hashes alone: nothing is done word by word in Python. A word gets a number only where a phrase passes."""

    def __init__(self) -> None:
        self.langs: list[str] = []
        self.held: list[bytes] = []
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.waiting: list[tuple[str, bytes, int]] = []
        self.bytes = self.at = self.pieces = self.size = 0

    def add(self, lang: str, text: bytes, own: int) -> None:
        self.waiting.append((lang, text, own))
        self.bytes += len(text)
        if self.bytes >= SLICE:
            self.hash()

    def hash(self) -> None:
        """The words of the slices that wait, about `SLICE` bytes at a time."""
        text = END.join([*(t for _, t, _ in self.waiting), b""])
        data = np.frombuffer(text, np.uint8)
        end = data == 0xFF
        inside = ~(end | (data == 0x20))
        edges = np.diff(np.concatenate([[0], inside.view(np.int8)]))  # the last byte is END
        start, stop = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        begin = np.cumsum([0, *(len(t) + 1 for _, t, _ in self.waiting)])
        of = np.searchsorted(begin, start, "right") - 1
        own = start - begin[of] < np.array([o for *_, o in self.waiting])[of]
        seeds = {lang: seed(lang) for lang, *_ in self.waiting}
        word = hashed_words(data[inside], stop - start, np.array([seeds[lang] for lang, *_ in self.waiting], np.uint64)[of])
        piece = np.searchsorted(np.flatnonzero(end), start) + self.pieces
        self.parts.append((start + self.at, stop + self.at, piece, own, of + len(self.langs), word))
        self.langs += [lang for lang, *_ in self.waiting]
        self.held.append(text)
        self.at, self.pieces, self.size = self.at + len(text), self.pieces + int(end.sum()), self.size + len(start)
        self.waiting, self.bytes = [], 0

    def full(self) -> bool:
        return self.size >= BLOCK_WORDS

    def close(self) -> None:
        if self.waiting:
            self.hash()
        self.start, self.stop, self.piece, self.own, self.of, self.word = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.text = b"".join(self.held)
        self.held = self.parts = []

    def numbers(self, places: np.ndarray, k: int) -> np.ndarray:
        """A number for each word of the phrases at `places`, the same for the same language and bytes alone; others have 0."""
        used = np.zeros(len(self.word), bool)
        for j in range(k):
            used[places + j] = True
        at = np.flatnonzero(used)
        w = np.zeros(len(self.word), np.int64)
        _, first, inverse = np.unique(self.word[at], return_index=True, return_inverse=True)
        like, sizes = at[first][inverse], self.stop[at] - self.start[at]
        data, names = np.frombuffer(self.text, np.uint8), {lang: i for i, lang in enumerate(dict.fromkeys(self.langs))}
        lang = np.array([names[x] for x in self.langs])
        same = (self.stop[like] - self.start[like] == sizes).all() and (lang[self.of[at]] == lang[self.of[like]]).all()
        for i in range(0, len(at) if same else 0, BATCH):  # hashes that are alike are compared byte by byte
            n = sizes[i : i + BATCH]
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            same = same and (data[np.repeat(self.start[at[i : i + BATCH]], n) + inner] == data[np.repeat(self.start[like[i : i + BATCH]], n) + inner]).all()
        if same:
            w[at] = inverse + 1
        else:
            known: dict[Kind, int] = {}
            w[at] = [known.setdefault((self.langs[self.of[i]], self.text[self.start[i] : self.stop[i]]), len(known) + 1) for i in at]
        return w

    def phrase(self, i: int, k: int) -> bytes:
        return b" ".join([self.text[self.start[j] : self.stop[j]] for j in range(i, i + k)])

    def phrases(self, places: np.ndarray, k: int) -> pa.Array:
        """The phrases of k words at `places`; single words, of which a block has many, are copied all at once."""
        if k > 1:
            return pa.array([self.phrase(i, k) for i in places.tolist()], pa.binary())
        start, sizes = self.start[places], self.stop[places] - self.start[places]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        data = np.frombuffer(self.text, np.uint8)[np.arange(ends[-1]) + np.repeat(start - ends[:-1], sizes)]
        return pa.Array.from_buffers(pa.binary(), len(places), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])

    def languages(self, places: np.ndarray) -> pa.Array:
        return pa.array(self.langs, pa.string()).take(pa.array(self.of[places]))


class Numbers(dict):
    """Numbers of one language's words in a block; `known` has the words of all languages."""

    def __init__(self, lang: str, known: list[Kind]):
        super().__init__({END: 0})
        self.lang, self.known = lang, known

    def __missing__(self, word: bytes) -> int:
        self.known.append((self.lang, word))
        n = self[word] = len(self.known) - 1
        return n


class Block:
    """Numbered words of many texts, with a 0 between pieces, and whether a phrase may start at each."""

    def __init__(self) -> None:
        self.known: list[Kind] = [("", b"")]
        self.numbers: dict[str, Numbers] = {}
        self.runs: list[np.ndarray] = []
        self.owns: list[np.ndarray] = []
        self.size = 0

    def add(self, lang: str, found: list[bytes], own: int) -> None:
        numbers = self.numbers.get(lang) or self.numbers.setdefault(lang, Numbers(lang, self.known))
        self.runs.append(np.array([*map(numbers.__getitem__, found), 0], np.int64))
        self.owns.append(np.arange(len(found) + 1) < own)
        self.size += len(found) + 1

    def full(self) -> bool:
        return self.size >= BLOCK_WORDS or len(self.known) >= BLOCK_DISTINCT

    def hashes(self) -> np.ndarray:
        seeds = {lang: seed(lang) for lang in self.numbers}
        found = np.zeros(len(self.known), np.uint64)
        for i in range(1, len(self.known), BATCH):
            part = self.known[i : i + BATCH]
            sizes = np.array([len(w) for _, w in part])
            found[i : i + len(part)] = hashed_words(np.frombuffer(b"".join(w for _, w in part), np.uint8), sizes, np.array([seeds[lang] for lang, _ in part], np.uint64))
        return found


def hashed_blocks(batches: Iterator[pa.RecordBatch], reach: int) -> Iterator[Hashed]:
    block = Hashed()
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            for part, own in slices(text.as_py(), reach):
                block.add(lang, part, own)
                if block.full():
                    block.close()
                    yield block
                    block = Hashed()
    if block.size or block.waiting:
        block.close()
        yield block


def longer(hashed: np.ndarray, word: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the phrases of k words from those of k - 1 at the same place; as many as there are places for them."""
    n = max(0, len(word) - k + 1)
    x = hashed[:n] * np.uint64(0x9E3779B97F4A7C15) + word[k - 1 : k - 1 + n]
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def held(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (bits[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8)) & 1 == 1


def distinct(hashed: np.ndarray, places: np.ndarray, w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct phrase of k words at `places`, and the number of its places there."""
    _, first, inverse, count = np.unique(hashed[places], return_index=True, return_inverse=True, return_counts=True)
    if all((w[places + j] == w[places[first][inverse] + j]).all() for j in range(k)):
        return places[first], count
    # two phrases of one hash: told apart by their words
    _, first, count = np.unique(np.stack([w[places + j] for j in range(k)], 1), axis=0, return_index=True, return_counts=True)
    return places[first], count


def counted(k: int, longest: int, buckets: int, least: int, frequent: Callable[[], np.ndarray], filled: Callable[[], np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The pass for phrases of k words. `frequent` and `filled` give the bitmaps of the frequent parts of k - 1 words and of the buckets of k."""
    names = ["lang", "phrase", "h", "bucket", "n", *LANES]

    def rows(langs: pa.Array | None, phrases: pa.Array | None, hashes: np.ndarray | None, places: np.ndarray | None, n: np.ndarray | None, lanes: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(places if n is None else n), BATCH):
            part = slice(i, i + BATCH)
            count = len((places if n is None else n)[part])
            h = pa.nulls(count, pa.int64()) if hashes is None else pa.array(hashes[part].view(np.int64))
            b = pa.nulls(count, pa.int64()) if places is None else pa.array(places[part].astype(np.int64))
            named = pa.nulls(count, pa.string()) if langs is None else langs.slice(i, count)
            said = pa.nulls(count, pa.binary()) if phrases is None else phrases.slice(i, count)
            times = pa.nulls(count, pa.int64()) if n is None else pa.array(n[part].astype(np.int64))
            held = [pa.nulls(count, pa.int64()) for _ in LANES] if lanes is None else [pa.array(np.ascontiguousarray(x)) for x in lanes[part].T]
            yield pa.RecordBatch.from_arrays([named, said, h, b, times, *held], names)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = np.zeros(buckets if k < longest else 0, np.int64)
        for block in hashed_blocks(batches, longest):
            own = block.own
            word = hashed = block.word
            if k == 1:
                passing = np.ones(len(word), bool)
                places = np.flatnonzero(own)
                number = block.numbers(places, 1)[places]
                n, first = np.bincount(number), np.zeros(number.max(initial=0) + 1, np.int64)
                first[number[::-1]] = places[::-1]
                seen = np.flatnonzero(n)
                first, n = first[seen], n[seen]
                total: dict[str, int] = {}
                for lang, count in zip(block.langs, np.bincount(block.of[places], minlength=len(block.langs)).tolist(), strict=True):
                    total[lang] = total.get(lang, 0) + count
                total = {lang: count for lang, count in total.items() if count}
                yield from rows(pa.array([*total], pa.string()), None, None, None, np.array([*total.values()], np.int64))
            else:
                for j in range(2, k + 1):
                    before, hashed = hashed, longer(hashed, word, j)
                whole = block.piece[: len(hashed)] == block.piece[k - 1 : k - 1 + len(hashed)]
                part = held(frequent(), before & np.uint64(PARTS - 1))
                passing = whole & part[: len(whole)] & part[1 : len(whole) + 1] & held(filled(), hashed & np.uint64(buckets - 1))
                places = np.flatnonzero(passing & own[: len(passing)])
                first, n = distinct(hashed, places, block.numbers(places, k), k)
            yield from rows(block.languages(first), block.phrases(first, k), hashed[first], None, n)
            if k < longest:
                following = longer(hashed, word, k + 1)
                both = passing[: len(following)] & passing[1 : len(following) + 1] & own[: len(following)]
                if k == 1:  # longer ones overlap
                    both &= block.piece[: len(following)] == block.piece[1 : len(following) + 1]
                tally += np.bincount((following[both] & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets)
        if k < longest:  # a bucket that is full in one task is full in all, so no more than `least` goes on; two buckets a number
            pairs = np.minimum(tally, least).reshape(-1, len(LANES), 2)
            lanes = pairs[:, :, 0] | pairs[:, :, 1] << 31
            some = np.flatnonzero(lanes.any(1))
            yield from rows(None, None, None, some, None, lanes[some])

    return made


def filled_buckets(kept: DataFrame, least: int, buckets: int) -> np.ndarray:
    """The buckets with `least` or more, as bits; what comes to the driver is a few bytes for 16 buckets."""
    full = lambda n, i: F.when(n >= least, 1 << i).otherwise(0)
    bits = sum((full(F.col(x).bitwiseAND(F.lit((1 << 31) - 1)), 2 * i) + full(F.shiftright(x, 31), 2 * i + 1) for i, x in enumerate(LANES)), F.lit(0))
    found = kept.filter("bucket IS NOT NULL").select(F.col("bucket"), bits.cast("long").alias("bits")).filter("bits > 0").toArrow()
    words = np.zeros(buckets // 16, "<u2")
    words[found["bucket"].to_numpy()] = found["bits"].to_numpy()
    return words.view(np.uint8)


def bitmap(places: DataFrame, place: Column, size: int) -> np.ndarray:
    """The distinct places (0 to `size`) as bits; what comes to the driver is the bitmap, in pieces that Spark has packed."""
    piece = 1 << 15
    packed = places.select(place.cast("long").alias("b")).groupBy(F.floor(F.col("b") / piece).cast("long").alias("k")).agg(F.bitmap_construct_agg(F.pmod("b", F.lit(piece))).alias("bits"))
    bits = np.zeros(max(size, piece) // 8, np.uint8)
    for k, data in packed.collect():
        bits[k * piece // 8 : (k + 1) * piece // 8] = np.frombuffer(data, np.uint8)
    return bits


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """Stored tables: lang, phrase, k and a of the phrases of 1 to `longest` words with `least` occurrences or more; and lang and n, all words."""
    sc, given = docs.sparkSession.sparkContext, Rows(docs)
    texts = given.df.select(F.coalesce(given.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(given.col(text), F.lit("")).cast("binary").alias("text"))
    none = np.zeros(0, np.uint8)
    frequent = filled = sc.broadcast(none)
    passes, totals = [], None
    for k in range(1, longest + 1):
        made = counted(k, longest, buckets, least, lambda b=frequent: b.value, lambda b=filled: b.value)
        sums = texts.mapInArrow(made, "lang string, phrase binary, h long, bucket long, n long, " + ", ".join(f"{x} long" for x in LANES)).withColumn("phrase", F.col("phrase").cast("string"))
        # a task's rows are mostly distinct already: dealt as they are, they are summed once, without a hash table on the sending side
        sums = sums.repartition("lang", "phrase", "h", "bucket").groupBy("lang", "phrase", "h", "bucket").agg(*[F.sum(x).alias(x) for x in ("n", *LANES)])
        kept = stored(sums.filter((F.col("n") >= least) | F.col("h").isNull()))
        if k == 1:
            totals = stored(kept.filter("phrase IS NULL AND bucket IS NULL").select("lang", "n"))
        found = stored(kept.filter("phrase IS NOT NULL").select("lang", "phrase", F.lit(k).alias("k"), F.col("n").alias("a"), "h"))
        passes.append(found)
        if k < longest:
            frequent = sc.broadcast(bitmap(found, F.col("h").bitwiseAND(F.lit(PARTS - 1)), PARTS))
            filled = sc.broadcast(filled_buckets(kept, least, buckets))
        discard(kept)
    every = passes[0]
    for p in passes[1:]:
        every = every.unionByName(p)
    whole = stored(every.drop("h"))
    for p in passes:
        discard(p)
    return whole, totals


def joined(w: str, start: str, count: str) -> Column:
    return F.expr(f"array_join(slice({w}, {start}, {count}), ' ')")


def scored(found: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, k, a, l, r, n and score of every candidate by its worst cut."""
    split = found.filter("k > 1").withColumn("w", F.split("phrase", " ")).select("lang", "phrase", "k", "a", "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    sides = F.explode(F.array(F.struct(F.lit(True).alias("left"), joined("w", "1", "cut").alias("part")), F.struct(F.lit(False).alias("left"), joined("w", "cut + 1", "k - cut").alias("part")))).alias("s")
    parts = split.select("lang", "phrase", "k", "a", "cut", sides).select("lang", "phrase", "k", "a", "cut", "s.*")
    counted_parts = join_small(parts, found.select("lang", F.col("phrase").alias("part"), F.col("a").alias("part_n")), ["lang", "part"], "phrase")
    cuts = counted_parts.groupBy("lang", "phrase", "k", "a", "cut").agg(F.max(F.when(F.col("left"), F.col("part_n"))).alias("l"), F.max(F.when(~F.col("left"), F.col("part_n"))).alias("r"))
    exact = join_small(cuts, totals, ["lang"], "phrase").withColumn("score", F.expr("(CAST(1000 AS DECIMAL(38, 0)) * a * n) div (CAST(l AS DECIMAL(38, 0)) * r)"))
    return exact.groupBy("lang", "phrase", "k", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("worst")).select("lang", "phrase", "k", "a", "worst.l", "worst.r", "n", "worst.score")


def contained(found: DataFrame) -> DataFrame:
    """lang, phrase and the largest count of a phrase with one word more around it."""
    longer_ones = found.filter("k > 2").withColumn("w", F.split("phrase", " "))
    inner = longer_ones.select("lang", "a", F.explode(F.array(joined("w", "1", "k - 1"), joined("w", "2", "k - 1"))).alias("phrase"))
    return inner.groupBy("lang", "phrase").agg(F.max("a").alias("around"))


def ranked(rows: DataFrame, top: int) -> DataFrame:
    """The first `top` rows of each language with their rank; each salt's first ones are found before they meet."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top).drop("salt")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP, buckets: int = BUCKETS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's best `top` phrases; a stored table."""
    found, totals = frequent_phrases(docs, text, lang, least, longest, buckets)
    kept = scored(found, totals).join(contained(found), ["lang", "phrase"], "left").filter(F.col("around").isNull() | (F.col("around") < F.col("a")))
    best = stored(ranked(kept, top).select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score")))
    discard(found)
    discard(totals)
    return best


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(text, '[.,;:!?\n\x0B\f\r]')), '[^ \t]+') AS w FROM d),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
x AS (SELECT c.lang, k, phrase, a, cut, array_to_string(w[1:cut], ' ') AS lp, array_to_string(w[cut + 1:], ' ') AS rp FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) c),
s AS (SELECT x.lang, x.k, x.phrase, x.a, cut, l.a AS l, r.a AS r, n.n, ((1000::HUGEINT * x.a * n.n) // (l.a::HUGEINT * r.a))::BIGINT AS score
  FROM x JOIN f l ON l.lang = x.lang AND l.phrase = lp AND l.k = cut JOIN f r ON r.lang = x.lang AND r.phrase = rp AND r.k = x.k - cut JOIN n ON n.lang = x.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
o AS (SELECT lang, array_to_string(w[j:j + m - 1], ' ') AS phrase, max(a) AS around FROM (SELECT lang, w, a, m, unnest(range(1, k - m + 2)) AS j FROM (SELECT *, unnest(range(2, k)) AS m FROM c)) GROUP BY ALL),
t AS (SELECT b.* FROM b LEFT JOIN o USING (lang, phrase) WHERE around IS NULL OR 100 * around < 100 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM t
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
