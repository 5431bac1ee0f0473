"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

An item is found in a document if at least `threshold` of its distinct word shingles are among the document's. Of an
item of q shingles, at most q - ceil(threshold * q) may be missing, so among any one more than these the document
has at least one. Items are partitioned by size (powers of two); each partition has a sketch length, that number for its
largest size, and an item's sketch is that many of its smallest shingle hashes (its bottom-k MinHash). A document
that shares no sketch value can't contain the item, however long it is, so the search loses nothing; documents with
fewer shingles than the item needs are put aside by their size. Candidates are then checked on the shingles themselves.

All of it is DataFrame functions: words by a regular expression, shingle hashes by array functions inside one scan, one join of
document hashes with sketch values, one second scan for the documents that are candidates.

Words are runs of letters and digits of the lower-cased text. An item of fewer words than a shingle is one shingle of
all its words. Defined results: null texts and texts without words contain nothing and are in nothing; rows without an id aren't
reported by `find_leaks` (and are judged by their text in `decontaminate`); repeated rows count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Rows, checkpointed, join_small, let, table

WORDS, THRESHOLD = 5, 0.8
#: Sketch values up to which they are broadcast (16 bytes each); beyond, the join is left to Spark.
BROADCAST_VALUES = 4_000_000


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order; empty for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def runs(text: Column, width: int | Column, most: int, made) -> Column:
    """`made` of every run of `width` words (`most` at most), in order; empty for fewer words. The words are cut once."""
    return let(words(text), lambda w: F.when(F.size(w) >= width, F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: made(w, i, width, most))))


def spaced(w: Column, i: Column, size: int | Column, most: int) -> Column:
    return F.array_join(F.slice(w, i + 1, F.lit(size) if isinstance(size, int) else size), " ")


def hashed(w: Column, i: Column, size: int | Column, most: int) -> Column:
    """A hash of the words of the run; nulls beyond `size` leave it as it is."""
    if isinstance(size, int):
        return F.xxhash64(*[F.get(w, i + k) for k in range(size)])
    return F.xxhash64(*[F.when(F.lit(k) < size, F.get(w, i + k)) for k in range(most)])


def sketched(items: DataFrame, key: str, text: str, width: int, threshold: float) -> DataFrame:
    """item_id, width, need, shingles (distinct texts) and sketch (hashes) of every item that has words."""
    given = Rows(items)
    base = given.df.select(given.col(key).alias("item_id"), given.col(text).alias("t"), F.size(words(given.col(text))).alias("n")).filter("n > 0 AND item_id IS NOT NULL")
    base = base.select("item_id", F.least(F.lit(width), F.col("n")).alias("width"), "t")
    base = base.select("item_id", "width", F.array_distinct(runs(F.col("t"), F.col("width"), width, spaced)).alias("shingles"), F.array_distinct(runs(F.col("t"), F.col("width"), width, hashed)).alias("hashes")).distinct()
    q = F.size("shingles")
    need = F.ceil(F.round(q * F.lit(threshold), 9)).cast("int")
    # the partition's largest size is 2^j >= q; what may be missing there, plus one
    largest = F.pow(F.lit(2.0), F.ceil(F.log2(q.cast("double"))))
    length = (largest - F.ceil(F.round(largest * F.lit(threshold), 9)) + 1).cast("int")
    return base.select("item_id", "width", need.alias("need"), "shingles", F.slice(F.array_sort("hashes"), F.lit(1), F.greatest(length, F.lit(1))).alias("sketch"))


def candidates(docs: DataFrame, key: str, text: str, sketches: DataFrame, width: int) -> DataFrame:
    """Distinct (key, item_id) that share a sketch value and whose sizes allow the item. `sketches` is checkpointed."""
    widths = [r[0] for r in sketches.select("width").distinct().collect()]  # `width` values at most
    if not widths:
        return docs.select(key, F.lit(None).cast(sketches.schema["item_id"].dataType).alias("item_id")).limit(0)
    values = sketches.select(F.explode("sketch").alias("hash"), "item_id", "need", "width")
    if values.count() <= BROADCAST_VALUES:
        values = F.broadcast(values)
    parts = [docs.select(key, F.lit(n).alias("width"), runs(F.col(text), n, width, hashed).alias("h")).select(key, "width", F.size("h").alias("n_runs"), F.explode("h").alias("hash")) for n in sorted(widths)]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found.join(values, ["hash", "width"]).filter(F.col("n_runs") >= F.col("need")).select(key, "item_id").distinct()


def verified(docs: DataFrame, key: str, text: str, pairs: DataFrame, sketches: DataFrame, threshold: float, width: int) -> DataFrame:
    """The pairs whose exact containment reaches the threshold, with the counts. `pairs` is checkpointed."""
    few = pairs.count() <= BROADCAST_ROWS
    items = sketches.select("item_id", "width", "shingles")
    full = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    near = join_small(full.join(F.broadcast(pairs) if few else pairs, F.col("_k") == F.col(key)), items, ["item_id"], key).filter("shingles IS NOT NULL")
    near = near.select(key, "item_id", "shingles", F.array_intersect("shingles", runs(F.col("_t"), F.col("width"), width, spaced)).alias("both"))
    q = F.size("shingles")
    return near.select(key, "item_id", q.alias("n_shingles"), F.size("both").alias("n_shared"), (F.size("both") / q).alias("containment")).filter(F.col("n_shared") >= F.round(q * F.lit(threshold), 9)).distinct()


def find_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", width: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """Every document and item that it contains: key, item_id, n_shingles, n_shared, containment."""
    sketches = checkpointed(sketched(items, item_key, item_text, width, threshold))
    rows = Rows(docs)
    docs = rows.df.select(rows.col(key).alias("_key"), rows.col(text).alias("_text")).filter("_key IS NOT NULL")
    pairs = checkpointed(candidates(docs, "_key", "_text", sketches, width))
    return verified(docs, "_key", "_text", pairs, sketches, threshold, width).withColumnRenamed("_key", key)


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", width: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` without those that contain an item; the same text always gets the same verdict, and columns of any names pass."""
    rows = Rows(docs)
    given = rows.df.withColumn("digest", F.sha2(rows.col(text), 256))
    named = given.select(F.col("digest").alias("_key"), rows.col(text).alias("_text")).filter("_key IS NOT NULL")
    sketches = checkpointed(sketched(items, item_key, item_text, width, threshold))
    pairs = checkpointed(candidates(named, "_key", "_text", sketches, width))
    leaks = checkpointed(verified(named, "_key", "_text", pairs, sketches, threshold, width).select(F.col("_key").alias("digest")).distinct())
    return rows.restored(given.join(leaks, "digest", "left_anti"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH w AS (
  SELECT 'd' AS kind, doc_id AS id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents
  UNION ALL
  SELECT 'i', item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') FROM benchmark),
items AS (SELECT id, least(5, len(w)) AS width, w FROM w WHERE kind = 'i' AND len(w) > 0),
wanted AS (
  SELECT DISTINCT id AS item_id, width, array_to_string(w[i : i + width - 1], ' ') AS s
  FROM (SELECT id, width, w, unnest(range(1, len(w) - width + 2)) AS i FROM items)),
sizes AS (SELECT item_id, count(*) AS n_shingles FROM wanted GROUP BY 1),
had AS (
  SELECT DISTINCT id AS doc_id, width, array_to_string(w[i : i + width - 1], ' ') AS s
  FROM (SELECT id, width, w, unnest(range(1, len(w) - width + 2)) AS i FROM w, (SELECT DISTINCT width FROM items) WHERE kind = 'd' AND len(w) >= width)),
shared AS (SELECT doc_id, item_id, count(*) AS n_shared FROM had JOIN wanted USING (s, width) GROUP BY ALL)
SELECT doc_id, item_id, n_shingles::INTEGER AS n_shingles, n_shared::INTEGER AS n_shared, n_shared / n_shingles AS containment
FROM shared JOIN sizes USING (item_id) WHERE n_shared >= round(n_shingles * 0.8, 9)
"""
