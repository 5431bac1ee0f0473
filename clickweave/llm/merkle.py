"""Document fingerprints: a Merkle tree over pieces, paragraphs and sections.

Sections are parted by blank lines, paragraphs by line breaks, and a paragraph is cut into pieces of `PIECE` words from its
start, with all white space kept. A leaf is the SHA-256 of its piece; a paragraph, a section and the root are SHA-256 of
their children's digests, joined by one mark for each level. So equal roots mean equal texts. The fingerprint is the
root and, for each section, its digest, then its paragraphs', then their leaves', shortened:
``root|section/paragraph.leaf.leaf/paragraph.leaf|section...``. Branches that differ locate an edit to a piece of a paragraph.

Likeness of two fingerprints is 1 for equal roots, else the share of their distinct leaves that both have (Dice).
It can be had from the fingerprint strings alone (`likeness_of_strings`).

All of it is DataFrame functions. The next document in id order is found with one shuffle of the texts: a narrow table of ids and text
hashes is range-partitioned, which gives the bounds of ranges that hold about the same number of rows whatever the ids are; each row finds its range by binary
search in these, and a window orders each range. A range's last document takes the first of the next range. Rows with one id, or none, are ordered by a
hash of their text and then by place, so that they too are dealt over ranges.

Defined results: a null text is empty; the only document follows itself; rows with one id, or without (they come first), follow each other in
the order of their texts' hashes, copies side by side; an empty table gives an empty table; columns of other names take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Rows, let, stored, table

PIECE = 8
SHORT = 16
#: One piece: white space, then up to PIECE words with the white space after them; the rest of a paragraph is its last piece.
PIECES = r"\s*+(?:\S++\s*+){1,%d}+|\s++" % PIECE


def node(children: Column, mark: str) -> Column:
    return F.sha2(F.array_join(children, mark), 256)


def short(digest: Column) -> Column:
    return F.substring(digest, 1, SHORT)


def of_paragraph(text: Column) -> Column:
    leaves = F.transform(F.regexp_extract_all(text, F.lit(PIECES), F.lit(0)), lambda x: F.sha2(x, 256))
    return let(leaves, lambda l: F.struct(node(l, ".").alias("h"), F.transform(l, short).alias("l")))


def of_section(text: Column) -> Column:
    return let(F.transform(F.split(text, "\n", -1), of_paragraph), lambda p: F.struct(node(F.transform(p, lambda x: x["h"]), "/").alias("h"), p.alias("p")))


def shown_paragraph(p: Column) -> Column:
    return F.concat(F.lit("/"), short(p["h"]), F.when(F.size(p["l"]) > 0, F.concat(F.lit("."), F.array_join(p["l"], "."))).otherwise(""))


def tree(text: Column) -> Column:
    """Struct of root, fingerprint and the distinct short leaves."""

    def made(s: Column) -> Column:
        shown = F.array_join(F.transform(s, lambda x: F.concat(short(x["h"]), F.array_join(F.transform(x["p"], shown_paragraph), ""))), "|")
        leaves = F.array_distinct(F.flatten(F.transform(s, lambda x: F.flatten(F.transform(x["p"], lambda p: p["l"])))))
        return let(node(F.transform(s, lambda x: x["h"]), "|"), lambda root: F.struct(root.alias("root"), F.concat(root, F.lit("|"), shown).alias("fingerprint"), leaves.alias("leaves")))

    return let(F.transform(F.split(text, "\n\n", -1), of_section), made)


def leaves(text: Column) -> Column:
    """The distinct short leaves alone."""
    pieces = F.flatten(F.transform(F.split(text, "\n", -1), lambda p: F.regexp_extract_all(p, F.lit(PIECES), F.lit(0))))
    return F.array_distinct(F.transform(pieces, lambda x: short(F.sha2(x, 256))))


def dice(same: Column, a: Column, b: Column) -> Column:
    total = F.size(a) + F.size(b)
    return F.when(same, 1.0).when(total == 0, 0.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / total)


def likeness(a: Column, b: Column) -> Column:
    """Of two trees, 0 to 1."""
    return dice(a["root"] == b["root"], a["leaves"], b["leaves"])


def likeness_of_strings(a: Column, b: Column) -> Column:
    """The same from two fingerprint strings."""
    leaves = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"\.([0-9a-f]+)"), F.lit(1)))
    return dice(F.substring(a, 1, 64) == F.substring(b, 1, 64), leaves(a), leaves(b))


def fingerprint(text: Column) -> Column:
    return tree(F.coalesce(text, F.lit("")))["fingerprint"]


#: Ranges for each shuffle partition.
RANGES = 2


def range_of(at: Column, bounds: Column, most: int) -> Column:
    """How many of the sorted `bounds` (`most` at most) are `at` or before it, by binary search."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(most.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when((n + step <= F.size(bounds)) & (F.get(bounds, n + step - 1) <= at), n + step).otherwise(n))


def with_next(docs: DataFrame, key: str, value: str) -> DataFrame:
    """`docs` (key, value) with next_value: that of the next row by key and value's hash; after the last, the first."""
    rows = docs.select(F.col(key).alias("id"), F.col(value).alias("value")).withColumns({"h": F.xxhash64("value"), "place": F.monotonically_increasing_id()})
    at = F.struct("id", "h", "place")
    narrow = stored(rows.select(at.alias("at")))
    dealt = narrow.repartitionByRange(RANGES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "at").select(F.spark_partition_id().alias("p"), "at")
    bounds = stored(dealt.groupBy("p").agg(F.min("at").alias("at")).agg(F.array_sort(F.collect_list("at")).alias("bounds")))
    n = bounds.select(F.size("bounds")).first()[0]
    if not n:
        return docs.select(key, value, F.col(value).alias("next_value")).limit(0)
    ranged = rows.join(F.broadcast(bounds), F.lit(True)).select("id", "value", "h", "place", range_of(at, F.col("bounds"), n).alias("r"))  # one row
    order = Window.partitionBy("r").orderBy(F.asc_nulls_first("id"), "h", "place")
    linked = ranged.select("r", "id", "value", F.lead("value").over(order).alias("after"), F.lead("r").over(order).isNull().alias("last"))
    firsts = bounds.select(F.posexplode("bounds").alias("i", "at")).select((F.col("i") + 1).alias("r"), F.col("at.id").alias("first_id"), F.col("at.h").alias("first_h"))
    heads = ranged.join(F.broadcast(firsts), "r").filter(F.col("id").eqNullSafe(F.col("first_id")) & (F.col("h") == F.col("first_h"))).groupBy("r").agg(F.min("value").alias("head"))
    follow = heads.select((F.pmod(F.col("r") - 2, F.lit(n)) + 1).alias("r"), "head")
    return linked.join(follow, "r").select(F.col("id").alias(key), F.col("value").alias(value), F.when(F.col("last"), F.col("head")).otherwise(F.col("after")).alias("next_value"))


def edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document's id, text, edited text and the next document's text."""
    given = Rows(docs)
    rows = with_next(given.df.select(given.col(key).alias("id"), F.coalesce(given.col(text), F.lit("")).alias("text")), "id", "text")
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_value"), F.lit(1), half))
    return rows.select("id", "text", edited.alias("edited"), F.col("next_value").alias("next"))


def fingerprint_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and its edited text, and the text's likeness to the edited and to the next text.

    Of the next text only the leaves are made: its root equals the text's if and only if the texts are equal.
    """
    rows = edits(docs, key, text)
    made = rows.select("id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), tree(F.col("text")).alias("a"), tree(F.col("edited")).alias("b"), leaves(F.col("next")).alias("c"), (F.col("text") == F.col("next")).alias("same"))
    return made.select(
        F.col("id").alias(key), "n_chars", "edited_sha256", F.col("a.fingerprint").alias("fingerprint"), F.col("b.fingerprint").alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("b")).alias("near_edited"), dice(F.col("same"), F.col("a.leaves"), F.col("c")).alias("near_next"),
    )


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
linked AS (SELECT doc_id, text, length(text) AS n, coalesce(lead(text) OVER (ORDER BY doc_id, text), first_value(text) OVER (ORDER BY doc_id, text)) AS next FROM d),
edits AS (SELECT doc_id, text, n, next, substr(text, 1, n - n // 2) || substr(next, 1, n // 2) AS edited FROM linked),
texts AS (SELECT doc_id, 'text' AS kind, text AS t FROM edits UNION ALL SELECT doc_id, 'edited', edited FROM edits UNION ALL SELECT doc_id, 'next', next FROM edits),
leaves AS (SELECT doc_id, kind, list_transform(string_split(t, E'\n\n'), lambda s: list_transform(string_split(s, E'\n'), lambda p:
  list_transform(regexp_extract_all(p, '[ \t\x0B\f\r]*(?:[^ \t\n\x0B\f\r]+[ \t\x0B\f\r]*){1,8}|[ \t\x0B\f\r]+'), lambda x: sha256(x)))) AS l FROM texts),
paragraphs AS (SELECT doc_id, kind, list_transform(l, lambda s: list_transform(s, lambda p: {'h': sha256(array_to_string(p, '.')), 'l': list_transform(p, lambda x: substr(x, 1, 16))})) AS s FROM leaves),
sections AS (SELECT doc_id, kind, list_transform(s, lambda x: {'h': sha256(array_to_string(list_transform(x, lambda p: p.h), '/')), 'p': x}) AS s FROM paragraphs),
trees AS (
  SELECT doc_id, kind, sha256(array_to_string(list_transform(s, lambda x: x.h), '|')) AS root,
    array_to_string(list_transform(s, lambda x: substr(x.h, 1, 16) || array_to_string(list_transform(x.p, lambda p: '/' || substr(p.h, 1, 16) || CASE WHEN len(p.l) > 0 THEN '.' || array_to_string(p.l, '.') ELSE '' END), '')), '|') AS shown,
    flatten(list_transform(s, lambda x: flatten(list_transform(x.p, lambda p: p.l)))) AS leaf FROM sections),
counted AS (SELECT DISTINCT doc_id, kind, x FROM (SELECT doc_id, kind, unnest(leaf) AS x FROM trees)),
shared AS (SELECT a.doc_id, b.kind, count(*) AS n FROM counted a JOIN counted b ON a.doc_id = b.doc_id AND a.x = b.x AND a.kind = 'text' GROUP BY ALL),
likely AS (
  SELECT a.doc_id, b.kind, CASE WHEN a.root = b.root THEN 1.0::DOUBLE WHEN len(list_distinct(a.leaf)) + len(list_distinct(b.leaf)) = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * coalesce(n, 0)::DOUBLE / (len(list_distinct(a.leaf)) + len(list_distinct(b.leaf))) END AS near, b.root || '|' || b.shown AS fp
  FROM trees a JOIN trees b ON a.doc_id = b.doc_id AND a.kind = 'text' LEFT JOIN shared ON shared.doc_id = b.doc_id AND shared.kind = b.kind)
SELECT e.doc_id, e.n AS n_chars, sha256(e.edited) AS edited_sha256, t.fp AS fingerprint, d.fp AS edited_fingerprint, d.near AS near_edited, x.near AS near_next
FROM edits e JOIN likely t ON t.doc_id = e.doc_id AND t.kind = 'text' JOIN likely d ON d.doc_id = e.doc_id AND d.kind = 'edited' JOIN likely x ON x.doc_id = e.doc_id AND x.kind = 'next'
"""
