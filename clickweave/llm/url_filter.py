"""URL filters: a sorted digest array of rules, probed by binary search.

A rule is (verdict, host, path prefix). Its key is the string host+path, and its digest that string's 64-bit
xxhash. The array of sorted digests goes to one file, the key strings to another; executors map both into
memory. A URL is tried with each suffix of its host and each path length that rules have, all digests
of an Arrow batch in one vectorised binary search; a hit counts only if the stored string is the same, so that
colliding digests can't decide.

Defined results: a null URL or one without ``://`` has an empty host and path; the longest rule wins, and of two
equal rules the block; a URL that no rule fits gets `default`, since the array doesn't list it; repeated rows give repeated rows, an empty table
an empty table; columns of any other names pass. The number of rules isn't limited: Spark sorts them, the driver writes the files as they
stream by, and executors map them, so memory holds only the parts that are probed; each executor's disk holds them once.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterable, Iterator
from contextlib import ExitStack
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Rows


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    rest = F.instr(url, "://") > 0
    after = F.regexp_replace(url, r"(?s)^.*?://", "")
    host = F.translate(F.regexp_extract(after, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(rest, host).otherwise(""), F.when(rest, path).otherwise("")


def digest(key: str) -> int:
    return xxhash.xxh64_intdigest(key.encode("utf-8", "surrogatepass"), 42)


def in_order(rules: DataFrame | Iterable[tuple[str, str, str]]) -> Iterator[tuple[int, str, bool, set[int], int]]:
    """Digest, key, whether it blocks, path lengths and host labels of each rule, in the order of digests.

    A table is sorted by Spark and streams by; a list, which the caller holds anyway, is sorted as it is.
    """
    if isinstance(rules, DataFrame):
        host = F.translate(F.coalesce("host", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        path = F.coalesce("path", F.lit(""))
        keyed = rules.select(F.coalesce("verdict", F.lit("null")).alias("verdict"), F.concat(host, path).alias("key"), F.char_length(path).alias("length"), F.size(F.split(host, r"\.")).alias("labels"))
        one = keyed.groupBy("key").agg(F.collect_set("verdict").alias("verdicts"), F.collect_set("length").alias("lengths"), F.max("labels").alias("labels"))
        # Spark's xxhash64 of one string is the XXH64 of its UTF-8 bytes with seed 42; unsigned order is that of the number with its sign turned
        rows = ((r.digest & (1 << 64) - 1, r.key, set(r.verdicts), set(r.lengths), r.labels) for r in one.withColumn("digest", F.xxhash64("key")).orderBy(F.col("digest").bitwiseXOR(F.lit(-(1 << 63))), "key").toLocalIterator())
    else:
        kept: dict[str, tuple[set, set, int]] = {}
        for verdict, host, path in rules:
            host = host.translate({c: c + 32 for c in range(65, 91)})
            verdicts, lengths, labels = kept.get(host + path, (set(), set(), 0))
            kept[host + path] = (verdicts | {str(verdict)}, lengths | {len(path)}, max(labels, host.count(".") + 1))
        rows = sorted((digest(k), k, *x) for k, x in kept.items())
    for number, key, verdicts, lengths, labels in rows:
        if wrong := verdicts - {"allow", "block"}:
            raise ValueError(f"verdict must be allow or block, not {wrong.pop()!r}")
        yield number, key, "block" in verdicts, lengths, labels


class DigestArray:
    """A file of sorted digests, verdicts and key strings, shared with the executors by ``addFile``."""

    def __init__(self, spark: SparkSession, rules: DataFrame | Iterable[tuple[str, str, str]]):
        folder = tempfile.mkdtemp(prefix="digest-array-")
        self.name = os.path.basename(folder)
        seen: set[int] = set()
        self.labels = n = end = 0
        parts = [os.path.join(folder, f"part-{x}") for x in ("digests", "ends", "blocks", "texts")]
        with ExitStack() as stack:
            digests, ends, blocks, texts = (stack.enter_context(open(p, "wb")) for p in parts)
            ends.write(end.to_bytes(8, "little"))
            for number, key, block, lengths, labels in in_order(rules):
                text = key.encode("utf-8", "surrogatepass")
                n, end = n + 1, end + len(text)
                seen |= lengths
                self.labels = max(self.labels, labels)
                digests.write(number.to_bytes(8, "little"))
                ends.write(end.to_bytes(8, "little"))
                blocks.write(bytes([block]))
                texts.write(text)
        self.lengths = sorted(seen)
        with open(os.path.join(folder, self.name), "wb") as whole:
            whole.write(n.to_bytes(8, "little"))
            for p in parts:
                with open(p, "rb") as part:
                    shutil.copyfileobj(part, whole)
            whole.write(b"\0")
        spark.sparkContext.addFile(os.path.join(folder, self.name))


@cache
def mapped(name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Digests, string ends, verdicts and bytes of an array's file, mapped once in each worker."""
    raw = np.memmap(SparkFiles.get(name), "u1", "r")
    n = int(raw[:8].view("<u8")[0])
    a, b, c = 8 + 8 * n, 16 + 16 * n, 16 + 17 * n
    return raw[8:a].view("<u8"), raw[a:b].view("<u8"), raw[b:c], raw[c:]


def probe(name: str, lengths: list[int], labels: int, hosts: list[str], paths: list[str]) -> pd.DataFrame:
    """Rule and verdict of each host and path; null where no rule fits."""
    digests, ends, block, texts = mapped(name)
    owner, keys = [], []
    for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
        parts = host.split(".")
        suffixes = [".".join(parts[j:]) for j in range(max(0, len(parts) - labels), len(parts))]
        for suffix in suffixes:
            for n in lengths:
                if n <= len(path):
                    owner.append(i)
                    keys.append(suffix + path[:n])
    wanted = np.fromiter((digest(k) for k in keys), "<u8", len(keys))
    at = np.searchsorted(digests, wanted)
    best: dict[int, tuple[int, str, str]] = {}
    for j in np.flatnonzero(at < len(digests)):
        key, k = keys[j].encode("utf-8", "surrogatepass"), int(at[j])
        while k < len(digests) and digests[k] == wanted[j]:  # equal digests stand side by side
            if texts[int(ends[k]) : int(ends[k + 1])].tobytes() == key:
                found = (len(keys[j]), keys[j], "block" if block[k] else "allow")
                best[owner[j]] = max(best.get(owner[j], found), found)
            k += 1
    none = (0, None, None)
    return pd.DataFrame([best.get(i, none)[1:] for i in range(len(hosts))], columns=["rule", "verdict"])


def judge_urls(pages: DataFrame, rules: DataFrame | Iterable[tuple[str, str, str]], url: str = "url", default: str = "allow") -> DataFrame:
    """`pages` with host, path, rule and verdict of its URLs; input columns of these names are replaced.

    `rules` are (verdict, host, path) tuples, or a table with these columns.
    """
    array = DigestArray(pages.sparkSession, rules)
    name, lengths, labels = array.name, array.lengths, array.labels

    @F.pandas_udf("rule string, verdict string")
    def judged(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for hosts, paths in batches:
            yield probe(name, lengths, labels, hosts.tolist(), paths.tolist())

    rows = Rows(pages)
    host, path = split_url(rows.col(url))
    found = rows.df.withColumns({"host": host, "path": path}).withColumn("found", judged("host", "path"))
    return rows.restored(found, host=F.col("host"), path=F.col("path"), rule=F.col("found.rule"), verdict=F.coalesce("found.verdict", F.lit(default)))


#: The rules of the registered query, in the form (verdict, host, path).
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), RULES).drop("url")


ORACLE_SQL = r"""
WITH rules(verdict, rhost, rpath) AS (VALUES
  ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
  ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut),
fits AS (
  SELECT p.page_id, p.host, p.path, r.rhost || r.rpath AS rule, r.verdict
  FROM parts p JOIN rules r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath)),
best AS (
  SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM fits GROUP BY ALL)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN best b ON p.page_id = b.page_id AND p.host = b.host AND p.path = b.path
"""
