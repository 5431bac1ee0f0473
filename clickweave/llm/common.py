"""Helpers that the corpus operators share: tables, checkpoints, samples, text as code points."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickweave.shared import discard, scratch, shared_folder, stored  # noqa: F401

#: Rows, and code points unless one text alone has more, that a kernel turns into one dense block; bound a Python worker's memory.
BLOCK, BLOCK_POINTS = 128, 1 << 22


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, read by Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` cut from its lineage, in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """`df` dealt over as many partitions as shuffles have, for rows that are few now and multiply next."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


class Rows:
    """A table under column names of its own (c0, c1, ...), so that no column of a caller's meets one that an operator uses inside."""

    def __init__(self, df: DataFrame):
        self.names = df.columns
        self.df = df.toDF(*[f"c{i}" for i in range(len(self.names))])

    def name(self, given: str) -> str:
        """The own name of a given column (case ignored, as Spark resolves names)."""
        at = [i for i, n in enumerate(self.names) if n.lower() == given.lower()]
        if len(at) != 1:
            raise ValueError(f"{len(at)} columns are named {given}")
        return f"c{at[0]}"

    def col(self, given: str) -> Column:
        return F.col(self.name(given))

    def must_be_integer(self, given: str) -> None:
        if self.df.schema[self.name(given)].dataType.typeName() not in ("long", "integer", "short", "byte"):
            raise ValueError(f"{given} must be an integer")

    def restored(self, found: DataFrame, leave_out: Iterable[str] = (), **new: Column) -> DataFrame:
        """`found` under the given names, with `new` columns in place of given ones of their names."""
        taken = {n.lower() for n in (*leave_out, *new)}
        kept = [i for i, n in enumerate(self.names) if n.lower() not in taken]
        return found.select(*[f"c{i}" for i in kept], *[c.alias(f"n{j}") for j, c in enumerate(new.values())]).toDF(*[self.names[i] for i in kept], *new)


#: Bytes of text that a fit takes to the driver at most; texts longer than a 64th of it aren't learned from.
SAMPLE_BYTES = 48 << 20


def draw(key: Column, seed: str) -> Column:
    """A number from 0 to 1 that depends on the key and the seed alone."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def sampled(df: DataFrame, stratum: str, key: str, each: int, most: int = 1000) -> tuple[DataFrame, dict]:
    """About `each` rows of every value of `stratum`, chosen by a hash of `key`, and the values' row counts.

    The choice is the same on every run and needs no sort; a value with fewer rows gives all of them.
    Values beyond the `most` commonest aren't learned, so the sample stays near ``each * most`` rows at most.
    """
    counts = {r[0]: r[1] for r in df.groupBy(stratum).agg(F.count("*").alias("n")).orderBy(F.desc("n"), stratum).limit(most).collect()}
    if not counts:
        return df.limit(0), counts
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, each / n))])
    return df.filter(draw(F.col(key), "sample") < F.coalesce(F.try_element_at(share, F.col(stratum)), F.lit(0.0))), counts


def lines_of(text: str) -> Column:
    return F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1


def within_bytes(sample: DataFrame, text: str, key: str, most: int = SAMPLE_BYTES, lines: int | None = None) -> DataFrame:
    """`sample`, thinned by a hash of `key` to about `most` bytes of text and about `lines` lines; texts of over a 64th of either are left out."""
    bounds = [(F.octet_length(text), most)] + ([(lines_of(text), lines)] if lines else [])
    fitting = sample
    for measure, bound in bounds:
        fitting = fitting.filter(measure <= bound // 64)
    sizes = fitting.agg(*[F.sum(measure) for measure, _ in bounds]).first()
    share = min(bound / max(1, size or 0) for size, (_, bound) in zip(sizes, bounds, strict=True))
    return fitting if share >= 1 else fitting.filter(draw(F.col(key), "bytes") < share)


def labelled_sample(docs: DataFrame, labels: DataFrame, text: str, label: str, key: str, each: int, lines: int | None = None) -> tuple[pd.DataFrame, np.ndarray]:
    """Texts and 0/1 labels of about `each` rows of each label, and weights that stand for all labelled rows.

    Labels are drawn first; what is broadcast to find their texts is as bounded as the sample, in rows, in bytes and, if given, in `lines`.
    """
    rows = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).filter("label IN (0, 1)")
    drawn, counts = sampled(rows, "label", "key", each)
    found = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(drawn), "key")
    sample = within_bytes(found, "text", "key", lines=lines).select("text", "label").toPandas()
    weight = np.array([counts[k] / max(1, (sample["label"] == k).sum()) for k in sample["label"]])
    return sample, weight / weight.mean() if len(weight) else weight


def code_points(text: str) -> np.ndarray:
    """The text's code points; lone surrogates pass."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def in_blocks(score: Callable[[list], pd.DataFrame], batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """`score` over every Arrow batch, at most BLOCK texts and, but for a longer text alone, BLOCK_POINTS code points at a time."""
    for s in batches:
        parts, block, held = [], [], 0
        for text in s.tolist():
            n = len(text or "")
            if block and (len(block) == BLOCK or held + n > BLOCK_POINTS):
                parts.append(score(block))
                block, held = [], 0
            block.append(text)
            held += n
        parts += [score(block)] if block or not parts else []
        yield pd.concat(parts, ignore_index=True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, which is worked out once a row however often `body` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Rows, and bytes of text, up to which a side is broadcast; beyond either, the larger side's keys are salted.
BROADCAST_ROWS, BROADCAST_BYTES, SALTS = 200_000, 32 << 20, 16


def broadcastable(small: DataFrame) -> bool:
    """Whether the rows and the texts of `small`, which is checkpointed, are within the bounds."""
    texts = [F.coalesce(F.octet_length(c if kind == "string" else F.array_join(c, "")), F.lit(0)).cast("long") for c, kind in small.dtypes if kind in ("string", "array<string>")]
    rows, size = small.agg(F.count("*"), F.coalesce(F.sum(sum(texts, F.lit(0).cast("long"))), F.lit(0))).first()
    return rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES


def join_small(rows: DataFrame, small: DataFrame, keys: list[str], spread: str) -> DataFrame:
    """`rows` left joined with `small`, which has few rows a key and is checkpointed; `spread` is a column that salts hot keys."""
    if broadcastable(small):
        return rows.join(F.broadcast(small), keys, "left")
    salted = small.withColumn("join_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("join_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(salted, [*keys, "join_salt"], "left").drop("join_salt")
