"""Toxicity: a factorization machine over hashed terms.

Terms of a text are its distinct words and the distinct character 5-grams of its words with their borders, hashed to
`SPACE` slots. The fit keeps the `FEATURES` slots whose presence says most about the label (chi-squared), and
learns a weight and a factor vector for each by logistic loss, so that two terms together (an insult and the mention of a
group) can weigh more or less than each alone.

Defined results: an empty or null text has no term and gets the model's base rate; every text gets a score, of 0 to 1.
Repeated rows give repeated rows, an empty table an empty table; columns of any other names pass. Fitting takes about `PER_CLASS` rows of
each label and `SAMPLE_BYTES` of text; scoring takes every row and whole texts. With no labelled row, or labels all alike, the score is that label's smoothed rate for all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Rows, code_points, in_blocks, labelled_sample, table
from .language_id import letters

#: Bounds of the fit: rows of each label; slots of the hash; slots kept; factors of each.
PER_CLASS, SPACE, FEATURES, FACTORS = 4000, 1 << 20, 2048, 4
GRAM = 5
MIX = np.uint64(0x9E3779B97F4A7C15)


def slots(hashes: np.ndarray) -> np.ndarray:
    mixed = (hashes ^ (hashes >> np.uint64(29))) * MIX
    return (mixed >> np.uint64(44)).astype(np.int64)


def terms(text: str | None) -> np.ndarray:
    """The distinct slots of a text's words and 5-grams."""
    points = code_points((text or "").lower())
    is_letter = letters()[points]
    points = np.concatenate([[32], np.where(is_letter, points, 32), [32]]).astype(np.uint64)
    starts = np.flatnonzero((points[1:] != 32) & (points[:-1] == 32)) + 1
    if not len(starts):
        return np.zeros(0, np.int64)
    ends = np.flatnonzero((points[1:] == 32) & (points[:-1] != 32)) + 1
    # words: a polynomial in the place inside the word
    place = np.arange(len(points), dtype=np.int64)
    place[starts[0] :] -= np.repeat(starts, np.diff(np.append(starts, len(points))))
    power = np.power(np.uint64(1_000_003), np.arange(int((ends - starts).max()) + 1, dtype=np.uint64))
    worth = np.where(points == 32, np.uint64(0), points * power[np.minimum(place, len(power) - 1)])
    words = np.add.reduceat(worth, starts) * np.uint64(31) + np.uint64(1)
    # 5-grams that don't go beyond one word and its borders
    spread = np.zeros(max(0, len(points) - GRAM + 1), np.uint64)
    inner = np.zeros(len(spread), np.int64)
    for i in range(GRAM):
        spread = spread * np.uint64(1_000_033) + points[i : i + len(spread)]
        if 0 < i < GRAM - 1:
            inner += points[i : i + len(spread)] == 32
    return np.unique(slots(np.concatenate([words, spread[inner == 0]])))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Machine:
    base: float
    features: np.ndarray
    linear: np.ndarray
    factors: np.ndarray

    def presence(self, texts: list[np.ndarray]) -> np.ndarray:
        x = np.zeros((len(texts), len(self.features)), np.float32)
        for row, t in zip(x, texts, strict=True):
            if len(self.features):
                at = np.searchsorted(self.features, t)
                at[at == len(self.features)] = 0
                row[at[self.features[at] == t]] = 1
        return x

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.base + x @ self.linear + 0.5 * (((x @ self.factors) ** 2) - x @ (self.factors**2)).sum(1)

    def score(self, texts: list) -> pd.DataFrame:
        s = sigmoid(self.margin(self.presence([terms(t) for t in texts])).astype(float)) if texts else np.zeros(0)
        return pd.DataFrame({"score": s})


def fit(texts: list, labels: np.ndarray, weight: np.ndarray, features: int = FEATURES, factors: int = FACTORS, rounds: int = 60, step: float = 0.03, decay: float = 4e-4) -> Machine:
    """The machine of weighted labelled texts, by Adam on the logistic loss; the same on every run."""
    y, weight = np.asarray(labels, float), np.asarray(weight, float)
    rate = ((weight * y).sum() + 1) / (weight.sum() + 2)
    base = float(np.log(rate / (1 - rate)))
    if len(np.unique(y)) < 2:
        return Machine(base, np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros((0, factors), np.float32))
    found = [terms(t) for t in texts]
    with_it = np.bincount(np.concatenate(found), minlength=SPACE).astype(float)
    bad = np.bincount(np.concatenate([f for f, v in zip(found, y, strict=True) if v]), minlength=SPACE).astype(float)
    n, n1 = len(y), y.sum()
    expected = with_it * n1 / n
    chi = np.where(with_it >= 3, (np.abs(bad - expected) - 0.5).clip(0) ** 2 * n / np.maximum(1e-9, expected * (1 - n1 / n) * (n - with_it + 1)), 0)
    best = np.argsort(-chi, kind="stable")[:features]
    m = Machine(base, np.sort(best[chi[best] > 12]), None, None)
    k = len(m.features)
    rng = np.random.default_rng(7)
    m.linear, m.factors = np.zeros(k, np.float32), rng.normal(0, 0.02, (k, factors)).astype(np.float32)
    x = np.concatenate([m.presence(found[i : i + 512]).astype(np.uint8) for i in range(0, n, 512)])
    p = [np.float32([base]), m.linear, m.factors]
    mean, square, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(rounds):
        order = rng.permutation(n)
        for rows in np.array_split(order, max(1, n // 256)):
            b = x[rows].astype(np.float32)
            m.base = float(p[0][0])
            wrong = ((sigmoid(m.margin(b)) - y[rows]) * weight[rows] / len(rows)).astype(np.float32)
            sums = b @ m.factors
            grads = [np.float32([wrong.sum()]), b.T @ wrong + decay * m.linear / 8, b.T @ (wrong[:, None] * sums) - (b.T @ wrong)[:, None] * m.factors + decay * m.factors]
            t += 1
            for a, g, mu, sq in zip(p, grads, mean, square, strict=True):
                mu += 0.1 * (g - mu)
                sq += 0.001 * (g * g - sq)
                a -= step * (mu / (1 - 0.9**t)) / (np.sqrt(sq / (1 - 0.999**t)) + 1e-8)
    m.base = float(p[0][0])
    return m


def train(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id", each: int = PER_CLASS) -> Machine:
    """Fits on the texts of about `each` rows of every label (0 or 1)."""
    sample, weight = labelled_sample(docs, labels, text, label, key, each)
    return fit(sample["text"].tolist(), sample["label"].to_numpy(float), weight)


def scorer(docs: DataFrame, machine: Machine):
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    @F.pandas_udf("score double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        return in_blocks(shared.value.score, batches)

    return scored


def score_toxicity(docs: DataFrame, machine: Machine, text: str = "text", into: str = "score") -> DataFrame:
    """`docs` with a score; an input column of that name is replaced."""
    rows = Rows(docs)
    return rows.restored(rows.df.withColumn("scored", scorer(docs, machine)(rows.col(text))), **{into: F.col("scored.score")})


def keep_clean(docs: DataFrame, machine: Machine, below: float = 0.5, text: str = "text") -> DataFrame:
    """`docs` whose score is below `below`; all columns stay as they are."""
    rows = Rows(docs)
    return rows.restored(rows.df.withColumn("scored", scorer(docs, machine)(rows.col(text))).filter(F.col("scored.score") < below))


#: Rows of this remainder are held out from the fit; rows without an id are neither learned from nor held out.
HELD_OUT = "pmod(crc32(cast(doc_id AS string)), 5) = 0"


def trained(spark: SparkSession, sf_dir: str) -> Machine:
    return train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").filter(f"NOT {HELD_OUT}"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score_toxicity(docs, trained(spark, sf_dir))
    return found.select("doc_id", F.expr(f"coalesce({HELD_OUT}, false)").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
