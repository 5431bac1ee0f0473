"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is good or bad. A line's features describe it (letters, capitals, symbols, digits, separators, word
lengths, repetition of an earlier line) and the lines before and after it; transitions couple neighbours. Forward-backward
gives each line's probability to be good, and the mean of these, weighted by line lengths, is the document's quality.
Labels are known for whole documents only, so the fit starts with the document's label on each of its lines, then lets
the lines of bad documents that look good to the first model be good and fits again; last, a logistic curve maps quality to the label's
probability.

Chains are worked through in blocks: products of 2 x 2 matrices of each block, then a pass over the blocks, then all blocks side by side, so a
text of a million lines takes as many Python steps as the root of that. Features are made for `LINES` lines at a time.

Defined results: a document without text is one empty line; every text gets a score, of 0 to 1; repeated rows give repeated rows; an
empty table gives an empty table; columns of any other names pass. Fitting takes about `PER_CLASS` rows of each label, `SAMPLE_BYTES`
of text and `FIT_LINES` lines; scoring takes every row and whole texts. Without both labels, all get the smoothed rate of the label.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Rows, code_points, in_blocks, labelled_sample, table
from .language_id import letters
from .toxicity import sigmoid

#: Bounds of the fit: rows of each label, and lines.
PER_CLASS, FIT_LINES = 1500, 1 << 18
#: Lines whose features are made at once.
LINES = 1 << 15
#: A line's own features; with those of its two neighbours and their absence, a row has OWN * 3 + 3 columns.
OWN = 13


@cache
def kinds() -> np.ndarray:
    """For each code point below 0x3000, bits: 1 letter, 2 capital, 4 digit, 8 blank, 16 symbol, 32 bar, 64 end mark."""
    out = np.zeros(0x3000, np.uint8)
    for c in range(len(out)):
        x = chr(c)
        out[c] = (1 * bool(letters()[c])) | (2 * x.isupper()) | (4 * x.isdigit()) | (8 * x.isspace()) | (16 * (not x.isalnum() and not x.isspace() and x not in ".,;:'\"-()?¿¡’")) | (32 * (x in "|\t")) | (64 * (x in ".?!"))
    return out


def own_features(text: str | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features of the lines themselves, and the lines' lengths, for `LINES` lines at a time."""
    lines = (text or "").split("\n")
    seen: set[str] = set()
    for at in range(0, len(lines), LINES):
        some = lines[at : at + LINES]
        again = np.array([(x in seen or seen.add(x) or False) and bool(x) for x in some], float)
        yield features_of(some, again)


def features_of(lines: list[str], again: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    points = code_points("\n".join(lines) + "\n")
    kind = kinds()[np.minimum(points, 0x2FFF)]
    kind[points > 0x2FFF] = 1
    ends = np.flatnonzero(points == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    length = (ends - starts).astype(float)

    def count(flags: np.ndarray) -> np.ndarray:
        # each line with its break, which has none of the flags
        return np.add.reduceat(flags, starts, dtype=np.int64).astype(float)

    blank = (kind & 8) > 0
    first = ~blank & np.concatenate([[True], blank[:-1]])
    last = ~blank & np.concatenate([blank[1:], [True]])
    words, some = np.maximum(1, count(first)), np.maximum(1, length)
    is_letter = np.maximum(1, count((kind & 1) > 0))
    # words that follow themselves; none where all are different
    echo = np.array([0 if len(set(w)) == len(w) else sum(map(operator.eq, w, w[1:])) for w in map(str.split, lines)], float)
    return np.stack([
        count((kind & 1) > 0) / some,
        count((kind & 2) > 0) / is_letter,
        count((kind & 4) > 0) / some,
        count((kind & 16) > 0) / some * 5,
        count((kind & 32) > 0) / words,
        count(last & ((kind & 16) > 0)) / words,
        count(last & ((kind & 64) > 0)) / words,
        np.minimum(2, is_letter / words / 8),
        np.log1p(length) / 6,
        (words < 4) * 1.0,
        again,
        echo / words * 3,
        np.abs(np.minimum(2, length / words / 8) - 0.75),
    ], 1), some


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """All columns of each line, as the fit takes them, and the lines' lengths (at least 1)."""
    parts = list(own_features(text))
    x, length = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    edge = np.zeros((1, OWN))
    before, after = np.concatenate([edge, x[:-1]]), np.concatenate([x[1:], edge])
    ends_of = np.zeros((len(x), 2))
    ends_of[0, 0], ends_of[-1, 1] = 1, 1
    return np.concatenate([np.ones((len(x), 1)), ends_of, x, before, after], 1), length


def line_scores(text: str | None, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``line_features(text)[0] @ weights`` and the lengths, without the columns of all lines at once."""
    parts = [(x @ weights[3:].reshape(3, OWN).T, length) for x, length in own_features(text)]
    own, length = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    scores = weights[0] + own[:, 0]
    scores[0] += weights[1]
    scores[-1] += weights[2]
    scores[1:] += own[:-1, 1]
    scores[:-1] += own[1:, 2]
    return scores, length


@dataclass
class Chain:
    """Weights of a line's log-odds to be good, the 2 x 2 transition scores, and the curve from quality to probability."""

    weights: np.ndarray
    links: np.ndarray
    curve: tuple[float, float]

    def score(self, texts: list) -> pd.DataFrame:
        if not texts:
            return pd.DataFrame({"score": np.zeros(0), "quality": np.zeros(0)})
        docs = [line_scores(t, self.weights) for t in texts]
        good, _, _ = marginals([d[0] for d in docs], self.links)
        quality = np.round([np.average(g, weights=d[1]) for g, d in zip(good, docs, strict=True)], 9)  # alike in every block of texts
        return pd.DataFrame({"score": sigmoid(self.curve[0] * quality + self.curve[1]), "quality": quality})


def marginals(scores: list[np.ndarray], links: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, float]:
    """P(good) of each line, expected transition counts, and the sum of log partition functions.

    All chains are one: the first line of each has a transition of zeros, which forgets what is before it. A step is a 2 x 2 matrix of
    positive numbers, scaled to a largest of 1; `step[i, j]` holds an entry of all of them, blocks as columns.
    """
    sizes = np.array([len(s) for s in scores])
    firsts = np.concatenate([[0], np.cumsum(sizes)])
    u, n = np.concatenate(scores), int(firsts[-1])
    width = max(1, int(np.sqrt(n)))  # lines of a block
    blocks = -(-n // width)
    log = np.zeros((2, 2, blocks * width))
    log[:, :, :n] = links[:, :, None]
    log[:, :, firsts[:-1]] = 0
    log[:, 1, :n] += u
    top = log.max((0, 1))
    step = np.exp(log - top)
    step[:, :, n:] = np.eye(2)[:, :, None]
    step = np.ascontiguousarray(step.reshape(2, 2, blocks, width).transpose(3, 0, 1, 2))  # line of the block, from, to, block

    whole = np.repeat(np.eye(2)[:, :, None], blocks, 2)
    for s in step:
        whole = whole[:, :1] * s[0] + whole[:, 1:] * s[1]
        whole /= whole.max((0, 1))
    ahead, behind = np.full((2, blocks), 0.5), np.ones((2, blocks))
    for k in range(1, blocks):
        v = ahead[:, k - 1] @ whole[:, :, k - 1]
        ahead[:, k] = v / v.sum()
    for k in range(blocks - 2, -1, -1):
        v = whole[:, :, k + 1] @ behind[:, k + 1]
        behind[:, k] = v / v.max()

    alpha, beta, scale = np.empty((width, 2, blocks)), np.empty((width, 2, blocks)), np.empty((width, blocks))
    for t, s in enumerate(step):
        ahead = ahead[0] * s[0] + ahead[1] * s[1]
        scale[t] = ahead.sum(0)
        ahead /= scale[t]
        alpha[t] = ahead
    for t in range(width - 1, -1, -1):
        beta[t] = behind
        behind = step[t][:, 0] * behind[0] + step[t][:, 1] * behind[1]
        behind /= behind.max(0)

    flat = lambda x: x.transpose(1, 2, 0).reshape(2, -1)[:, :n]
    alpha, beta = flat(alpha), flat(beta)
    both = alpha * beta
    good = both[1] / both.sum(0)
    inner = np.ones(n, bool)
    inner[firsts[:-1]] = False
    here = np.flatnonzero(inner)
    pair = alpha[:, None, here - 1] * np.exp(log[:, :, here] - top[here]) * beta[None, :, here]
    return np.split(good, firsts[1:-1]), (pair / pair.sum((0, 1))).sum(2), float(np.log(scale.T.reshape(-1)[:n]).sum() + top[:n].sum())


def fit_lines(docs: list[np.ndarray], lines: list[np.ndarray], steps: int = 60, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions of the CRF for 0/1 line labels, by Adam on the mean log-likelihood of a line."""
    x, y = np.concatenate(docs), np.concatenate(lines)
    bounds = np.cumsum([len(d) for d in docs])[:-1]
    seen = np.zeros((2, 2))
    for z in lines:
        np.add.at(seen, (z[:-1].astype(int), z[1:].astype(int)), 1)
    p = [np.zeros(x.shape[1]), np.zeros((2, 2))]
    mean, square = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for t in range(1, steps + 1):
        good, pairs, _ = marginals(np.split(x @ p[0], bounds), p[1])
        grads = [x.T @ (np.concatenate(good) - y) / len(y) + decay * p[0], (pairs - seen) / len(y) + decay * p[1]]
        for a, g, mu, sq in zip(p, grads, mean, square, strict=True):
            mu += 0.1 * (g - mu)
            sq += 0.01 * (g * g - sq)
            a -= 0.15 * (mu / (1 - 0.9**t)) / (np.sqrt(sq / (1 - 0.99**t)) + 1e-8)
    return p[0], p[1]


def fit(texts: list, labels: np.ndarray, weight: np.ndarray) -> Chain:
    y = np.asarray(labels, float)
    rate = ((weight * y).sum() + 1) / (np.sum(weight) + 2)
    if len(np.unique(y)) < 2:
        return Chain(np.zeros(3 + 3 * OWN), np.zeros((2, 2)), (0.0, float(np.log(rate / (1 - rate)))))
    found = [line_features(t) for t in texts]
    docs = [f[0] for f in found]
    lines = [np.full(len(d), v) for d, v in zip(docs, y, strict=True)]
    weights, links = fit_lines(docs, lines)
    good, _, _ = marginals([d @ weights for d in docs], links)
    # of a bad document, a line stays bad if the model doubts it, or if it is the worst
    lines = [z if v else np.where(g <= max(0.5, g.min()), 0.0, 1.0) for z, v, g in zip(lines, y, good, strict=True)]
    weights, links = fit_lines(docs, lines)
    good, _, _ = marginals([d @ weights for d in docs], links)
    quality = np.array([np.average(g, weights=f[1]) for g, f in zip(good, found, strict=True)])
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton's method with a little shrinkage, which also holds separable labels
        s = sigmoid(a * quality + b)
        r, w = weight * (s - y), weight * s * (1 - s) + 1e-9
        g = np.array([(r * quality).sum() + 0.02 * a, r.sum()])
        h = np.array([[(w * quality**2).sum() + 0.02, (w * quality).sum()], [(w * quality).sum(), w.sum() + 1e-6]])
        move = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a - move[0], b - move[1]
    return Chain(weights, links, (float(a), float(b)))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", key: str = "doc_id", each: int = PER_CLASS) -> Chain:
    sample, weight = labelled_sample(docs, labels, text, label, key, each, FIT_LINES)
    return fit(sample["text"].tolist(), sample["label"].to_numpy(float), weight)


def score_quality(docs: DataFrame, chain: Chain, text: str = "text", into: str = "score") -> DataFrame:
    """`docs` with the label's probability and the CRF's quality; input columns of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    @F.pandas_udf("score double, quality double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        return in_blocks(shared.value.score, batches)

    rows = Rows(docs)
    return rows.restored(rows.df.withColumn("scored", scored(rows.col(text))), **{into: F.col("scored.score"), "line_quality": F.col("scored.quality")})


#: Rows of this remainder are held out from the fit; rows without an id are neither learned from nor held out.
HELD_OUT = "pmod(crc32(cast(doc_id AS string)), 3) = 1"


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = train(docs, table(spark, sf_dir, "labels").filter(f"NOT {HELD_OUT}"))
    found = score_quality(docs, chain)
    return found.select("doc_id", F.expr(f"coalesce({HELD_OUT}, false)").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
