"""Language ID: blended-spectrum presence kernel, Nyström landmarks, one-versus-rest kernel ridge regression.

The kernel of two texts is the number of distinct character n-grams (n = 1 to 3, of lower-cased letters and single
blanks) that both have, over the geometric mean of their own numbers. Landmarks are training texts; a text's
Nyström features are its kernel row to the landmarks times the landmarks' own kernel to the power -1/2. One ridge
regression for each language is solved in closed form. Executors score a block of texts by two matrix products. The kernel counts the
`WIDTH` n-grams that most landmarks have (of fewer, all), while a text's own number is that of all its n-grams; so a model has at most
`LANDMARKS` x `WIDTH` flags, whatever scripts its texts are in.

A text of a language that wasn't learned has no margin near -1 or 1 by right, only by its few common n-grams: its best two margins lie
close together, or its Nyström features are short. `identify` can reject such texts: a language claims a text if the lead of
its margin and the length of the features are at least `SLACK` times what all but `LOST` of its own training rows have, each row's
lead taken with the row left out of the fit, its length only if it is no landmark.

Defined results: `und` and score 0 for a null text or one without a letter; ties go to the first language in name order; a
training sample without any language gives `und` for all; repeated rows give repeated rows; columns of any other names pass. Fitting
takes about `PER_LANGUAGE` rows of each language and `SAMPLE_BYTES` of text (see `sampled`, `within_bytes`); scoring takes every row and
whole texts.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Rows, code_points, in_blocks, sampled, table, within_bytes

#: Bounds of the fit: training rows of each language, and landmarks of all.
PER_LANGUAGE, LANDMARKS = 700, 192
RIDGE, SPECTRUM = 1e-3, 3
#: n-grams that the kernel counts, n-grams whose landmarks are counted at once, columns that are multiplied at once, and code points that are cut into n-grams at once.
WIDTH, COUNTED, COLUMNS, CUT = 1 << 17, 1 << 22, 1 << 15, 1 << 20
#: Share of a language's training rows that its least lead and length leave out, and what part of these a text must have.
LOST, SLACK = 0.002, 0.75
UNKNOWN = "und"


@cache
def letters(kinds: str = "LM") -> np.ndarray:
    """Whether each code point is of the kinds: L letters, M marks that belong to one."""
    return np.array([unicodedata.category(chr(c))[0] in kinds for c in range(sys.maxunicode + 1)])


def grams(text: str | None) -> np.ndarray:
    """The distinct n-grams of a text as numbers: up to three code points of 21 bits; empty without letters."""
    points = code_points((text or "").lower())
    if not letters("L")[points].any():
        return np.zeros(0, np.int64)
    is_letter = letters()[points]
    edge = np.full(1, 32, np.uint32)
    points = np.concatenate([edge, np.where(is_letter, points, edge), edge])
    blank = points == 32
    points = points[np.concatenate([[True], ~(blank[1:] & blank[:-1])])]
    found: list[list[np.ndarray]] = [[] for _ in range(SPECTRUM)]
    for i in range(0, len(points), CUT):
        piece = points[i : i + CUT + SPECTRUM - 1].astype(np.int64)  # n-grams over the cut are in the piece before it
        grown = piece
        found[0].append(np.unique(grown))
        for n in range(1, SPECTRUM):
            grown = (grown[:-1] << 21) | piece[n:]
            found[n].append(np.unique(grown))
    return np.concatenate([x[0] if len(x) == 1 else np.unique(np.concatenate(x)) for x in found])  # longer n-grams are larger numbers, so this is sorted


def commonest(marks: list[np.ndarray], width: int) -> np.ndarray:
    """The `width` n-grams that most landmarks have, ties to the smaller number, in order; counted by slices of them."""
    slices = 1 + sum(map(len, marks)) // COUNTED
    kept, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for k in range(slices):
        some, n = np.unique(np.concatenate([g[g % slices == k] for g in marks]), return_counts=True)
        kept, counts = np.concatenate([kept, some]), np.concatenate([counts, n])
        if len(kept) > width:
            best = np.lexsort((kept, -counts))[:width]
            kept, counts = kept[best], counts[best]
    return np.sort(kept)


def places(vocabulary: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Where in the vocabulary those of the n-grams are that it has."""
    at = np.searchsorted(vocabulary, grams)
    at[at == len(vocabulary)] = 0
    return at[vocabulary[at] == grams]


@dataclass
class Kernel:
    """The kernel's n-grams, landmarks' presence rows, their norms, and the matrix from kernel rows to language margins.

    `whiten` leads from kernel rows to Nyström features; `leads` and `lengths` are the least of each language's own texts.
    """

    vocabulary: np.ndarray
    presence: np.ndarray
    norms: np.ndarray
    weights: np.ndarray
    languages: list[str]
    whiten: np.ndarray | None = None
    leads: np.ndarray | None = None
    lengths: np.ndarray | None = None

    def rows(self, texts: list[np.ndarray]) -> np.ndarray:
        """Kernel of each text to each landmark."""
        at = [places(self.vocabulary, g) for g in texts]
        common = np.zeros((len(texts), len(self.presence)), np.float32)  # whole numbers, so exact in any order
        for start in range(0, len(self.vocabulary), COLUMNS):
            marks = self.presence[:, start : start + COLUMNS].astype(np.float32)
            phi = np.zeros((len(texts), marks.shape[1]), np.float32)
            for row, p in zip(phi, at, strict=True):
                row[p[np.searchsorted(p, start) : np.searchsorted(p, start + COLUMNS)] - start] = 1
            common += phi @ marks.T
        sizes = np.array([max(1, len(g)) for g in texts])
        return common / np.sqrt(np.outer(sizes, self.norms))

    def score(self, texts: list, reject: bool = False) -> pd.DataFrame:
        found = [grams(t) for t in texts]
        if not found or not self.languages:
            return pd.DataFrame({"lang": [UNKNOWN] * len(found), "score": np.zeros(len(found))})
        rows = self.rows(found)
        margins = np.round(rows @ self.weights, 6)  # so that ties are ties, whatever the block
        lettered = np.array([len(g) > 0 for g in found])
        best = margins.argmax(1)
        if reject:
            lettered &= (lead(margins) >= self.leads[best]) & (np.linalg.norm(rows @ self.whiten, axis=1) >= self.lengths[best])
        score = np.clip((margins[np.arange(len(found)), best] + 1) / 2, 0, 1)
        return pd.DataFrame({"lang": np.where(lettered, np.array(self.languages, object)[best], UNKNOWN), "score": np.where(lettered, score, 0.0)})


def lead(margins: np.ndarray) -> np.ndarray:
    """How far the best margin is above the second; of a single language, its margin."""
    if margins.shape[1] == 1:
        return margins[:, 0]
    two = np.partition(margins, -2, axis=1)
    return two[:, -1] - two[:, -2]


def fit(sample: pd.DataFrame, text: str, label: str, landmarks: int = LANDMARKS, ridge: float = RIDGE, width: int = WIDTH) -> Kernel:
    """The classifier of a bounded sample; repeated texts count once. Only the landmarks' n-grams are held together."""
    sample = sample.dropna(subset=[label]).drop_duplicates([text, label])
    sample = sample.assign(n=[len(grams(t)) for t in sample[text]])
    sample = sample[sample.n > 0].sort_values([label, text], kind="stable").reset_index(drop=True)
    languages = sorted(sample[label].unique())
    if not languages:
        return Kernel(np.zeros(1, np.int64), np.zeros((1, 1), bool), np.ones(1), np.zeros((1, 0)), [])
    each = max(1, landmarks // len(languages))
    # spread over the text lengths, so that short texts have landmarks of their kind
    chosen = pd.concat([part.sort_values("n", kind="stable")[text].iloc[np.unique(np.linspace(0, len(part) - 1, each).astype(int))] for _, part in sample.groupby(label, sort=True)])
    marks = [grams(t) for t in chosen]
    vocabulary = commonest(marks, width)
    presence = np.zeros((len(marks), len(vocabulary)), bool)
    for row, g in zip(presence, marks, strict=True):
        row[places(vocabulary, g)] = True
    kernel = Kernel(vocabulary, presence, np.array([len(g) for g in marks], float), np.zeros((len(marks), 0)), languages)
    values, vectors = np.linalg.eigh(kernel.rows(marks).astype(float))
    kept = values > 1e-6 * values.max()
    whiten = vectors[:, kept] / np.sqrt(values[kept])
    del marks
    rows = np.concatenate([kernel.rows([grams(t) for t in sample[text].iloc[i : i + 32]]) for i in range(0, len(sample), 32)])
    z = rows @ whiten
    given = sample[label].to_numpy()
    sides = np.stack([np.where(given == x, 1.0, -1.0) for x in languages], 1)
    weight = np.array([1 / (given == x).sum() for x in given])[:, None] * len(given) / len(languages)  # each language weighs the same
    normal = z.T @ (z * weight) + ridge * len(z) * np.eye(z.shape[1])
    solved = np.linalg.solve(normal, z.T @ (sides * weight))
    kernel.weights = whiten @ solved
    kernel.whiten = whiten
    own = np.clip(weight[:, 0] * np.einsum("ij,ji->i", z, np.linalg.solve(normal, z.T)), 0, 1 - 1e-9)[:, None]  # a row's share in its own margins
    leads, lengths, free = lead((z @ solved - own * sides) / (1 - own)), np.linalg.norm(z, axis=1), ~sample.index.isin(chosen.index)
    least = lambda values: SLACK * np.quantile(values, LOST) if len(values) else 0.0
    kernel.leads = np.array([least(leads[given == x]) for x in languages])
    kernel.lengths = np.array([least(lengths[(given == x) & free]) for x in languages])
    return kernel


def train(docs: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", each: int = PER_LANGUAGE) -> Kernel:
    """Fits on about `each` rows of every language of `docs`; `key` only draws the sample."""
    labelled = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(label).alias("label")).filter("label IS NOT NULL AND text IS NOT NULL")
    drawn, _ = sampled(labelled, "label", "key", each)
    return fit(within_bytes(drawn, "text", "key").select("text", "label").toPandas(), "text", "label")


def scorer(docs: DataFrame, kernel: Kernel, reject: bool):
    shared = docs.sparkSession.sparkContext.broadcast(kernel)

    @F.pandas_udf("lang string, score double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        return in_blocks(lambda texts: shared.value.score(texts, reject), batches)

    return scored


def identify(docs: DataFrame, kernel: Kernel, text: str = "text", reject: bool = False) -> DataFrame:
    """`docs` with lang_pred and score; input columns of these names are replaced.

    With `reject`, texts that no language claims get `und` and score 0 too.
    """
    rows = Rows(docs)
    return rows.restored(rows.df.withColumn("scored", scorer(docs, kernel, reject)(rows.col(text))), lang_pred=F.col("scored.lang"), score=F.col("scored.score"))


def keep_known(docs: DataFrame, kernel: Kernel, least: float, text: str = "text") -> DataFrame:
    """`docs` without texts that no language claims or whose score is below `least`; all columns stay as they are."""
    rows = Rows(docs)
    found = rows.df.withColumn("scored", scorer(docs, kernel, True)(rows.col(text)))
    return rows.restored(found.filter((F.col("scored.lang") != UNKNOWN) & (F.col("scored.score") >= least)))


#: Rows of this remainder are held out from the fit; rows without an id are neither learned from nor held out.
HELD_OUT = "pmod(crc32(cast(doc_id AS string)), 4) = 2"


def trained(spark: SparkSession, sf_dir: str) -> Kernel:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return train(docs.filter(f"NOT {HELD_OUT}"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = identify(docs, trained(spark, sf_dir))
    return found.select("doc_id", F.expr(f"coalesce({HELD_OUT}, false)").alias("held_out"), "lang_pred", "score")
