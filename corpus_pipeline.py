"""The corpus pipeline: language ID, toxicity, near-duplicates, benchmark leaks, mixing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of `docs`. A stage
works on what the one before it kept. ``run`` writes each stage's result as Parquet below the shared checkpoint folder, reads it again, and deletes
it when the next one is written.

Defined results, in every stage: columns of any other names pass; repeated rows are repeated in the result, but for near-dedup, where one stays;
an empty table gives an empty table. Null and empty texts have no language, so the first stage drops them; later stages keep them if they
are given any (near-dedup one of them all).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clickweave.llm import decontaminate, language_id, mixing, simhash, toxicity
from clickweave.llm.common import discard, stored, table
from clickweave.shipping import ship

#: A document goes if no language claims it (see language_id), or if its best margin is below this score.
LEAST_SCORE = 0.3


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that have no letters, are of no learned language, or whose language can't be told."""
    ship(spark)
    return language_id.keep_known(docs, language_id.trained(spark, sf_dir), LEAST_SCORE)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents whose toxicity is 0.5 or more."""
    ship(spark)
    return toxicity.keep_clean(docs, toxicity.trained(spark, sf_dir))


def not_copied(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    ship(spark)
    return simhash.keep_one(docs)


def not_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that contain a benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample by calibrated probabilities."""
    return mixing.mix(docs)


STAGES = [("language ID", known_language), ("toxicity", not_toxic), ("SimHash near-dedup", not_copied), ("benchmark decontamination", not_leaked), ("mixing", mixed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
        if before:
            discard(before)
        before = docs
    return docs
