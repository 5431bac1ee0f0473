"""The registered corpus queries: SQL twins, held-out accuracy, the pipeline's stages."""

from __future__ import annotations

import os

import duckdb
import pytest

import corpus_pipeline
from clickweave.llm import decontaminate, queries

DIR = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_twins(spark, sql, name):
    df = queries.QUERIES[name](spark, DIR)
    found = sql.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    plain = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(plain(r[n]) for n in names) for r in df.collect()) == sorted(tuple(plain(v) for v in r) for r in found.fetchall())


@pytest.mark.parametrize(("name", "table", "label", "column"), [("op3_language_id", "documents", "lang", "lang_pred"), ("op5_quality", "labels", "quality", "predicted"), ("op7_toxicity", "labels", "toxic", "predicted")])
def test_held_out_accuracy(spark, sql, name, table, label, column):
    sql.register("found", queries.QUERIES[name](spark, DIR).toPandas())
    rows = sql.execute(f"SELECT avg(({column} = {label})::INT), count(*) FROM found JOIN {table} USING (doc_id) WHERE held_out AND {label} IS NOT NULL").fetchall()
    sql.unregister("found")
    assert rows[0][0] > 0.95, rows


def test_pages_give_their_articles(spark, sql):
    found = queries.QUERIES["op6_html_extraction"](spark, DIR).toPandas()
    assert len(found) == sql.execute("SELECT count(*) FROM pages").fetchall()[0][0]
    assert (found.text.str.len() == found.n_chars).all()
    assert not found.text.str.contains("©").any()


def test_the_pipeline_keeps_what_each_stage_should(spark, sql):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "toxicity", "SimHash near-dedup", "benchmark decontamination", "mixing"]
    docs = first = spark.read.parquet(f"{DIR}/documents.parquet")
    kept = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = decontaminate.checkpointed(stage(spark, docs, DIR))
        assert docs.columns == first.columns, name
        kept.append(docs.count())
    assert kept == sorted(kept, reverse=True)
    assert kept[1] > 0.95 * kept[0] and kept[-1] > 0.6 * kept[0]
    assert decontaminate.find_leaks(docs, spark.read.parquet(f"{DIR}/benchmark.parquet")).count() == 0
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, DIR)
    assert 0.2 * kept[-1] < mixed.count() < kept[-1]


def test_the_language_stage_rejects_what_was_not_learned(spark):
    unknown = [
        "Правительство приняло решение о новых мерах поддержки населения и бизнеса в регионах страны",
        "政府今天宣布了新的经济政策以支持企业和居民",
        "Η κυβέρνηση ανακοίνωσε σήμερα νέα μέτρα για την οικονομία",
        "Hallitus päätti tänään uusista toimista kansalaisten ja yritysten tukemiseksi koko maassa",
        "Rząd przyjął dziś nowe rozwiązania wspierające mieszkańców i przedsiębiorstwa w kraju",
        "qxzkjv wypbgq zzxkjq vwqypb gkxzjq bvwkqx pyzxgj kqvwzx",
    ]
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    strange = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(unknown)], "doc_id long, text string")
    kept = corpus_pipeline.known_language(spark, docs.unionByName(strange, allowMissingColumns=True), DIR).select("doc_id").toPandas().doc_id
    assert not (kept < 0).any()
    clean = docs.filter("text RLIKE '[a-z]{2}'").select("doc_id").toPandas().doc_id
    assert clean.isin(kept).mean() > 0.98
