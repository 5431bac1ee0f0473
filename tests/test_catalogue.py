"""Every query with a SQL twin gives its rows."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from clickweave.plans import catalogue

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return str(v)


def same(df, con, text):
    found = con.execute(text)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(plain(v) for v in r) for r in found.fetchall())
    assert sorted(tuple(plain(r[n]) for n in names) for r in df.collect()) == want


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query(spark, sql, name):
    same(catalogue.QUERIES[name](spark, DIR), sql, catalogue.ORACLE_SQL[name])


def test_every_plan_has_a_twin():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE_SQL)
    assert set(entry.oracle_sql()) <= set(entry.queries())
