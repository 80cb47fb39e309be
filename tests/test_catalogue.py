"""Every query of the catalogue against its SQL, and the driver's contract."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from graphloom.plans import catalogue

from .conftest import SF

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def same(x, y):
    if isinstance(x, float) and isinstance(y, float):
        return x == y or math.isclose(x, y, rel_tol=1e-12)
    return x == y and type(x) is type(y)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    answer = duck.execute(catalogue.ORACLES[name])
    columns = sorted(df.columns)
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in answer.fetchall()), key=repr)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    assert len(got) == len(want)
    assert all(same(x, y) for a, b in zip(got, want, strict=True) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_without_sql(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_contract(spark):
    assert entry.entry(spark).count() == 6
    assert set(entry.oracle_sql()) <= set(entry.queries())
