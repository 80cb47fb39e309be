"""The queries and their SQL, side by side."""

import duckdb
import pytest

from graphloom.llm import queries

TABLES = ("documents", "labels", "pages")


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), sorted((tuple(r[k] for k in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_sql_agrees(spark, name, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    want = con.execute(queries.oracle_sql()[name])
    df = queries.queries()[name](spark, sf_dir)
    assert rows(df.columns, map(tuple, df.collect())) == rows([c[0] for c in want.description], want.fetchall())
