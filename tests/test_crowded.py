"""Joins on a variable that few nodes bind: whole, with a crowded key in many tasks, and written small."""

import duckdb
import pytest
from pyspark.sql import functions as F

from graphloom.plans import catalogue, patterns
from graphloom.plans.patterns import TypedGraph

from .conftest import SF


@pytest.fixture
def any_size(monkeypatch):
    monkeypatch.setattr(patterns, "CROWDED_BYTES", 0)


def _edges(spark, relation, rows, source, target):
    return spark.range(rows).select(F.lit(relation).alias("relation"), F.expr(source).alias("source"), F.expr(target).alias("target"))


@pytest.mark.parametrize("mark", ["", "?"])
def test_same_rows_in_blocks(spark, any_size, monkeypatch, mark):
    monkeypatch.setattr(patterns, "BLOCK_ROWS", 16)
    monkeypatch.setattr(patterns, "LIST_ROWS", 8)
    monkeypatch.setattr(patterns, "TASK_BYTES", 1 << 10)
    # most rows of one key, keys of one side alone, and nulls on either end
    said = [("a", f"p{i}", "m0") for i in range(300)] + [("a", "p1", "m1"), ("a", "p2", "m2"), ("a", "p3", None), ("a", None, "m0"), ("a", None, None), ("a", "p3", None)]
    said += [("b", "m0", f"f{i}") for i in range(40)] + [("b", "m1", None), ("b", "m3", "f1"), ("b", None, "f2"), ("b", "m0", None)]
    graph = TypedGraph(spark.createDataFrame(said, "relation string, source string, target string"))
    pattern = ["p a m", f"m b f{mark}"]
    found, plain = graph.match(*pattern, crowded="m").select("p", "m", "f"), graph.match(*pattern).select("p", "m", "f")
    order = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert order(found) == order(plain) and len(order(plain)) == 301 * 41 + 1 + (3 if mark else 0)
    assert found.groupBy(F.spark_partition_id()).count().count() > 3


@pytest.mark.parametrize("name", ["cq_e01", "cq_e03"])
def test_queries_in_blocks(spark, any_size, name):
    db = duckdb.connect()
    for table in ("lineitem", "part"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    found = catalogue.QUERIES[name](spark, SF)
    assert "_block" in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, found.collect()), key=str) == sorted(db.execute(catalogue.ORACLES[name]).fetchall(), key=str)


def test_written_small(spark, any_size, tmp_path):
    rows = _edges(spark, "a", 9000, "'paper:' || id", "'method:1'").union(_edges(spark, "b", 251, "'method:1'", "'repo:' || id"))
    TypedGraph(rows).match("p a m", "m b r", crowded="m").write.parquet(str(tmp_path / "found"))
    files = list((tmp_path / "found").glob("*.parquet"))
    assert spark.read.parquet(str(tmp_path / "found")).count() == 9000 * 251
    assert sum(f.stat().st_size for f in files) < 0.5 * 9000 * 251
