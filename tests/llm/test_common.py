"""Shared helpers: what they leave alone, and what they refuse."""

import pytest
from pyspark.sql import functions as F

from graphloom import session
from graphloom.llm import common, queries

from .rows import documents

ARROW = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.mark.parametrize("own", [None, "10000", "77", "0"])
def test_session_settings_stay(spark, sf_dir, own):
    if own:
        spark.conf.set(ARROW, own)
    before = spark.conf.get(ARROW)
    try:
        for name in ("op1_quality", "op9_toxicity"):
            queries.queries()[name](spark, sf_dir).count()
            assert spark.conf.get(ARROW) == before
    finally:
        spark.conf.unset(ARROW)


def test_settings_come_back_after_an_error(spark):
    before = spark.conf.get(ARROW)
    with pytest.raises(Exception):
        common.cut(spark.range(3).select(F.raise_error("no")))
    assert spark.conf.get(ARROW) == before


def test_slices(spark):
    def sizes(batches):
        import pyarrow as pa

        yield pa.RecordBatch.from_arrays([pa.array([b.num_rows for b in batches], pa.int64())], names=["n"])

    rows = common.map_arrow(documents(spark, [(i, "x") for i in range(2500)]).coalesce(1), sizes, "n bigint").collect()
    assert sum(r.n for r in rows) == 2500 and max(r.n for r in rows) <= 1000
    wide = common.map_arrow(documents(spark, [(i, "x" * (1 << 20)) for i in range(64)]).coalesce(1).repartition(1), sizes, "n bigint").collect()
    assert max(r.n for r in wide) <= 20


def test_a_cluster_must_name_a_shared_folder():
    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: None)

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(lambda: type("C", (), {"get": staticmethod(lambda key: None)}))

            class _jsc:
                sc = staticmethod(lambda: type("S", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))}))

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Session)


def test_meet_splits_hot_keys(spark):
    table = spark.createDataFrame([("a",)] * 500 + [(None,)] * 300 + [(f"k{i % 40}",) for i in range(400)], "k string")
    side = common.cut(table.groupBy(F.col("k").alias("own")).agg(F.count(F.lit(1)).alias("rows")))
    for most in (0, 3, 1000):
        got = common.meet(table, side, F.expr("k <=> own"), "rows", most).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.first("rows").alias("rows")).collect()
        assert len(got) == 42 and all(r.n == r.rows for r in got)
