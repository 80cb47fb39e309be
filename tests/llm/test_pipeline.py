import corpus_pipeline
from graphloom.llm import mixing, packing, secrets, simhash, toxicity
from graphloom.llm.common import table

from .rows import documents, empty
from .test_packing import check
from .test_secrets import base
from .test_simhash import brute_components, brute_print


def test_each_stage(spark, sf_dir, tmp_path):
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    given = {r.doc_id: r for r in docs.collect()}

    def written(step, name):
        step.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert out.columns == columns
        return out

    stage = dict(corpus_pipeline.STAGES)
    one = written(stage["toxicity"](spark, docs, sf_dir), "toxicity")
    scores = {r.doc_id: r.predicted for r in toxicity.score(docs, table(spark, sf_dir, "labels")).collect()}
    assert {r.doc_id for r in one.collect()} == {d for d, p in scores.items() if not p}
    two = written(stage["simhash"](spark, one, sf_dir), "simhash")
    want = {c for *_, c in brute_components([(r.doc_id, brute_print(r.text)) for r in one.collect()])}
    assert sorted(r.doc_id for r in two.collect()) == sorted(want)
    three = written(stage["secrets"](spark, two, sf_dir), "secrets")
    assert sorted(r.doc_id for r in three.collect()) == sorted(want)
    for r in three.collect():
        if not base(given[r.doc_id].text):
            assert r.text == given[r.doc_id].text
        assert r.n_chars == len(r.text)
    four = written(stage["mixing"](spark, three, sf_dir), "mixing")
    assert sum(len(r.text.split()) for r in four.collect()) == sum(r.taken for r in mixing.takes(three).collect())
    five = written(stage["packing"](spark, four, sf_dir), "packing")
    check(five.collect(), [(r.doc_id, r.text) for r in four.collect()])


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_clashing_columns_and_repeated_rows(spark, tmp_path):
    docs = documents(spark)
    spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert out.count() > 0
    assert packing.pack(docs).count() > 0 and simhash.deduplicated(docs).count() and secrets.redacted(docs).count() == docs.count()


def test_empty_tables(spark, tmp_path):
    docs = empty(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns), name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_null_columns(spark, tmp_path):
    """Rows that hold nothing but nulls, beside ordinary ones."""
    rows = [(None, None, None, None, None, None, None, None)] * 3 + [(5, "some text here", "en", "src", 14, None, None, None)]
    docs = spark.createDataFrame(rows, docs_schema())
    spark.createDataFrame([(None, None, None), (5, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    sizes = {}
    for name, stage in corpus_pipeline.STAGES:
        sizes[name] = stage(spark, docs, str(tmp_path)).count()
    assert sizes["toxicity"] == 4 and sizes["simhash"] == 2 and sizes["secrets"] == 4 and sizes["mixing"] >= 1 and sizes["packing"] >= 4


def docs_schema():
    from .rows import SCHEMA

    return SCHEMA
