import zlib

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import queries, toxicity

from .rows import LONG, TEXTS, documents, empty


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int, text string")


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in queries.queries()["op9_toxicity"](spark, sf).collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == held(d) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for d, r in rows.items())
    known = [(rows[r.doc_id], r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if held(r.doc_id)]
    caught = sum(r.predicted for r, t in known if t)
    wrong = sum(r.predicted for r, t in known if not t)
    assert caught >= 0.7 * sum(t for _, t in known) and wrong <= 0.05 * len(known)


def test_labels_of_held_out_rows_change_nothing(spark):
    docs = documents(spark, [(i, f"{'vile' if i % 4 == 0 else 'kind'} words here {i}") for i in range(200)])
    given = [(i, 1, int(i % 4 == 0), "x") for i in range(200)]
    turned = [(i, 1, 1 - t if held(i) else t, "x") for i, _, t, _ in given]
    a = toxicity.score(docs, labels(spark, given)).orderBy("doc_id").collect()
    assert a == toxicity.score(docs, labels(spark, turned)).orderBy("doc_id").collect()
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in a]) > 0.97


def test_awkward_rows(spark):
    docs = documents(spark, [*TEXTS, (None, "vile")])
    known = labels(spark, [(i, None, i % 2, None) for i in range(60)] + [(None, 1, 1, "x"), (2, 1, None, "x"), (2, 1, 1, "x")])
    rows = toxicity.score(docs, known).collect()
    assert len(rows) == len(TEXTS) + 1 and all(0 <= r.score <= 1 for r in rows)
    empties = {r.score for r in rows if r.doc_id in (3, 4, 5)}
    assert len(empties) == 1
    assert toxicity.score(empty(spark), known).collect() == []
    none = toxicity.score(docs, labels(spark, [])).collect()
    assert {r.score for r in none} == {0.0}
    kept = toxicity.accepted(docs, known)
    assert kept.columns == docs.columns
    assert toxicity.accepted(docs, labels(spark, [])).count() == docs.count()


def test_score_ignores_what_stands_beside():
    """A text's score does not depend on the other texts of its batch, and long texts are read whole."""
    texts = [f"{'vile ' if i % 3 == 0 else ''}some plain words {i}" for i in range(90)]
    model = toxicity.train(pa.array(texts), np.array([int(i % 3 == 0) for i in range(90)]))
    several = [*texts[:5], None, "", LONG * 3 + " vile", LONG * 3, "x"]
    together = model.scores(pa.array(several))
    alone = np.concatenate([model.scores(pa.array([t], pa.string())) for t in several])
    assert np.allclose(together, alone, atol=1e-5)
    assert together[7] >= 0.7 > together[8]


def test_best_cut():
    p = np.array([0.9, 0.8, 0.3, 0.2])
    assert abs(toxicity._best_cut(p, np.array([1, 1, 0, 0])) - 0.55) < 1e-9


def test_long_texts_do_not_end_the_sample(spark):
    """Texts over the bound are skipped wherever they stand; a class of which none fits is an error."""
    rows = [(k, k, k % 2, 100_000 if k < 4 else 50) for k in range(40)]
    assert sorted(toxicity._chosen(rows, 10_000)) == list(range(4, 40))
    rows += [(k, k, 0, 4000) for k in range(100, 110)]
    assert {k for k in toxicity._chosen(rows, 10_000) if k < 40 and k % 2} == set(range(5, 40, 2))
    texts = [(i, f"{'vile' if i % 4 == 0 else 'kind'} words here {i} " + "long " * (5000 if i % 5 == 0 else 0)) for i in range(200)]
    docs, known = documents(spark, texts), labels(spark, [(i, 1, int(i % 4 == 0), "x") for i in range(200)])
    rows = toxicity.score(docs, known, max_bytes=20_000).collect()
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in rows if r.doc_id % 5]) > 0.9
    with pytest.raises(ValueError, match="label 1"):
        toxicity.fit(docs.filter("doc_id % 4 > 0 or doc_id % 5 = 0"), known, max_bytes=20_000)


def test_thresholds_follow_all_labels(spark):
    """A balanced sample of rare toxic rows does not lower the cut: a word of all toxic and many clean rows is no proof."""
    vile = lambda i: i % 20 == 0 or i % 4 == 1
    texts = [(i, f"{'vile' if vile(i) else 'kind'} words{' awful' if i % 20 == 0 and i % 3 else ''} stand here") for i in range(3000)]
    known = labels(spark, [(i, 1, int(i % 20 == 0), "x") for i in range(3000)])
    rows = toxicity.score(documents(spark, texts), known, max_rows=60).collect()
    assert np.mean([r.predicted for r in rows if r.doc_id % 20]) < 0.02
    assert np.mean([r.predicted for r in rows if r.doc_id % 20 == 0]) > 0.5


def test_runs_of_a_long_text_add_no_windows():
    """The border between two runs of words cuts windows that do not exist in the text: they do not count."""
    rng = np.random.default_rng(1)
    words = [f"w{k}" for k in rng.integers(0, 5000, 70_000)]
    model = toxicity.train(pa.array([f"{'vile ' if i % 3 == 0 else ''}plain w{i}" for i in range(90)]), np.array([int(i % 3 == 0) for i in range(90)]))
    model.filters = [rng.normal(0, 1, w.shape).astype(np.float32) for w in model.filters]
    ((_, _, f),) = toxicity.features(pa.array([" ".join(words)]))
    whole = model.responses(model.vectors(f, 0, len(words)), np.array([0, len(words)])).max(axis=0)
    assert np.allclose(model.pooled(f)[0], np.maximum(0, whole + model.bias), atol=1e-4)


def test_unlike_texts_of_one_id(spark):
    """Which of several texts is learned from does not depend on their order."""
    texts = [(i, f"{'vile' if i % 4 == 0 else 'kind'} words {i}") for i in range(120)] + [(i, f"other text {i}") for i in range(0, 120, 3)]
    known = labels(spark, [(i, 1, int(i % 4 == 0), "x") for i in range(120)])
    order = lambda df: df.orderBy("doc_id", "score").collect()
    assert order(toxicity.score(documents(spark, texts), known)) == order(toxicity.score(documents(spark, texts[::-1]).repartition(3), known))
