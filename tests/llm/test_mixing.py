import random
import re

import duckdb

from graphloom.llm import mixing, queries

from .rows import TEXTS, documents, empty


def brute_targets(sizes, share=1.5, epochs=2.0):
    """Iterative capping: freeze what is above its cap, share the excess by weight, again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(names)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        if not free:
            return fixed
        left, w = total - sum(fixed.values()), sum(weight[s] for s in free)
        above = [s for s in free if left * weight[s] / w > epochs * sizes[s]]
        if not above:
            return fixed | {s: left * weight[s] / w for s in free}
        fixed |= {s: epochs * sizes[s] for s in above}


def check(rows, texts_sources):
    sizes = {}
    for text, source in texts_sources:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    goal = brute_targets(sizes)
    assert sorted({(r.source_size, round(r.target, 4)) for r in rows}) == sorted({(sizes[s], round(goal[s], 4)) for s in sizes})
    assert sum(r.size for r in rows) == sum(sizes.values())
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    assert abs(sum(r.taken for r in rows) - sum(round(g) for g in goal.values())) <= len(goal)
    return goal


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    rows = queries.queries()["op10_mixing"](spark, sf_dir).collect()
    goal = check(rows, [(d.text, d.source) for d in docs])
    of = {d.doc_id: d.source for d in docs}
    for source, target in goal.items():
        assert abs(sum(r.taken for r in rows if of[r.doc_id] == source) - target) <= 1
    assert sorted(map(tuple, rows)) == sorted(map(tuple, queries.queries()["op10_mixing"](spark, sf_dir).collect()))


def test_sql_agrees(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    want = sorted(con.execute(queries.oracle_sql()["op10_mixing"]).fetchall())
    assert sorted(map(tuple, queries.queries()["op10_mixing"](spark, sf_dir).collect())) == want


def test_buckets_change_nothing(spark, monkeypatch):
    rng = random.Random(3)
    texts = [(i, "w " * rng.randrange(0, 40)) for i in range(600)]
    docs = documents(spark, texts, lambda i: f"s{min(i % 9, 3)}")
    one = sorted(map(tuple, mixing.takes(docs).collect()))
    whole = sorted(r.text for r in mixing.mixed_documents(docs).collect())
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 8)
    monkeypatch.setattr(mixing, "BUCKETS", 4)
    assert sorted(map(tuple, mixing.takes(docs).collect())) == one
    monkeypatch.setattr(mixing, "MOST_BROADCAST", 2)
    assert sorted(map(tuple, mixing.takes(docs).collect())) == one
    assert sorted(r.text for r in mixing.mixed_documents(docs).collect()) == whole


def test_many_sources(spark):
    """Ranks and the level come out alike however the sources are dealt to tasks; capped ones in several rounds."""
    rng = random.Random(8)
    sizes = {f"s{rng.randrange(10**6)}é"[: rng.randrange(3, 9)]: int(10 ** rng.uniform(0, 5)) for _ in range(400)} | {None: 77, "": 5}
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r.source: r.target for r in mixing.targets(rows.repartition(5), share=1.9).collect()}
    want = brute_targets(sizes, share=1.9)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) <= 1e-9 * want[s] for s in want)


def test_texts_are_not_shuffled(spark, tmp_path):
    """Only rows of the borders' buckets move."""
    documents(spark, [(i, f"{i} " * 30) for i in range(5000)]).write.parquet(str(tmp_path / "d"))
    out = mixing.mixed_documents(spark.read.parquet(str(tmp_path / "d")))
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1


def test_awkward_rows(spark):
    docs = documents(spark)
    rows = mixing.takes(docs).collect()
    assert len(rows) == len(TEXTS)
    check(rows, [(r.text, r.source) for r in docs.collect()])
    assert mixing.takes(empty(spark)).collect() == []
    nothing = mixing.takes(documents(spark, [(1, None), (2, "")])).collect()
    assert [(r.size, r.target, r.taken) for r in nothing] == [(0, 0.0, 0)] * 2


def test_mixed_documents(spark):
    docs = documents(spark)
    taken = sum(r.taken for r in mixing.takes(docs).collect())
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    rows = mixed.collect()
    assert sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in rows) == taken
    texts = {t for _, t in TEXTS if t}
    assert all(any(t.startswith(r.text) for t in texts) for r in rows)
    assert mixing.mixed_documents(empty(spark)).collect() == []
