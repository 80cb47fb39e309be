"""Readers, writers, resumable runs, services and papers."""

import io
import json
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from graphloom.operators import graph, metrics
from graphloom.plans import papers
from graphloom.sources import files, graphs, rdf, service, sinks
from graphloom.sources.files import id_list, json_or_default, odd_ids, zip_members
from graphloom.streaming import resume


def test_tolerant_text(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes("﻿é\r\nx\ry".encode())
    (tmp_path / "sub" / "b.txt").write_bytes(b"caf\xe9")
    rows = {r.path: r.text for r in files.texts(spark, str(tmp_path), "*.txt").collect()}
    assert rows == {"a.txt": "é\nx\ny", "sub/b.txt": "café"}


def test_json_records(spark, tmp_path):
    for name, value in (("list.json", [{"a": 1}, {"a": 2}]), ("named.json", {"x": {"a": 3}, "y": {"a": 4}})):
        (tmp_path / name).write_text(" \n" + json.dumps(value))
        assert sorted(r.a for r in files.json_records(spark, str(tmp_path / name), "a int").collect()) == ([1, 2] if name == "list.json" else [3, 4])


def test_id_list(spark, tmp_path):
    (tmp_path / "ids.csv").write_text("﻿" + "A" * 32 + "\nshort\n" + "b" * 32 + ",x\n" + "a" * 32 + "\n")
    assert [r.id for r in files.id_list(spark, str(tmp_path / "ids.csv")).orderBy("ord").collect()] == ["a" * 32, "b" * 32]


def test_zip_members(spark):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("top/", "")
        z.writestr("top/a/b.txt", "hello")
        z.writestr("top/c.md", "")
    rows = files.zip_members(spark.createDataFrame([(7, bytearray(data.getvalue()))], "id int, content binary"), "id").collect()
    assert sorted((r.id, r.path, r.name, r.size_bytes, bytes(r.content)) for r in rows) == [(7, "a/b.txt", "b.txt", 5, b"hello"), (7, "c.md", "c.md", 0, b"")]


def test_json_writer_is_stable(spark, tmp_path):
    rows = [(f"n{i}", "é", None, {"k": str(i)}) for i in range(30)]
    schema = "id string, b string, a string, m map<string,string>"
    one, two = str(tmp_path / "1.json"), str(tmp_path / "2.json")
    assert sinks.write_json_records(spark.createDataFrame(rows, schema).repartition(5), one, ["id"]) == 30
    sinks.write_json_records(spark.createDataFrame(rows[::-1], schema).coalesce(1), two, ["id"])
    text = open(one, encoding="utf-8").read()
    assert text == open(two, encoding="utf-8").read() and text.endswith("]\n")
    assert json.loads(text)[0] == {"a": None, "b": "é", "id": "n0", "m": {"k": "0"}}
    assert text == json.dumps(json.loads(text), ensure_ascii=False, indent=2, sort_keys=True) + "\n"
    assert sinks.write_json_records(spark.createDataFrame([], schema), one, ["id"]) == 0 and json.load(open(one)) == []


def test_graph_writer(spark, tmp_path):
    nodes = spark.createDataFrame([("b", "X"), ("a", "Y")], "id string, class string")
    edges = spark.createDataFrame([("e", "a", "b")], "id string, source string, target string")
    sinks.write_graph(nodes, edges, str(tmp_path / "g.json"))
    assert json.load(open(tmp_path / "g.json")) == {"edges": [{"id": "e", "source": "a", "target": "b"}], "nodes": [{"class": "Y", "id": "a"}, {"class": "X", "id": "b"}]}


def test_snapshots(tmp_path):
    for label, order in (("later", 2), ("first", 1), ("loose", None)):
        sinks.write_snapshot({"label": label, "trajectoryOrder": order, "counts": {"nodes": 1, "edges": 2}, "metrics": {"informationDensity": {"combinedAveragePerNode": 1.5}, "relationalRichness": {"averageDistinctRelationTypesPerNode": 0.25}, "consolidation": {"global": {"ratio": 1.0}}}}, str(tmp_path))
    assert [r["label"] for r in sinks.read_snapshots(str(tmp_path))] == ["first", "later", "loose"]
    assert sinks.trajectory_table(str(tmp_path)).splitlines()[2] == "| first | 1 | 2 | 1.500000 | 0.250000 | 1.000000 |"
    with pytest.raises(ValueError):
        sinks.valid_label("../x")


def test_paged_service(spark, tmp_path):
    for page, items in ((1, [{"id": 1, "name": "One"}, {"id": 2, "name": "skip"}]), (2, [{"id": 3, "name": "Three", "license": {"key": "mit"}}])):
        (tmp_path / "repos").mkdir(exist_ok=True)
        (tmp_path / "repos" / f"{page}.json").write_text(json.dumps(items))
    items = service.paged(spark, ["repos", "none"], folder=str(tmp_path))
    assert [r.id for r in service.repositories(items, ("Skip",)).orderBy("id").collect()] == [1, 3]
    people = service.contributors_summary(items, 2).first()
    assert people.contributors_count == 3 and [c.id for c in people.top_contributors] == [1, 2]


def test_resumable_run(spark, tmp_path):
    target = str(tmp_path / "done")
    given = spark.createDataFrame([(i,) for i in range(10)], "id int")
    step = lambda df: df.withColumn("x", F.col("id") * 2)
    assert resume.run_pending(spark, given.filter("id < 4"), "id", step, target) == 4
    assert resume.run_pending(spark, given, "id", step, target) == 6
    assert resume.run_pending(spark, given, "id", step, target) == 0
    assert sorted(r.x for r in spark.read.parquet(target).collect()) == list(range(0, 20, 2))


def test_stream_reads_new_files_once(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    for low in (0, 5):
        spark.range(low, low + 5).write.mode("append").parquet(source)
        resume.stream_files(spark, source, "id bigint", lambda df: df.withColumn("y", F.col("id") + 1), target, checkpoint)
    assert sorted(r.y for r in spark.read.parquet(target).collect()) == list(range(1, 11))


LONG = "A text that is long enough to be kept as a chunk of its paper, since it has more than one hundred and twenty characters in all."


def test_papers(spark, tmp_path):
    for i in (1, 2):
        (tmp_path / str(i) / "markdown").mkdir(parents=True)
        (tmp_path / str(i) / "markdown" / f"{i}_md.md").write_text(f"# Paper {i}")
    read = papers.read_papers(spark, str(tmp_path))
    asked = papers.prompts(read, "Extract.")
    answer = {"title": " T ", "chunks": [{"chunk_type": "Method", "text": LONG, "supporting_quote": ["q", 5, " "]}, {"chunk_type": "Method", "text": LONG, "supporting_quote": None}, {"chunk_type": "Odd", "text": LONG, "supporting_quote": "q"}, {"chunk_type": "Result", "text": "short", "supporting_quote": "q"}, "no object"]}
    said = "```json\n" + json.dumps(answer) + "\n```"

    def model(prompt, effort, temperature):
        if effort:
            raise ValueError("not supported")
        if "Paper 2" in prompt:
            raise RuntimeError("down")
        return said

    rows = papers.answered(asked, model)
    got = {r.paper_id: r for r in rows.collect()}
    assert got["1"].error is None and got["2"].error.endswith("[attempt3] RuntimeError: down")
    found = papers.chunks(rows).collect()
    assert [(r.chunk_id, r.supporting_quote) for r in found] == [("1__Method__1", ["q"])]
    assert {r.paper_id: r.title for r in papers.metadata(rows).collect()} == {"1": "T", "2": ""}
    kept = papers.replayed(asked, spark.createDataFrame([("1", said)], "paper_id string, answer string")).collect()
    assert {r.paper_id: r.error for r in kept} == {"1": None, "2": "no recorded answer"}


def test_graph_checks(spark):
    schema = "id string, class string"
    edges = spark.createDataFrame([("e1", "r", "a", "x"), ("e1", "", "a", "a")], "id string, relation string, source string, target string")
    found = {(r.issue, r.id) for r in graph.violations(spark.createDataFrame([("a", "K"), ("a", "K"), ("", "K"), ("c", None)], schema), edges).collect()}
    assert found == {("node without id", ""), ("repeated node id", "a"), ("repeated edge id", "e1"), ("node without class", "c"), ("edge without relation", "e1"), ("loose end", "e1")}
    with pytest.raises(ValueError):
        graph.check(spark.createDataFrame([("a", "K"), ("a", "K")], schema), edges)


def test_graph_round_trip_and_metrics(spark, tmp_path):
    """A graph document read, measured, written and read again."""
    given = {
        "nodes": [{"id": "b", "class": "X", "inventoryId": "1", "attributes": {"name": "n", "size": 1, "tags": ["t"], "url": "u", "blank": " "}, "evidence": None, "curationStatus": "curated"}, {"id": "a", "class": "Y", "inventoryId": "2", "attributes": {}, "evidence": None, "curationStatus": "referenced"}],
        "edges": [{"id": "e", "relation": "r", "inventoryId": "3", "source": "a", "target": "b", "evidence": {"evidenceText": "t", "sourceLocation": "s", "extractionMethod": "m", "sourceArtifact": "x"}}],
    }
    (tmp_path / "g.json").write_text(json.dumps(given))
    nodes, edges = graphs.read_graph(spark, str(tmp_path / "g.json"))
    graph.check(nodes, edges)
    record = metrics.snapshot_record(nodes, edges, "one", order=1)
    assert record["metrics"]["informationDensity"]["totalInformativeAttributes"] == 3 and record["metrics"]["informationDensity"]["combinedAveragePerNode"] == 2.5
    assert record["metrics"]["consolidation"]["perEntityType"]["X"]["ratio"] == 1.0 and record["counts"] == {"nodes": 2, "edges": 1}
    sinks.write_snapshot(record, str(tmp_path / "snapshots"))
    assert "| one | 2 | 1 | 2.500000 | 1.000000 | 1.000000 |" in sinks.trajectory_table(str(tmp_path / "snapshots"))
    sinks.write_graph(*graphs.document(nodes, edges), str(tmp_path / "again.json"))
    again = json.load(open(tmp_path / "again.json"))
    assert again["edges"] == given["edges"] and again["nodes"] == sorted(given["nodes"], key=lambda n: n["id"])
    (tmp_path / "bad.json").write_text('{"nodes": {}, "edges": []}')
    with pytest.raises(ValueError, match="nodes must be a list"):
        graphs.read_graph(spark, str(tmp_path / "bad.json"))


def test_commits_archives_and_parts(spark, tmp_path):
    """Connectors over files: an empty repository has no commit, a part that fails does not stop the others."""
    for name, sha in (("o/one", "abc"), ("o/two", "def")):
        place = tmp_path / "api" / service.commit_path(name, "main")
        place.mkdir(parents=True)
        (place / "1.json").write_text(json.dumps({"sha": sha, "commit": {}}))
    heads = spark.createDataFrame([("o/one", "main"), ("o/two", "main"), ("o/none", "main")], "full_name string, branch string")
    commits = service.head_commits(spark, heads, folder=str(tmp_path / "api"))
    assert {r.full_name: r.sha for r in commits.collect()} == {"o/one": "abc", "o/two": "def", "o/none": None}
    assert service.head_commits(spark, heads.limit(0), folder=str(tmp_path / "api")).collect() == []
    with zipfile.ZipFile(tmp_path / "abc.zip", "w") as z:
        z.writestr("top/a.txt", "hello")
    (tmp_path / "zips" / "o").mkdir(parents=True)
    (tmp_path / "zips" / "o" / "one@abc").write_bytes((tmp_path / "abc.zip").read_bytes())
    get = service.bytes_from_files(str(tmp_path / "zips"))
    got = service.archives(commits.select("full_name", "sha"), lambda name, sha: get(f"{name}@{sha}"))
    rows = {r.full_name: r for r in got.collect()}
    assert {n: r.status for n, r in rows.items()} == {"o/one": "success", "o/two": "failed", "o/none": "skipped"} and "FileNotFoundError" in rows["o/two"].error
    members = zip_members(got.filter("status = 'success'"), "full_name").collect()
    assert [(m.path, bytes(m.content)) for m in members] == [("a.txt", b"hello")]
    counts, others = service.download_report(got, "full_name")
    assert {r.status: r.n for r in counts.collect()} == {"success": 1, "failed": 1, "skipped": 1} and {r.full_name for r in others.collect()} == {"o/two", "o/none"}


def test_dataset_parts(spark, tmp_path):
    for name, text in (("meta_dump.json", "{}"), ("file_inventory.json", json.dumps([{"file_name": "ReadMe.md", "extension": ".md"}, {"file_name": "readme.pdf", "extension": ".pdf"}, {"file_name": "README.txt", "extension": ".TXT"}])), ("ReadMe.md", "# Hi")):
        (tmp_path / "a").mkdir(exist_ok=True)
        (tmp_path / "a" / name).write_text(text)
    ids = spark.createDataFrame([("a",), ("b",)], "resource_id string")
    rows = {(r.resource_id, r.name): (r.text, bool(r.error)) for r in service.dataset_parts(ids, service.bytes_from_files(str(tmp_path))).collect()}
    assert rows["a", "meta_dump.json"] == ("{}", False) and rows["a", "raw_metadata.xml"] == (None, True)
    assert rows["a", "ReadMe.md"] == ("# Hi", False) and rows["a", "README.txt"] == (None, True) and ("a", "readme.pdf") not in rows
    assert rows["b", "file_inventory.json"] == ("[]", True) and len(rows) == 10


def test_paced():
    times = []
    call = service.paced(lambda: times.append(time.monotonic()), 0.05)
    for _ in range(3):
        call()
    assert times[2] - times[0] >= 0.1 and service.paced(len, 0) is len


def test_odd_ids_and_defaults(spark, tmp_path):
    (tmp_path / "ids.csv").write_text("﻿" + "A" * 32 + "\nshort\n\n" + "b" * 32 + ",x\n" + "a" * 32 + "\n" + "c" * 33)
    assert [r.id for r in id_list(spark, str(tmp_path / "ids.csv")).orderBy("ord").collect()] == ["a" * 32, "b" * 32]
    assert [r.warning for r in odd_ids(spark, str(tmp_path / "ids.csv")).orderBy("ord").collect()] == ["anomalous id skipped: short", "anomalous id skipped: " + "c" * 33]
    rows = spark.createDataFrame([(1, '{"a": 2}'), (2, None), (3, "{")], "k int, j string")
    got = {r.k: (r.value.a, r.issue) for r in json_or_default(rows, "j", "struct<a:int>", F.struct(F.lit(7).alias("a"))).collect()}
    assert got == {1: (2, None), 2: (7, None), 3: (7, "invalid_json")}


def test_call_fallbacks():
    """All parameters first, then without temperature, then without either; what failed is told of every call."""
    asked = []

    def model(prompt, effort, temperature):
        asked.append((effort, temperature))
        if effort or prompt == "bad":
            raise ValueError(f"no {len(asked)}")
        return "fine"

    assert papers.called(model, "good") == ("fine", None) and asked == [(True, True), (True, False), (False, False)]
    said, error = papers.called(model, "bad")
    assert said is None and error == "[attempt1] ValueError: no 4\n[attempt2] ValueError: no 5\n[attempt3] ValueError: no 6"


def test_first_papers(spark):
    rows = spark.createDataFrame([(i,) for i in ("10", "9", "b", "a", "100")], "paper_id string")
    assert [r[0] for r in papers.first_papers(rows, 4).collect()] == ["9", "10", "100", "a"] and papers.first_papers(rows, 0).count() == 5


def test_many_relations_of_one_resource(spark):
    """The first of each relation, in order, without seeking each among all others."""
    part = lambda k: f'<dc:relation><rdf:Description><dcterms:hasPart rdf:resource="http://x.org/{k}"/></rdf:Description></dc:relation>'
    order = [k * 7919 % 4001 for k in range(4000)]
    body = "".join(part(k) for k in [*order, *reversed(order)])
    document = f'<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:dcterms="http://purl.org/dc/terms/" xmlns:h="https://terms.example.org/"><h:CollectionResource>{body}</h:CollectionResource></rdf:RDF>'
    began = time.monotonic()
    (row,) = rdf.with_semantics(spark.createDataFrame([(1, document)], "k int, xml string"), "k", "xml").select("semantics.typed_relations").collect()
    assert [r.target for r in row.typed_relations] == [f"http://x.org/{k}" for k in order]
    assert time.monotonic() - began < 30  # seconds where every relation is met once, minutes where each meets all
