"""The command line from raw folders to a metric table."""

import json

import pytest

from graphloom.__main__ import main

A, B = "a" * 32, "b" * 32


def test_datasets_to_metrics(spark, tmp_path, capsys):
    for key, title in ((A, "First"), (B, "Second")):
        (tmp_path / "raw" / key).mkdir(parents=True)
        meta = {"title": title, "subjects": ["x"], "creators": [{"name": "Ada", "organization": "Lab"}], "relations": []}
        (tmp_path / "raw" / key / "meta_dump.json").write_text(json.dumps(meta))
    records, graph = str(tmp_path / "records.json"), str(tmp_path / "graph.json")
    assert main(["datasets", str(tmp_path / "raw"), records]) == 0
    assert [r["title"] for r in json.load(open(records))] == ["First", "Second"]
    assert main(["extract", records, graph]) == 0
    built = json.load(open(graph))
    assert {n["class"] for n in built["nodes"]} == {"DatasetResource", "ResourceType", "Person", "Organization", "Identifier", "Subject"}
    first = open(graph).read()
    assert main(["extract", records, graph]) == 0 and open(graph).read() == first
    table = tmp_path / "t.md"
    assert main(["metrics", graph, "one", "--order", "1", "--snapshots", str(tmp_path / "s"), "--table", str(table)]) == 0
    assert f"| one | {len(built['nodes'])} | {len(built['edges'])} |" in table.read_text()
    with pytest.raises(ValueError):
        main(["metrics", graph, "../no"])


def test_repositories(spark, tmp_path, capsys):
    (tmp_path / "raw" / "one" / "contents").mkdir(parents=True)
    (tmp_path / "raw" / "one" / "contents" / "requirements.txt").write_text("numpy\n")
    (tmp_path / "raw" / "one" / "files_manifest.json").write_text(json.dumps([{"path": "requirements.txt", "file_name": "requirements.txt", "extension": ".txt", "size_bytes": 6, "downloaded": True, "selection_reason": "x"}]))
    out = str(tmp_path / "repos.json")
    assert main(["repositories", str(tmp_path / "raw"), out]) == 0
    assert [d["name"] for d in json.load(open(out))["repos"][0]["dependencies"]] == ["numpy"]


def test_ontology(tmp_path, capsys):
    yaml = pytest.importorskip("yaml")
    from .test_ontology import SPEC

    spec = SPEC | {"prefixes": [*SPEC["prefixes"], {"prefix": "owl", "iri": "http://www.w3.org/2002/07/owl#"}]}
    (tmp_path / "s.yaml").write_text(yaml.safe_dump(spec))
    assert main(["ontology", str(tmp_path / "s.yaml"), str(tmp_path / "o.owl")]) == 0
    assert (tmp_path / "o.owl").read_text().startswith("<?xml")
