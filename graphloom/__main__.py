"""Command line: python -m graphloom <command> ...

datasets      raw dataset folders -> consolidated records (JSON)
extract       consolidated records (JSON) -> graph (JSON)
repositories  raw repository folders -> consolidated records (JSON), exit code 1 if they contradict themselves
metrics       graph (JSON) -> metric snapshot of a label, and the table of all snapshots
ontology      specification (YAML) -> RDF/XML
"""

from __future__ import annotations

import argparse
import hashlib
import sys
from pathlib import Path

from pyspark.sql import functions as F

from .session import session


def _digest(path: str) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        for block in iter(lambda: f.read(1 << 20), b""):
            digest.update(block)
    return digest.hexdigest()


def datasets(a) -> int:
    from .plans import datasets as plan
    from .sources.files import texts
    from .sources.sinks import write_json_records

    raw = texts(session(), a.input).select(F.substring_index("path", "/", 1).alias("resource_id"), "name", "text")
    records = plan.build(raw, a.terms, a.address)
    print(write_json_records(plan.for_extraction(records), a.output, ["resource_id"]), "records")
    plan.failures(records).show()
    return 0


def extract(a) -> int:
    from .plans.extraction import RECORD, extract
    from .sources.files import json_records
    from .sources.graphs import document
    from .sources.sinks import write_graph

    found = extract(json_records(session(), a.input, RECORD), a.artifact, a.service)
    write_graph(*document(found.nodes, found.edges), a.output)
    for df, column in ((found.nodes, "class"), (found.edges, "relation")):
        df.groupBy(column).count().orderBy(column).show(200, False)
    found.skipped.orderBy("reason").show(200, False)
    return 0


def repositories(a) -> int:
    from .plans import repositories as plan
    from .sources.sinks import write_json_records

    corpus = plan.build(plan.raw_files(session(), a.input)).withColumn("_place", F.struct(F.lower("name"), F.coalesce("repo_id", F.lit(0))))
    write_json_records(corpus.drop("_place"), a.output, ["name"], "repos", sort_keys=False)
    plan.report(corpus).show(vertical=True, truncate=False)
    issues = plan.issues(corpus).collect()
    for i in issues:
        print(f"{i['name']}: {i['issue']}")
    return 1 if issues else 0


def metrics(a) -> int:
    from .operators.graph import check
    from .operators.metrics import snapshot_record
    from .sources.graphs import read_graph
    from .sources.sinks import trajectory_table, valid_label, write_snapshot

    valid_label(a.label)
    nodes, edges = read_graph(session(), a.input)
    check(nodes, edges)
    write_snapshot(snapshot_record(nodes, edges, a.label, a.name, a.order, a.input, _digest(a.input), service=a.service), a.snapshots)
    Path(a.table).write_text(trajectory_table(a.snapshots), encoding="utf-8")
    print(Path(a.table).read_text(encoding="utf-8"))
    return 0


def ontology(a) -> int:
    from .plans.ontology import compile_spec, load_spec, write_rdfxml

    compiled = compile_spec(load_spec(a.input), a.own)
    write_rdfxml(compiled.triples, a.output)
    print(compiled.summary())
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="graphloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(required=True)
    for f, more in (
        (datasets, (("output", None), ("--terms", "https://terms.example.org/"), ("--address", "https://datasets.example.org/resource/"))),
        (extract, (("output", None), ("--artifact", "dataset"), ("--service", "service"))),
        (repositories, (("output", None),)),
        (metrics, (("label", None), ("--name", None), ("--order", None), ("--snapshots", "snapshots"), ("--table", "trajectory.md"), ("--service", "service"))),
        (ontology, (("output", None), ("--own", "own"))),
    ):
        command = commands.add_parser(f.__name__)
        command.add_argument("input")
        for name, default in more:
            command.add_argument(name, **({"default": default, "type": int if name == "--order" else str} if name.startswith("-") else {}))
        command.set_defaults(run=f)
    a = parser.parse_args(argv)
    return a.run(a)


if __name__ == "__main__":
    sys.exit(main())
