"""Edges to hydrologic features by their rule alone: in one shuffle, and as in the whole graph on odd members."""

from graphloom.plans import catalogue
from graphloom.plans.extraction import RECORD, extract, extract_edges

from .conftest import SF

ODD = [
    ("a", [(None, "hsterms:relation", "https://geo.org/1", None), ("", "hsterms:relation", "https://geo.org/1", ["http://x.org"]), ("Gage", None, "Plain text", ["http://y.org"])]),
    ("b", [("Gage", "p", "", ["ftp://no.org", "https://geo.org/2"]), (" ", "p", None, ["http://geo.org/3", "http://geo.org/4"]), (None, "p", " ", ["http://geo.org/5"])]),
    ("c", [("Gage", "p", None, None), ("Gage", "p", "", []), ("Gage", "p", None, ["ftp://no.org"])]),
    ("d", None),
    ("e", []),
    ("a", [("Again", "p", "https://geo.org/1", None), ("New", "p", "https://geo.org/6", None)]),
]


def test_as_in_the_whole_graph(spark):
    records = spark.createDataFrame([{}], RECORD).limit(0)
    odd = [{k: None for k in records.columns} | {"resource_id": rid, "geospatial_relations": gs and [dict(zip(("name", "predicate_qname", "target", "embedded_urls"), g, strict=True)) for g in gs]} for rid, gs in ODD]
    records = spark.createDataFrame(odd, records.schema)
    found = sorted(map(tuple, extract_edges(records, "referencesFeature").drop("attributes").collect()))
    whole = extract(records).edges.filter("relation = 'referencesFeature'")
    assert found == sorted(map(tuple, whole.select("id", "relation", "inventory_id", "source", "target", "evidence").collect())) and len(found) == 6
    attributes = lambda df: {r.id: r.attributes for r in df.collect()}
    assert attributes(extract_edges(records, "referencesFeature")) == attributes(whole)


def test_one_shuffle(spark):
    plan = catalogue.QUERIES["extract_edge_referencesFeature"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
