"""Edges of one relation and nodes of one class come from their own rules, and are those of the whole graph."""

import pytest

from graphloom.plans import catalogue
from graphloom.plans.extraction import RECORD, extract, extract_edges, extract_nodes

from .conftest import SF
from .test_extraction import RECORDS

NAMES = ["affiliatedWith", "coversPeriod", "fundedBy", "hasContributor", "hasCreator", "hasFile", "hasIdentifier", "hasLicense", "hasMember", "hasResourceType", "hasSpatialCoverage", "hasSubject", "hasToolConfig", "isExecutedBy", "isMemberOf", "launchesApp", "references", "referencesFeature", "derivedFrom", "Organization"]


@pytest.fixture(scope="module")
def corpus(spark):
    records = spark.createDataFrame([{}], RECORD).limit(0)
    records = spark.createDataFrame([{k: None for k in records.columns} | r for r in RECORDS], records.schema)
    whole = extract(records)
    return records, {r.id: r for r in whole.nodes.collect()}, {r.id: r for r in whole.edges.collect()}


@pytest.mark.parametrize("name", NAMES)
def test_alone_as_in_the_whole_graph(corpus, name):
    records, nodes, edges = corpus
    if name[0].isupper():
        found, want = extract_nodes(records, name), {k: r for k, r in nodes.items() if r["class"] == name}
    else:
        found, want = extract_edges(records, name), {k: r for k, r in edges.items() if r.relation == name}
    assert want and {r.id: r for r in found.collect()} == want


@pytest.mark.parametrize("name", NAMES)
def test_other_rules_are_left_out(spark, name):
    kind = "node" if name[0].isupper() else "edge"
    plan = catalogue.QUERIES[f"extract_{kind}_{name}"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert ("hydrologic-feature:" in plan) == (name == "referencesFeature")
    assert ("resource-type:" in plan) == (name == "hasResourceType")


def test_keys_without_evidence(corpus):
    """Counts need neither evidence nor attributes; the edges are the same."""
    records, _, edges = corpus
    found = extract_edges(records, told=False).collect()
    assert {(r.id, r.relation, r.source, r.target) for r in found} == {(r.id, r.relation, r.source, r.target) for r in edges.values()}
    assert all(r.evidence is None and not r.attributes for r in found if r.relation == "hasFile")
