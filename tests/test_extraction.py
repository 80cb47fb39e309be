"""The rules of dataset records on a small corpus that takes every branch."""

import pytest
from pyspark.sql import functions as F

from graphloom.operators import graph
from graphloom.plans.extraction import RECORD, extract

A, B, C, X = "a" * 32, "b" * 32, "c" * 32, "f" * 32


def relation(predicate=None, label=None, explicit=None, target=None, urls=None):
    return {"predicate_qname": predicate, "relation_label": label, "target_resource_id": explicit, "target": target, "embedded_urls": urls}


RECORDS = [
    {
        "resource_id": A, "resource_type": "CompositeResource", "title": "First", "identifier": "http://x.org/1", "url": "http://x.org/1",
        "creators": [{"name": "Ada L", "creator_order": 1, "organization": "Lab", "identifiers": [{"id_type": "ORCID", "url": "https://orcid.org/0000-0001-0000-000x"}]}, {"name": "Bob", "user_id": "7"}],
        "contributors": [{"name": "Ada Lovelace", "identifiers": [{"id_type": "ORCID", "url": "0000-0001-0000-000X"}]}],
        "creator_identifiers": [{"person_name": "Ada L", "id_type": "ORCID", "url": "0000-0001-0000-000X"}, {"person_name": "Bob", "id_type": "GoogleScholarID", "url": "http://scholar/bob"}, {"person_name": "Bob", "id_type": "Other", "url": "x"}, {"person_name": "Bob", "id_type": "ORCID", "url": "bad"}],
        "rights": {"statement": "CC", "url": "http://creativecommons.org/licenses/by/4.0/"}, "subjects": ["Water", "water "],
        "spatial_coverage": {"type": "box", "northlimit": 1.5}, "temporal_coverage": {"start": "2020", "end": "2021"},
        "awards": [{"title": "T", "number": "N 1", "funding_agency_name": "Agency", "funding_agency_url": "https://ror.org/012345678"}],
        "files": [{"file_name": "a.csv", "file_path": "data/a.csv"}, {"file_name": "b.csv"}],
        "typed_relations": [relation("dcterms:isPartOf", target=f"http://s.org/resource/{B}"), relation("prov:wasDerivedFrom", explicit=X), relation("dcterms:references", target="doi:10.1234/Q."), relation("dcterms:source", target="see", urls=["https://github.com/o/r/", "http://z.org"]),
                            relation("hsterms:isDescribedBy", target="Someone (2020)"), relation("dcterms:requires", target="plain"), relation("dcterms:references", target="http://data.org/d"), relation("hsterms:isExecutedBy", explicit=C)],
        "relations_from_meta": [relation(label="The content of this resource can be executed by", target="https://tool.org/run")],
        "related_resources": [relation("dcterms:references", target="doi:10.1234/Q.")],
        "geospatial_relations": [{"name": "Gage", "target": "https://geo.org/1", "predicate_qname": "hsterms:relation"}, {"name": "none"}],
    },
    {"resource_id": B, "resource_type": "CollectionResource", "links": [relation("dcterms:hasPart", explicit=A), relation("dcterms:hasPart", target="nothing")], "files": [{"file_name": "x"}]},
    {"resource_id": C, "resource_type": "ToolResource", "title": "Tool C", "tool_config": {"app_home_page_url": "https://app.org:8080/x", "tool_version": "2", "supported_file_extensions": [".nc"]}, "creator_identifiers": [{"person_name": "Ada L", "id_type": "ResearchGateID", "url": "http://rg/ada"}]},
    {"resource_id": "d" * 32, "resource_type": "Odd"},
]


@pytest.fixture(scope="module")
def built(spark):
    records = spark.createDataFrame([{}], RECORD).limit(0)
    rows = [{k: None for k in records.columns} | r for r in RECORDS]
    found = extract(spark.createDataFrame(rows, records.schema).repartition(3).withColumn("extra", F.when(F.col("title") == "First", "some")))
    return {r.id: r for r in found.nodes.collect()}, found.edges.collect(), {r.reason: r.n for r in found.skipped.collect()}, found


def pairs(edges, relation):
    return sorted((e.source, e.target) for e in edges if e.relation == relation)


def test_nodes(built):
    nodes, edges, _, found = built
    assert {n["class"] for n in nodes.values()} == {"DatasetResource", "ResourceType", "Person", "Organization", "Identifier", "License", "Subject", "SpatialCoverage", "TemporalCoverage", "Award", "DatasetFile", "ToolConfiguration", "Tool", "HydrologicFeature", "Paper", "Repository"}
    ada = nodes["person:orcid:0000-0001-0000-000X"]
    assert ada.attributes["name"] == '["Ada L","Ada Lovelace"]' and ada.evidence.sourceLocation == f"{A}:creators[0]"
    assert nodes["license:cc-by-4.0"].attributes["spdxId"] == '"CC-BY-4.0"'
    assert nodes["subject:water"].attributes["label"] == '["Water","water "]'
    assert nodes[f"{A}:spatial"].evidence.evidenceText == '{"eastlimit": null, "northlimit": 1.5, "projection": null, "southlimit": null, "type": "box", "units": null, "westlimit": null}'
    assert nodes["organization:ror:012345678"].attributes["name"] == '"Agency"' and "organization:name:lab" in nodes
    assert nodes[B].curation_status == "curated" and nodes[X].curation_status == "referenced"
    assert nodes[A].evidence.evidenceText == '{"abstract": null, "title": "First"}'
    assert nodes[f"{C}:tool-config"].attributes["descriptor"] == '"Tool C, v2"' and nodes[f"{C}:tool-config"].attributes["supportedFileExtensions"] == '[".nc"]'
    assert nodes["repository:url:github-com-o-r"].attributes["path"] == '"o/r"'
    assert graph.duplicate_ids(found.nodes).count() == 0


def test_edges(built):
    nodes, edges, _, _ = built
    assert pairs(edges, "isMemberOf") == [(A, B)] and pairs(edges, "hasMember") == [(B, A)] and pairs(edges, "derivedFrom") == [(A, X)]
    targets = {t.rpartition(":")[0] for _, t in pairs(edges, "references")}
    assert targets == {"paper:doi", "repository:url", "dataset:url", "paper:citation"} and len(pairs(edges, "references")) == 4
    assert ("person:orcid:0000-0001-0000-000X", "identifier:0000-0001-0000-000x") in pairs(edges, "hasIdentifier")
    assert ("person:name:bob", "identifier:scholar-bob") in pairs(edges, "hasIdentifier")
    # by then the person has two names, so the name leads to a key of its own
    assert ("person:name:ada-l", "identifier:rg-ada") in pairs(edges, "hasIdentifier")
    executed = sorted(t for _, t in pairs(edges, "isExecutedBy"))
    assert executed[0] == "tool:url:app-org-8080" and len(executed) == 2
    assert pairs(edges, "launchesApp") == [(f"{C}:tool-config", "tool:url:app-org-8080")]
    assert pairs(edges, "hasFile") == [(A, f"{A}:file:b-csv"), (A, f"{A}:file:data-a-csv")]
    assert len({e.id for e in edges}) == len(edges)
    first = next(e for e in edges if e.relation == "hasCreator" and e.target.startswith("person:orcid"))
    assert first.attributes == {"creatorOrder": "1"}


def test_skips(built):
    *_, skips, _ = built
    assert skips == {
        "unmapped_person_identifier:Other": 1, "invalid_orcid_identifier": 1, "unresolved_geospatial_target": 1, "unresolved_hasMember_target": 1,
        "deferred_to_llm:reference_target:dcterms:requires": 1, "unexpected_files_for_type:CollectionResource": 1, "unknown_resource_type:Odd": 1,
        "unmapped_top_level_field:CompositeResource:extra": 1,
    }


def test_reruns_agree(spark, built):
    records = spark.createDataFrame([{}], RECORD).limit(0)
    rows = [{k: None for k in records.columns} | r for r in reversed(RECORDS)]
    again = extract(spark.createDataFrame(rows, records.schema).coalesce(1))
    assert {r.id: r for r in again.nodes.collect()} == built[0]
    assert sorted(again.edges.collect()) == sorted(built[1])
