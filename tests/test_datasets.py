"""Raw dataset folders to records, and on to the graph."""

import json

import pytest

from graphloom.operators.documents import sections
from graphloom.plans import datasets
from graphloom.plans.extraction import extract
from graphloom.sources.rdf import with_semantics

A, B = "a" * 32, "b" * 32
T = "https://terms.example.org/"
XML = f"""<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:dcterms="http://purl.org/dc/terms/" xmlns:hsterms="{T}" xmlns:x="http://x.org/">
<hsterms:ToolResource>
 <dc:relation><rdf:Description><dcterms:references>See https://y.org/1). and https://y.org/1</dcterms:references><dcterms:references>See https://y.org/1). and https://y.org/1</dcterms:references><x:odd rdf:resource="http://s.org/resource/{B}"/></rdf:Description></dc:relation>
 <hsterms:geospatialRelation><rdf:Description><hsterms:relation_name>Gage</hsterms:relation_name><hsterms:relation rdf:resource="https://geo.org/1"/></rdf:Description></hsterms:geospatialRelation>
 <hsterms:AppHomePageUrl><rdf:Description><hsterms:value>https://app.org/x</hsterms:value></rdf:Description></hsterms:AppHomePageUrl>
 <hsterms:RequestUrlBase><rdf:Description><hsterms:value>https://r.org/%0Aq</hsterms:value></rdf:Description></hsterms:RequestUrlBase>
 <hsterms:SupportedResTypes><rdf:Description><hsterms:value>One</hsterms:value><hsterms:value>Two</hsterms:value></rdf:Description></hsterms:SupportedResTypes>
 <hsterms:ToolIcon><rdf:Description><hsterms:data_url>data:image/png;base64,AAAA</hsterms:data_url></rdf:Description></hsterms:ToolIcon>
</hsterms:ToolResource></rdf:RDF>"""
META = {
    "title": " A  title ", "creators": [{"name": "Ada", "creator_order": 1, "identifiers": {"ORCID": "https://orcid.org/0000-0001-0000-0000", "Empty": " "}}], "subjects": ["x", "x ", ""],
    "relations": [{"type": "cites", "value": "See https://y.org/1). and https://y.org/1"}, {"type": "cites", "value": "other"}, {"type": "cites", "value": "other"}, {"value": ""}],
    "spatial_coverage": {"northlimit": 0.0, "north": 5.0, "units": "['Decimal degrees']"}, "rights": {"statement": "s"},
}
README = "﻿intro\r\n---\n# One\n\n## Deep\ntext\n#### Deeper\nmore\n# Two\n# Three\nend"


@pytest.fixture(scope="module")
def built(spark):
    rows = [
        (A, "meta_dump.json", json.dumps(META)), (A, "raw_metadata.xml", XML), (A, "file_inventory.json", json.dumps([{"file_name": "Readme.md", "extension": ".MD"}, {"file_name": "a.nc", "extension": ".nc"}, {"file_name": "b", "extension": ""}])),
        (A, "README.md", README), (A, "readme.txt", README.replace("\r\n", "\n").replace("\n", "\r\n") + "  "), (B, "meta_dump.json", "{broken"), (B, "raw_metadata.xml", "<broken"),
    ]
    records = datasets.build(spark.createDataFrame(rows, "resource_id string, name string, text string")).cache()
    return records, {r.resource_id: r for r in records.collect()}


def test_record(built):
    _, rows = built
    a, b = rows[A], rows[B]
    assert a.resource_type == "ToolResource" and a.title == "A title" and a.subjects == ["x"] and a.url.endswith(f"/{A}/")
    assert a.creators[0].identifiers == [("ORCID", "https://orcid.org/0000-0001-0000-0000")] and a.creator_identifiers[0].person_name == "Ada"
    assert a.spatial_coverage.northlimit == 5.0 and a.spatial_coverage.units == "Decimal degrees"
    assert [(r.predicate_qname, r.target_resource_id) for r in a.typed_relations] == [("dcterms:references", None), ("odd", B)]
    assert a.typed_relations[0].embedded_urls == ["https://y.org/1"]
    assert [(r.predicate_qname, r.relation_labels_from_meta, r.source_files) for r in a.related_resources] == [("dcterms:references", ["cites"], ["raw_metadata.xml", "meta_dump.json"]), ("odd", [], ["raw_metadata.xml"]), (None, ["cites"], ["meta_dump.json"])]
    assert [x.target_resource_id for x in a.links] == [B]
    assert a.tool_config.request_url_base == "https://r.org/q" and a.tool_config.supported_resource_types == ["One", "Two"]
    assert a.tool_config.tool_icon_data_url_summary.asDict() == {"present": True, "media_type": "image/png", "char_length": 26}
    assert a.file_summary.extensions == {".md": 1, ".nc": 1} and a.file_summary.has_readme_file and a.has_geospatial_files
    assert a.relation_summary.merged_relation_count == 3 and a.error == ""
    assert a.documentation.readme_file_count == 1 and a.documentation.primary_readme_file == "README.md"
    assert b.resource_type == "CompositeResource" and "invalid_json" in b.error and b.typed_relations == []


def test_sections(spark):
    rows = sections(spark.createDataFrame([(1, README.lstrip("﻿")), (2, ""), (3, "# Only")], "id int, text string"), "id", "text").orderBy("id", "section_id").collect()
    got = [(r.id, r.section_id, r.parent_section_id, r.heading, r.heading_level, r.section_text, r.has_children) for r in rows]
    assert got == [
        (1, 1, None, "README Introduction", 0, "intro", False),
        (1, 2, None, "One", 1, "One", True),
        (1, 3, 2, "Deep", 2, "text", True),
        (1, 4, 3, "Deeper", 4, "more", False),
        (1, 6, None, "Three", 1, "end", False),
    ]


def test_graph_of_records(built):
    records, _ = built
    found = extract(datasets.for_extraction(records))
    kinds = {r["class"]: r["count"] for r in found.nodes.groupBy("class").count().collect()}
    assert kinds["Person"] == 1 and kinds["HydrologicFeature"] == 1 and kinds["Tool"] == 1 and kinds["ToolConfiguration"] == 1
    assert found.skipped.filter("reason LIKE 'unmapped_top%'").count() == 0
    assert datasets.failures(records).count() == 2


def test_semantics(spark):
    docs = {"none": None, "empty": "", "broken": "<x", "whole": XML, "other": XML.replace(T, "https://other.org/"), "bare": "<a xmlns:b='http://b.org/'><b:c/></a>"}
    rows = spark.createDataFrame(list(docs.items()), "k string, xml string")
    got = {r.k: r.semantics for r in with_semantics(rows, "k", "xml", T).collect()}
    for k in ("none", "empty", "bare", "other"):
        assert got[k].resource_xml_type is None and got[k].typed_relations == [] and got[k].geospatial_relations == [] and got[k].tool_config is None and got[k].error is None
    assert "syntax" in got["broken"].error or "token" in got["broken"].error or got["broken"].error
    assert got["whole"].geospatial_relations[0].name == "Gage" and got["whole"].geospatial_relations[0].rdf_object_kind == "uri_ref"
    said = [(r.predicate_qname, r.predicate_uri, r.target, r.rdf_object_kind) for r in got["whole"].typed_relations]
    assert said == [("dcterms:references", "http://purl.org/dc/terms/references", "See https://y.org/1). and https://y.org/1", "literal"), ("odd", "http://x.org/odd", f"http://s.org/resource/{B}", "uri_ref")]
    config = got["whole"].tool_config
    assert (config.app_home_page_url, config.request_url_base, config.supported_resource_types, config.tool_version) == ("https://app.org/x", "https://r.org/q", ["One", "Two"], None)
    other = {r.k: r.semantics for r in with_semantics(rows, "k", "xml", "https://other.org/").collect()}["other"]
    assert other.resource_xml_type == "ToolResource" and other.tool_config.tool_icon_data_url.startswith("data:")


def test_elements_hold_their_place(spark):
    """Only the first branch of a container counts, of a geospatial one the last name and relation; nested text is joined."""
    ns = f'xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:dcterms="http://purl.org/dc/terms/" xmlns:h="{T}"'
    geo = '<h:geospatialRelation><rdf:Description><h:relation_name>A</h:relation_name><h:relation>one</h:relation><h:relation_name> B </h:relation_name><h:relation>two</h:relation></rdf:Description></h:geospatialRelation>'
    xml = f"<rdf:RDF {ns}><rdf:Other/><h:CollectionResource><dc:relation><rdf:Description><dcterms:hasPart>a <b>c</b>\n\n\n\nd</dcterms:hasPart><dcterms:hasPart> </dcterms:hasPart></rdf:Description><rdf:Description><dcterms:hasPart>second</dcterms:hasPart></rdf:Description></dc:relation>{geo}{geo}<h:ToolVersion><rdf:Description><h:value>9</h:value></rdf:Description></h:ToolVersion></h:CollectionResource><h:ToolResource><dc:relation><rdf:Description><dcterms:hasPart>late</dcterms:hasPart></rdf:Description></dc:relation></h:ToolResource></rdf:RDF>"
    got = with_semantics(spark.createDataFrame([(1, xml)], "k int, xml string"), "k", "xml", T).first().semantics
    assert [(r.predicate_qname, r.target) for r in got.typed_relations] == [("dcterms:hasPart", "a c\n\nd")]
    assert [(r.name, r.target) for r in got.geospatial_relations] == [("B", "two")]
    assert got.resource_xml_type == "CollectionResource" and got.tool_config is None
