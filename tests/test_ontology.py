"""The schema compiler and conformance on a small specification."""

import xml.etree.ElementTree as ET

import pytest

from graphloom.plans import ontology as o
from graphloom.plans.patterns import Schema, TypedGraph, class_closure, reachable

SPEC = {
    "prefixes": [{"prefix": "own", "iri": "https://own.org/o#"}, {"prefix": "schema", "iri": "https://schema.org/", "use": "import", "import_iri": "https://schema.org/all"}, {"prefix": "dcterms", "iri": "http://purl.org/dc/terms/", "use": "annotation"}],
    "global_constraints": [{"property": "curationStatus", "values": ["curated", "referenced"]}],
    "classes": [
        {"id": "1", "name": "EvidenceSpan", "iri": "own:EvidenceSpan", "kind": "metadata"},
        {"id": "2", "name": "Agent", "iri": "own:Agent", "kind": "agent", "abstract": True, "attributes": [{"name": "label", "type": "string"}]},
        {"id": "3", "name": "Person", "iri": "schema:Person", "kind": "agent", "anchor": {"curie": "schema:Person", "relation": "useDirectly"}, "parent": "Agent", "attributes": [{"name": "label", "type": "int"}, {"name": "age", "type": "int"}]},
        {"id": "4", "name": "Paper", "iri": "own:Paper", "kind": "artifact", "anchor": {"curie": "schema:Article", "relation": "subClassOf"}},
        {"id": "5", "name": "Period", "iri": "own:Period", "kind": "other", "anchor": {"curie": "dcterms:temporal", "relation": "subClassOf"}},
    ],
    "relations": [
        {"id": "r1", "name": "hasAuthor", "domain": "Paper", "range": "Person", "cardinality": "min 1"},
        {"id": "r2", "name": "authorOf", "domain": "Person", "range": "Paper", "inverse_of": "hasAuthor"},
        {"id": "r3", "name": "hasEvidence", "domain": "owl:Thing", "range": "EvidenceSpan", "cardinality": "min 1"},
        {"id": "r4", "name": "cites", "domain": "Paper", "range": ["Paper", "Period"]},
        {"id": "r5", "name": "cites", "domain": "Agent", "range": "Paper"},
        {"id": "r6", "name": "extends", "domain": "Paper", "range": "Paper", "subproperty_of": "cites"},
        {"id": "r7", "name": "page", "domain": "Paper", "range": "schema:url"},
    ],
}


@pytest.fixture(scope="module")
def compiled():
    return o.compile_spec(SPEC, "own")


def said(c, s=None, p=None, x=None):
    return [t for t in c.triples if (s is None or t[0] == s) and (p is None or t[1] == p) and (x is None or t[2] == x)]


def test_compiled(compiled, spark):
    own = "https://own.org/o#"
    assert compiled.summary() == {"minted_classes": 4, "external_classes": 1, "object_properties": 5, "data_properties": 4, "imports": 1}
    assert said(compiled, own + "Paper", o.RDFS + "subClassOf", "https://schema.org/Article") and not said(compiled, own + "Period", o.RDFS + "subClassOf", "http://purl.org/dc/terms/temporal")
    assert not said(compiled, "https://schema.org/Person", o.RDFS + "subClassOf")  # nothing is asserted of external classes
    assert said(compiled, own + "hasEvidence", o.RDFS + "domain", o.THING) and not said(compiled, o.THING, o.RDF + "type")
    assert said(compiled, own + "authorOf", o.OWL + "inverseOf", own + "hasAuthor") and said(compiled, own + "extends", o.RDFS + "subPropertyOf", own + "cites")
    domain = said(compiled, own + "cites", o.RDFS + "domain")[0][2]
    assert domain.startswith("_:") and said(compiled, domain, o.OWL + "unionOf")
    assert said(compiled, own + "label", o.RDFS + "range")[0][2] == o.XSD + "string"
    evidence = [t for t in said(compiled, p=o.OWL + "onProperty", x=own + "hasEvidence")]
    assert len(evidence) == 2 and len(said(compiled, p=o.OWL + "onProperty", x=own + "hasAuthor")) == 1
    assert len(compiled.triples) == compiled.table(spark).distinct().count()
    used = [t[2] for t in compiled.triples if t[2].startswith("_:")]
    assert len(used) == len(set(used))  # an expression has one place


def test_a_class_of_every_kind():
    """Names, parents, anchors and enumerations as a published schema mixes them."""
    spec = {
        "prefixes": [{"prefix": "own", "iri": "https://own.org/o#"}, {"prefix": "schema", "iri": "https://schema.org/"}, {"prefix": "ext", "iri": "https://ext.org/", "use": "import"}],
        "ontology": {"iri": "https://own.org/o#", "title": "T", "version": 0.1},
        "classes": [
            {"name": "Base", "iri": "own:Base", "kind": "domain", "abstract": True},
            {"name": "Variable", "iri": "schema:variableMeasured", "kind": "domain", "parent": "own:Base", "anchor": {"curie": "schema:PropertyValue", "relation": "subClassOf"}},
            {"name": "Version", "iri": "own:Version", "anchor": {"curie": "schema:softwareVersion", "relation": "useDirectly"}, "note": "n"},
            {"name": "Site", "iri": "ext:Site", "anchor": {"curie": "ext:Site", "relation": "useDirectly"}, "parent": "Base", "attributes": ["plain", {"name": "state", "type": "int", "values": ["x", "y"]}]},
            {"name": "Claim", "iri": "own:Claim", "kind": "discourse", "parent": "ext:Statement"},
        ],
        "relations": [{"name": "link", "domain": "Claim", "range": "schema:url", "cardinality": "min 1"}, {"name": "about", "domain": ["Claim", "Site"], "range": "ext:Thing", "cardinality": "min 1"}, {"name": "loose"}],
        "global_constraints": [{"property": "tendency"}, {"property": "unknown"}],
    }
    c = o.compile_spec(spec, "own")
    own = "https://own.org/o#"
    assert c.summary() == {"minted_classes": 4, "external_classes": 1, "object_properties": 2, "data_properties": 4, "imports": 1}
    facts = set(c.facts())
    assert {(own + "Variable", o.RDFS + "subClassOf", own + "Base"), (own + "Variable", o.RDFS + "subClassOf", "https://schema.org/PropertyValue"), (own + "Claim", o.RDFS + "subClassOf", "https://ext.org/Statement")} <= facts
    assert (own + "state", o.RDFS + "range", o.XSD + "string") in facts and (own + "state", own + "allowedValue", "y") in facts
    assert {f for f in facts if f[1].startswith("min 1")} == {(own + "Claim", "min 1 " + own + "about", "https://ext.org/Thing"), ("https://ext.org/Site", "min 1 " + own + "about", "https://ext.org/Thing")}
    assert (own + "loose", o.RDFS + "domain", o.THING) in facts and ("https://ext.org/Thing", o.RDF + "type", o.OWL + "Class") in facts
    assert (own + "tendency", o.RDFS + "domain", own + "Claim") in facts and own + "unknown" not in {f[0] for f in facts}
    assert ("https://own.org/o", o.OWL + "versionInfo", "0.1") in facts
    again = o.compile_spec(spec | {"global_constraints": [{"property": "link"}]}, "own", global_properties={"link": None})
    assert [f[2] for f in again.facts() if f[0] == own + "link" and f[1] == o.RDFS + "domain"] == [o.THING]


def test_entity_names():
    prefixes = {"a": "https://x.org/", "b": "https://x.org/deep#"}
    assert o.entity_name("https://x.org/deep#Name", prefixes) == ("https://x.org/deep#", "Name")
    assert o.entity_name("https://x.org/1-a.b", prefixes) == ("https://x.org/", "_1_a_b")
    assert o.entity_name("https://y.org/z#label", prefixes) == ("https://y.org/z#", "label_property")
    assert o.entity_name("https://y.org/z/w", prefixes) == ("https://y.org/z/", "w")
    assert o.resolve("owl:Thing", {}) == o.THING


def test_rdfxml(compiled, tmp_path):
    o.write_rdfxml(compiled.triples, str(tmp_path / "o.owl"))
    root = ET.parse(tmp_path / "o.owl").getroot()
    assert sum(len(d) for d in root) == len(compiled.triples)


def test_errors():
    with pytest.raises(ValueError, match="no class"):
        o.compile_spec(SPEC | {"classes": [{"name": "A", "iri": "own:A", "parent": "Nobody"}], "relations": []}, "own")
    with pytest.raises(ValueError, match="object property"):
        o.compile_spec(SPEC | {"relations": [{"name": "a", "domain": "Paper", "range": "Paper", "inverse_of": "b"}]}, "own")
    twice = [{"name": n, "domain": "Paper", "range": "Paper"} for n in "abc"] + [{"name": "a", "inverse_of": "b"}, {"name": "c", "inverse_of": "b"}]
    with pytest.raises(ValueError, match="another inverse"):
        o.compile_spec(SPEC | {"relations": twice}, "own")
    with pytest.raises(ValueError, match="unknown prefix"):
        o.resolve("zz:x", {})


def test_load_spec(tmp_path):
    yaml = pytest.importorskip("yaml")
    (tmp_path / "s.yaml").write_text(yaml.safe_dump(SPEC))
    assert o.load_spec(str(tmp_path / "s.yaml"))["classes"][0]["name"] == "EvidenceSpan"
    (tmp_path / "bad.yaml").write_text("- 1")
    with pytest.raises(ValueError):
        o.load_spec(str(tmp_path / "bad.yaml"))


def test_conformance(spark):
    tables = o.spec_tables(spark, SPEC)
    closure = class_closure(spark, tables["parents"])
    nodes = spark.createDataFrame([("p", "Paper"), ("a", "Person"), ("x", "Period")], "id string, class string")
    edges = spark.createDataFrame([("hasAuthor", "p", "a"), ("hasAuthor", "x", "a"), ("cites", "a", "p"), ("cites", "p", "a"), ("hasEvidence", "x", "x"), ("unknown", "x", "x")], "relation string, source string, target string")
    got = {tuple(r) for r in o.violations(nodes, edges, tables["allowed"], closure).collect()}
    assert got == {("hasAuthor", "domain", "x", "Period"), ("cites", "range", "a", "Person"), ("hasEvidence", "range", "x", "Period")}
    bare = spark.createDataFrame([("n", None), ("m", ("t", "s:1", "d", "a"))], "id string, evidence struct<evidenceText:string,sourceLocation:string,extractionMethod:string,sourceArtifact:string>")
    assert [tuple(r) for r in o.without_evidence(bare, bare.limit(0)).collect()] == [("node", "n")]
    status = spark.createDataFrame([("n", "curated"), ("m", "odd")], "id string, curation_status string")
    assert [r.id for r in o.outside_enumeration(status, "curation_status", ("curated", "referenced")).collect()] == ["m"]


def test_meanings_and_paths(spark):
    schema = Schema({"documentedBy": "describes"}, {"describesTool": "describes"})
    assert schema.meanings("describesTool") == [("describesTool", False)]
    assert schema.meanings("documentedBy") == [("documentedBy", False), ("describes", True), ("describesTool", True)]
    edges = spark.createDataFrame([("describesTool", "p", "t"), ("documentedBy", "t", "q"), ("documentedBy", "t", "p")], "relation string, source string, target string")
    g = TypedGraph(edges, schema=schema)
    assert sorted((r.source, r.target) for r in g.relation("documentedBy").collect()) == [("t", "p"), ("t", "q")]
    assert sorted((r.source, r.target) for r in g.relation("describes").collect()) == [("p", "t"), ("q", "t")]
    loop = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "source string, target string")
    got = {r.reached for r in reachable(spark.createDataFrame([("a",)], "id string"), loop).collect()}
    assert got == {"a", "b", "c", "d"}
