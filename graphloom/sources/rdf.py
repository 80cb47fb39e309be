"""RDF/XML metadata of a dataset resource: relations, collection members and tool settings.

Spark's xpath functions lose namespaces, so one Arrow function goes over the parser's events and tells each element of the
resource with its place: the number and tag of the container that holds it, the number of the branch below that, its depth.
What the elements mean is column expressions over these rows."""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text, none_if_empty
from ..session import map_arrow

# Namespaces. That of the service's own terms is a parameter.
NAMESPACES = {"dc": "http://purl.org/dc/elements/1.1/", "dcterms": "http://purl.org/dc/terms/", "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "rdfs": "http://www.w3.org/2000/01/rdf-schema#"}
TERMS = "https://terms.example.org/"
KINDS = ("CompositeResource", "CollectionResource", "ToolResource")
SETTINGS = {"app_home_page_url": "AppHomePageUrl", "request_url_base": "RequestUrlBase", "request_url_base_file": "RequestUrlBaseFile", "tool_version": "ToolVersion", "testing_protocol_url": "TestingProtocolUrl"}
LISTS = {"supported_file_extensions": "SupportedFileExtensions", "supported_resource_types": "SupportedResTypes", "supported_sharing_status": "SupportedSharingStatus"}

_FIELDS = [("container", pa.int32()), ("holder", pa.string()), ("branch", pa.int32()), ("depth", pa.int32()), ("tag", pa.string()), ("address", pa.string()), ("text", pa.string())]
_ROWS = "array<struct<container:int,holder:string,branch:int,depth:int,tag:string,address:string,text:string>>"
_DEEP = 2  # below a container: branch 1, member 2


def elements(document: str, kinds: frozenset[str]) -> tuple[str | None, list[dict]]:
    """Tag of the first child of the root that is of a kind, and the elements below it in the order of their ends."""
    parser = ET.XMLPullParser(("start", "end"))
    parser.feed(document)
    parser.close()
    kind, rows, path, seen = None, [], [], [0]
    for event, e in parser.read_events():
        if event == "start":
            path.append((e.tag, seen[-1]))
            seen[-1] += 1
            seen.append(0)
            if len(path) == 2 and kind is None and e.tag in kinds:
                kind, inside = e.tag, path[1]
            continue
        if kind and len(path) > 2 and path[1] is inside:
            rows.append({"container": path[2][1], "holder": path[2][0], "branch": path[3][1] if len(path) > 3 else None, "depth": len(path) - 3, "tag": e.tag, "address": e.get(f"{{{NAMESPACES['rdf']}}}resource"), "text": "".join(e.itertext())})
        path.pop()
        seen.pop()
    return kind, rows


def _parsed(kinds: frozenset[str]):
    def run(batches):
        for batch in batches:
            found, errors = [], []
            for document in batch.column(1).to_pylist():
                try:
                    found.append(elements(document, kinds) if document else (None, []))
                    errors.append(None)
                except ET.ParseError as error:
                    found.append((None, []))
                    errors.append(str(error))
            rows = pa.array([r for _, r in found], pa.list_(pa.struct(_FIELDS)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([k for k, _ in found], pa.string()), rows, pa.array(errors, pa.string())], names=["key", "kind", "rows", "error"])

    return run


class _Meaning:
    """Columns over kind and rows (see elements)."""

    def __init__(self, terms: str):
        self.spaces = NAMESPACES | {"hsterms": terms}

    def tag(self, name: str) -> Column:
        prefix, _, local = name.partition(":")
        return F.lit(f"{{{self.spaces[prefix]}}}{local}")

    def name(self, tag: Column) -> Column:
        """Compact name; of an unknown namespace the local one."""
        out = F.regexp_replace(tag, r"\A\{[^}]*\}", "")
        local = out
        for prefix, iri in self.spaces.items():
            out = F.when(F.startswith(tag, F.lit(f"{{{iri}}}")), F.concat(F.lit(f"{prefix}:"), local)).otherwise(out)
        return out

    @staticmethod
    def value(e: Column) -> Column:
        """A referenced address, else the text."""
        return clean_text(F.coalesce(none_if_empty(e["address"]), e["text"]))

    def relation(self, e: Column) -> Column:
        uri = F.when(F.startswith(e["tag"], F.lit("{")), F.translate(e["tag"], "{}", ""))
        kind = F.when(none_if_empty(e["address"]).isNotNull(), "uri_ref").otherwise("literal")
        return F.struct(self.name(e["tag"]).alias("predicate_qname"), uri.alias("predicate_uri"), self.value(e).alias("target"), kind.alias("rdf_object_kind"))

    def members(self, holder: str) -> Column:
        """Elements of the first branch of each such container."""
        return F.filter("rows", lambda e: (e["holder"] == self.tag(holder)) & (e["branch"] == 0) & (e["depth"] == _DEEP))

    @staticmethod
    def once(values: Column, key) -> Column:
        """The first member of each key, in order: equal keys lie side by side once sorted, so no member is sought in all others.
        The sorted array is a member of an array of one, since lambdas evaluate what they name anew for each member."""
        named = F.array_sort(F.transform(values, lambda v, i: F.struct(key(v).alias("key"), i.alias("i"), v.alias("v"))))
        first = F.transform(F.array(named), lambda a: F.filter(a, lambda e, n: (n == 0) | ~e["key"].eqNullSafe(F.get(a, n - 1)["key"])))[0]
        again = F.array_sort(F.transform(first, lambda e: F.struct(e["i"].alias("i"), e["v"].alias("v"))))
        return F.transform(again, lambda e: e["v"])

    def typed_relations(self) -> Column:
        told = F.filter(F.transform(self.members("dc:relation"), self.relation), lambda r: r["target"].isNotNull())
        return self.once(told, lambda r: F.concat_ws("\u0000", r["predicate_qname"], r["target"]))

    def geospatial_relations(self) -> Column:
        """One a container: its last name and its last relation."""
        rows, is_name = self.members("hsterms:geospatialRelation"), lambda e: e["tag"] == self.tag("hsterms:relation_name")

        def told(container: Column) -> Column:
            own = F.filter(rows, lambda e: e["container"] == container)
            name = F.try_element_at(F.transform(F.filter(own, is_name), lambda e: clean_text(e["text"])), F.lit(-1))
            last = F.try_element_at(F.filter(F.transform(F.filter(own, lambda e: ~is_name(e)), self.relation), lambda r: r["target"].isNotNull()), F.lit(-1))
            return F.struct(name.alias("name"), *[last[c].alias(c) for c in ("predicate_qname", "predicate_uri", "target", "rdf_object_kind")])

        found = F.filter(F.transform(F.array_distinct(F.transform(rows, lambda e: e["container"])), told), lambda r: r["target"].isNotNull())
        return self.once(found, lambda r: F.concat_ws("\u0000", F.coalesce(r["name"], F.lit("\u0001")), r["target"]))

    def setting(self, name: str, leaf: str = "value") -> Column:
        """Values below the first container of that name, each once."""
        own = F.filter("rows", lambda e: e["holder"] == self.tag(f"hsterms:{name}"))
        first = F.array_min(F.transform(own, lambda e: e["container"]))
        values = F.transform(F.filter(own, lambda e: (e["container"] == first) & (e["tag"] == self.tag(f"hsterms:{leaf}")) & (e["depth"] > 0)), self.value)
        return F.array_distinct(F.filter(values, lambda v: v.isNotNull()))

    def tool_config(self) -> Column:
        first = lambda values: F.try_element_at(values, F.lit(1))
        plain = lambda k, v: F.replace(v, F.lit("%0A"), F.lit("")) if k.startswith("request_url") else v
        single = [plain(k, first(self.setting(n))).alias(k) for k, n in SETTINGS.items()]
        single += [first(self.setting("ToolIcon")).alias("tool_icon_url"), first(self.setting("ToolIcon", "data_url")).alias("tool_icon_data_url")]
        lists = [self.setting(n).alias(k) for k, n in LISTS.items()]
        config = F.struct(*single, *lists)
        names = [*SETTINGS, "tool_icon_url", "tool_icon_data_url"]
        any_ = F.coalesce(*[none_if_empty(config[k]) for k in names]).isNotNull()
        for k in LISTS:
            any_ = any_ | (F.size(config[k]) > 0)
        return F.when(F.endswith("kind", F.lit("}ToolResource")) & any_, config)


def with_semantics(rows: DataFrame, key: str, text: str, terms: str = TERMS) -> DataFrame:
    """key, semantics of a column of RDF/XML documents: a missing one says nothing, a broken one its error."""
    kind = rows.schema[key].dataType.simpleString()
    parsed = map_arrow(rows.select(key, text), _parsed(frozenset(f"{{{terms}}}{k}" for k in KINDS)), f"key {kind}, kind string, rows {_ROWS}, error string")
    m = _Meaning(terms)
    said = F.struct(
        F.regexp_replace("kind", r"\A\{[^}]*\}", "").alias("resource_xml_type"),
        m.typed_relations().alias("typed_relations"),
        m.geospatial_relations().alias("geospatial_relations"),
        m.tool_config().alias("tool_config"),
        F.col("error").alias("error"),
    )
    return parsed.select(F.col("key").alias(key), said.alias("semantics"))
