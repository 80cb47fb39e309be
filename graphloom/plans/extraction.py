"""Dataset records to a graph: every rule is a projection of a record to mentions, merged afterwards.

Rules that need nothing but the record build one array of node mentions and one of edge mentions, so a record is read once.
Relations are exploded, deduplicated by key in the order of their fields, and joined once with the corpus to tell datasets and
tools of the corpus from outside ones. Identifiers of people are joined with the people mentioned before them.

ord of a mention is (resource_id, phase, rank, place): first always means first in this order.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.text import none_if_empty, short_hash, slugify, strip
from ..functions.values import json_text
from ..operators.graph import CURATED, REFERENCED, edge_id, merge_edges, merge_nodes
from ..operators.records import first_rows, histogram

# Vocabularies of the records.
COMPOSITE, COLLECTION, TOOL = "CompositeResource", "CollectionResource", "ToolResource"
DERIVATIONS = ("dcterms:isVersionOf", "dcterms:isFormatOf", "prov:wasDerivedFrom", "prov:wasRevisionOf")
REFERENCES = ("dcterms:references", "dcterms:isReferencedBy", "dcterms:requires", "dcterms:source", "hsterms:isDescribedBy", "hsterms:isSimilarTo")
PERSON_IDENTIFIERS = ("ORCID", "GoogleScholarID", "ResearchGateID")
EXECUTED = "hsterms:isExecutedBy"
EXECUTED_LABEL = "the content of this resource can be executed by"

_IDENT = "array<struct<id_type:string,url:string>>"
_PERSON = f"array<struct<name:string,creator_order:bigint,user_id:string,organization:string,identifiers:{_IDENT}>>"
_NAMED = "array<struct<person_name:string,id_type:string,url:string>>"
_RELATION = "array<struct<predicate_qname:string,relation_label:string,target_resource_id:string,target:string,embedded_urls:array<string>>>"
#: Columns of a dataset record. Fields that no rule reads may follow.
RECORD = f"""resource_id string, resource_type string, title string, abstract string, citation string, documentation string, language string, identifier string, url string,
creators {_PERSON}, contributors {_PERSON}, creator_identifiers {_NAMED}, contributor_identifiers {_NAMED},
rights struct<statement:string,url:string>, subjects array<string>,
spatial_coverage struct<eastlimit:double,northlimit:double,projection:string,southlimit:double,type:string,units:string,westlimit:double>, temporal_coverage struct<end:string,start:string>,
awards array<struct<funding_agency_name:string,funding_agency_url:string,number:string,title:string>>,
files array<struct<checksum:string,extension:string,file_name:string,file_path:string>>,
tool_config struct<app_home_page_url:string,request_url_base:string,request_url_base_file:string,tool_version:string,testing_protocol_url:string,tool_icon_url:string,
  supported_file_extensions:array<string>,supported_resource_types:array<string>,supported_sharing_status:array<string>>,
links {_RELATION}, typed_relations {_RELATION}, related_resources {_RELATION}, relations_from_meta {_RELATION},
geospatial_relations array<struct<name:string,predicate_qname:string,target:string,embedded_urls:array<string>>>"""

#: Relations of the graph.
RELATIONS = ("hasResourceType", "hasCreator", "hasContributor", "affiliatedWith", "hasIdentifier", "hasLicense", "hasSubject", "hasSpatialCoverage", "coversPeriod", "fundedBy", "hasFile", "hasToolConfig", "launchesApp", "hasMember", "isMemberOf", "derivedFrom", "references", "isExecutedBy", "referencesFeature")

_PEOPLE = ("creators", "creator_identifiers", "contributors", "contributor_identifiers")
#: Fields that the rules of a relation read beside resource_id.
READS = {
    "hasResourceType": ("resource_type",),
    "hasCreator": _PEOPLE[:2],
    "hasContributor": _PEOPLE[2:],
    "affiliatedWith": _PEOPLE,
    "hasIdentifier": ("identifier", "url", *_PEOPLE),
    "hasLicense": ("rights",),
    "hasSubject": ("subjects",),
    "hasSpatialCoverage": ("spatial_coverage",),
    "coversPeriod": ("temporal_coverage",),
    "fundedBy": ("awards",),
    "hasFile": ("resource_type", "files"),
    "hasToolConfig": ("resource_type", "title", "tool_config"),
    "launchesApp": ("resource_type", "title", "tool_config"),
    "hasMember": ("resource_type", "links", "typed_relations"),
    "isMemberOf": ("resource_type", "links", "typed_relations"),
    "derivedFrom": ("resource_type", "links", "typed_relations"),
    "references": ("resource_type", "related_resources", "typed_relations"),
    "isExecutedBy": ("resource_type", "title", "tool_config", "links", "typed_relations", "related_resources", "relations_from_meta"),
    "referencesFeature": ("geospatial_relations",),
}

_EVIDENCE = "struct<evidenceText:string,sourceLocation:string,extractionMethod:string,sourceArtifact:string>"
_NODE = f"array<struct<id:string,class:string,inventory_id:string,attributes:map<string,string>,evidence:{_EVIDENCE},curation_status:string>>"
_EDGE = f"array<struct<relation:string,inventory_id:string,source:string,target:string,evidence:{_EVIDENCE},attributes:map<string,string>>>"


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame
    skipped: DataFrame


def _cat(*xs) -> Column:
    return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])


def _texts(**fields: Column) -> Column:
    """Attributes from string columns."""
    return F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), json_text(v))])


def _spaced(pairs: list[tuple[str, Column]]) -> Column:
    """A JSON object as evidence shows it: sorted names, a blank after colon and comma. Values are JSON text."""
    parts = [_cat(f'"{k}": ', F.coalesce(v, F.lit("null"))) for k, v in sorted(pairs, key=lambda p: p[0])]
    return _cat("{", F.concat_ws(", ", *parts), "}")


def _all(arrays: list[Column]) -> Column | None:
    return F.concat(*arrays) if arrays else None


def _union(parts: list[DataFrame | None]) -> DataFrame | None:
    given = [p for p in parts if p is not None]
    return reduce(DataFrame.unionByName, given) if given else None


class Rules:
    """Builds mention structs for records whose columns are in scope."""

    def __init__(self, artifact: str = "dataset", service: str = "service", only: frozenset[str] | None = None, told: bool = True, alone: bool = False):
        """only: the classes and relations that are asked for (None: all); told: whether evidence and attributes are, too; alone: edges
        are told by single rules (see _edges_alone), not by arrays of mentions."""
        self.artifact, self.service, self.only, self.told, self.alone = artifact, service, only, told, alone
        #: of rules alone: the list whose members give an edge each (None: the record does), whether they do, the edge, members kept
        self.singles: list[tuple] = []
        self.reasons = only is None  # what is skipped is told of whole graphs
        self.resource = F.col("resource_id")

    def wants(self, *names: str) -> bool:
        return self.only is None or not self.only.isdisjoint(names)

    def evidence(self, said: Column, place: Column | str, resource: Column | None = None) -> Column:
        if not self.told:
            return F.lit(None).cast(_EVIDENCE)
        place = F.lit(place) if isinstance(place, str) else place
        if self.alone:  # the rest follows from the record, see whole()
            return F.struct(said.alias("said"), place.alias("place"))
        return self._whole(said, place, self.resource if resource is None else resource)

    def _whole(self, said: Column, place: Column, resource: Column) -> Column:
        return F.struct(F.coalesce(strip(said), F.lit("")).alias("evidenceText"), _cat(resource, ":", place).alias("sourceLocation"), F.lit("deterministic").alias("extractionMethod"), _cat(f"{self.artifact}:", resource).alias("sourceArtifact"))

    def whole(self, evidence: Column, resource: Column) -> Column:
        """Evidence of rules alone, made of what was carried."""
        return self._whole(evidence["said"], evidence["place"], resource) if self.told else evidence

    def node(self, key: Column, kind: str, inventory: str, attributes: Column, evidence: Column, status: Column | str = CURATED) -> Column:
        status = F.lit(status) if isinstance(status, str) else status
        return F.struct(key.alias("id"), F.lit(kind).alias("class"), F.lit(inventory).alias("inventory_id"), attributes.alias("attributes"), evidence.alias("evidence"), status.alias("curation_status"))

    def edge(self, relation: str, inventory: str, source: Column, target: Column, evidence: Column, attributes: Column | None = None):
        """A struct; of rules alone: relation, inventory id, and columns."""
        none = F.create_map().cast("map<string,string>")
        attributes = attributes if self.told else None
        if self.alone:
            return relation, inventory, [source.alias("source"), target.alias("target"), evidence.alias("evidence"), *([] if attributes is None else [attributes.alias("attributes")])]
        return F.struct(F.lit(relation).alias("relation"), F.lit(inventory).alias("inventory_id"), source.alias("source"), target.alias("target"), evidence.alias("evidence"), (none if attributes is None else attributes).alias("attributes"))

    def local(self) -> tuple[Column | None, Column | None, Column | None]:
        """Arrays of node mentions, edge mentions and skip reasons that a record gives by itself; None where no rule is asked for.
        Expressions are made for the rules that are asked for only: each costs time on the driver."""
        nodes, edges, skips = [], [], []
        r, filled = self.resource, lambda c: F.coalesce(c != "", F.lit(False))

        def one(name: str, when, build, to: list, kind: str) -> None:
            if self.alone and to is edges and self.wants(name):
                self.singles.append((None, when, lambda x, at: build(), None))
            elif self.wants(name):
                to.append(F.when(when(), F.array(build())).otherwise(F.array()).cast(kind))

        def skip(when, reason) -> None:
            if not self.reasons:
                return
            when, reason = when(), reason() if callable(reason) else reason
            skips.append(F.when(when, F.array(F.lit(reason) if isinstance(reason, str) else reason)).otherwise(F.array().cast("array<string>")))

        def each(name: str, field: str, build, to: list, kind: str, when=None, keep=None) -> None:
            """One mention a member of a list; keep filters members by what they hold."""
            if not self.wants(name):
                return
            if self.alone and to is edges:
                self.singles.append((field, when, build, keep))
                return
            rows = F.transform(F.coalesce(F.col(field), F.array()), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
            if keep is not None:
                rows = F.filter(rows, lambda s: keep(s["x"]))
            built = F.transform(rows, lambda s: build(s["x"], _cat(f"{field}[", s["i"].cast("string"), "]")))
            to.append((built if when is None else F.when(when(), built).otherwise(F.array())).cast(kind))

        kind, title = F.col("resource_type"), F.col("title")
        skip(lambda: ~F.coalesce(kind.isin(COMPOSITE, COLLECTION, TOOL), F.lit(False)), lambda: _cat("unknown_resource_type:", F.coalesce(none_if_empty(kind), F.lit("missing"))))
        own = lambda: _texts(resourceId=r, resourceType=kind, title=title, citation=F.col("citation"), abstract=F.col("abstract"), documentation=F.col("documentation"), language=F.col("language"), identifier=F.col("identifier"), url=F.col("url"))
        one("DatasetResource", lambda: F.lit(True), lambda: self.node(r, "DatasetResource", "A-D01", own(), self.evidence(_spaced([("title", json_text(title)), ("abstract", json_text(F.col("abstract")))]), "$")), nodes, _NODE)
        type_key, type_said = lambda: _cat("resource-type:", slugify(kind)), lambda: self.evidence(kind, "resource_type")
        one("ResourceType", lambda: filled(kind), lambda: self.node(type_key(), "ResourceType", "A-D02", _texts(label=kind), type_said()), nodes, _NODE)
        one("hasResourceType", lambda: filled(kind), lambda: self.edge("hasResourceType", "C-D01", r, type_key(), type_said()), edges, _EDGE)
        skip(lambda: ~filled(kind), "missing:resource_type")

        for field, relation, inventory in (("creators", "hasCreator", "C-D03"), ("contributors", "hasContributor", "C-DC05/A-AG")):
            each("Person", field, self._person, nodes, _NODE)

            def authored(p, at, relation=relation, inventory=inventory, field=field):
                order = F.when(p["creator_order"].isNotNull(), F.create_map(F.lit("creatorOrder"), p["creator_order"].cast("string"))) if field == "creators" else None
                key = ids.person_key(p["name"], self._known(p, f"{field[:-1]}_identifiers")) if self.alone else p["key"]
                return self.edge(relation, inventory, r, key["id"], self.evidence(p["name"], at), F.coalesce(order, F.create_map().cast("map<string,string>")) if order is not None else None)

            each(relation, field, authored, edges, _EDGE)
            has_org = lambda p: F.coalesce(p["organization"] != "", F.lit(False))
            org_said = lambda p, at: self.evidence(p["organization"], _cat(at, ".organization"))
            org_key = lambda p: p["org"]
            each("Organization", field, lambda p, at: self.node(org_key(p)["id"], "Organization", "A-AG02", _texts(name=p["organization"], identifierRegime=org_key(p)["regime"], ror=org_key(p)["ror"]), org_said(p, at)), nodes, _NODE, keep=has_org)
            each("affiliatedWith", field, lambda p, at: self.edge("affiliatedWith", "A-AG-R1", p["key"]["id"], org_key(p)["id"], org_said(p, at)), edges, _EDGE, keep=has_org)

        for field in ("identifier", "url"):
            value = F.col(field)
            new = lambda value=value, field=field: filled(value) if field == "identifier" else filled(value) & ~F.coalesce(value == F.col("identifier"), F.lit(False))
            said = lambda value=value, field=field: self.evidence(value, field)
            one("Identifier", new, lambda value=value, said=said: self.node(ids.identifier_key(value), "Identifier", "A-ID01", _texts(identifierValue=value, identifierType=F.lit("URL")), said()), nodes, _NODE)
            one("hasIdentifier", new, lambda value=value, said=said: self.edge("hasIdentifier", "C-D04", r, ids.identifier_key(value), said()), edges, _EDGE)

        statement, rights_url = F.col("rights.statement"), F.col("rights.url")
        licensed = lambda: F.col("rights").isNotNull() & (statement.isNotNull() | rights_url.isNotNull())
        license_said = lambda: self.evidence(F.coalesce(none_if_empty(statement), rights_url), "rights")
        license_key = lambda: ids.license_key(rights_url, statement)
        one("License", licensed, lambda: self.node(license_key(), "License", "A-D05", _texts(statement=statement, url=rights_url, spdxId=ids.spdx_of_url(rights_url)), license_said()), nodes, _NODE)
        one("hasLicense", licensed, lambda: self.edge("hasLicense", "C-D05", r, license_key(), license_said()), edges, _EDGE)

        each("Subject", "subjects", lambda s, at: self.node(ids.subject_key(s), "Subject", "A-D06", _texts(label=s), self.evidence(s, at)), nodes, _NODE)
        each("hasSubject", "subjects", lambda s, at: self.edge("hasSubject", "C-D06", r, ids.subject_key(s), self.evidence(s, at)), edges, _EDGE)

        for field, suffix, klass, inventory, relation, edge_inventory in (("spatial_coverage", ":spatial", "SpatialCoverage", "A-D07→A-DOM09", "hasSpatialCoverage", "C-D07"), ("temporal_coverage", ":temporal", "TemporalCoverage", "A-D08→A-DOM10", "coversPeriod", "C-D08")):
            if not self.wants(klass, relation):
                continue
            parts = [(n, F.col(f"{field}.{n}").cast("string") if n.endswith("limit") else json_text(F.col(f"{field}.{n}"))) for n in (("eastlimit", "northlimit", "projection", "southlimit", "type", "units", "westlimit") if field == "spatial_coverage" else ("end", "start"))]
            said, key = self.evidence(_spaced(parts), field), _cat(r, suffix)
            one(klass, lambda field=field: F.col(field).isNotNull(), lambda key=key, klass=klass, inventory=inventory, parts=parts, said=said: self.node(key, klass, inventory, F.create_map(*[x for n, v in parts for x in (F.lit(n), v)]), said), nodes, _NODE)
            one(relation, lambda field=field: F.col(field).isNotNull(), lambda key=key, relation=relation, edge_inventory=edge_inventory, said=said: self.edge(relation, edge_inventory, r, key, said), edges, _EDGE)

        award_key = lambda a: ids.award_key(a["funding_agency_name"], a["number"], a["title"])
        whole_award = lambda a: _spaced([(n, json_text(a[n])) for n in ("funding_agency_name", "funding_agency_url", "number", "title")])
        award_said = lambda a, at: self.evidence(F.coalesce(none_if_empty(a["title"]), none_if_empty(a["number"]), whole_award(a)), at)
        each("Award", "awards", lambda a, at: self.node(award_key(a), "Award", "A-D09", _texts(title=a["title"], number=a["number"], fundingAgencyName=a["funding_agency_name"], fundingAgencyUrl=a["funding_agency_url"]), award_said(a, at)), nodes, _NODE)
        each("fundedBy", "awards", lambda a, at: self.edge("fundedBy", "C-D09 / A-AG-R2", r, award_key(a), award_said(a, at)), edges, _EDGE)
        agency = lambda a: ids.organization_key(a["funding_agency_name"], a["funding_agency_url"])
        has_agency = lambda a: F.coalesce(a["funding_agency_name"] != "", F.lit(False))
        agency_said = lambda a, at: self.evidence(a["funding_agency_name"], _cat(at, ".funding_agency_name"))
        each("Organization", "awards", lambda a, at: self.node(agency(a)["id"], "Organization", "A-AG02", _texts(name=a["funding_agency_name"], identifierRegime=agency(a)["regime"], ror=agency(a)["ror"], url=a["funding_agency_url"]), agency_said(a, at)), nodes, _NODE, keep=has_agency)
        each("fundedBy", "awards", lambda a, at: self.edge("fundedBy", "A-AG-R2", award_key(a), agency(a)["id"], agency_said(a, at)), edges, _EDGE, keep=has_agency)

        composite, tool = lambda: F.coalesce(kind == COMPOSITE, F.lit(False)), lambda: F.coalesce(kind == TOOL, F.lit(False))
        whole_file = lambda f: _spaced([(n, json_text(f[n])) for n in ("checksum", "extension", "file_name", "file_path")])
        compact = lambda f: F.to_json(f, {"ignoreNullFields": "false"})
        file_key = lambda f: ids.file_key(r, f["file_path"], f["file_name"], compact(f))
        file_said = lambda f, at: self.evidence(F.coalesce(none_if_empty(f["file_name"]), whole_file(f)), at)
        each("DatasetFile", "files", lambda f, at: self.node(file_key(f), "DatasetFile", "A-D03", _texts(fileName=f["file_name"], filePath=f["file_path"], extension=f["extension"], checksum=f["checksum"]), file_said(f, at)), nodes, _NODE, composite)
        each("hasFile", "files", lambda f, at: self.edge("hasFile", "C-D02", r, file_key(f), file_said(f, at)), edges, _EDGE, composite)
        shown = lambda: F.coalesce(kind, F.lit("None"))
        skip(lambda: ~composite() & (F.size(F.coalesce(F.col("files"), F.array())) > 0), lambda: _cat("unexpected_files_for_type:", shown()))

        config, launch = F.col("tool_config"), F.col("tool_config.app_home_page_url")
        skip(lambda: ~tool() & config.isNotNull(), lambda: _cat("unexpected_tool_config_for_type:", shown()))
        configured = lambda: tool() & config.isNotNull()

        def descriptor() -> Column:
            name, version = F.coalesce(none_if_empty(title), F.lit(f"{self.service} tool")), none_if_empty(F.col("tool_config.tool_version"))
            return F.coalesce(_cat(name, ", v", version), name)

        def configuration() -> Column:
            listed = lambda c: F.to_json(F.col(f"tool_config.{c}"))
            texts = {"descriptor": descriptor(), "launchURL": launch} | {n: F.col(f"tool_config.{c}") for n, c in (("requestUrlBase", "request_url_base"), ("requestUrlBaseFile", "request_url_base_file"), ("toolVersion", "tool_version"), ("testingProtocolUrl", "testing_protocol_url"), ("toolIconUrl", "tool_icon_url"))}
            lists = F.create_map(F.lit("supportedFileExtensions"), listed("supported_file_extensions"), F.lit("supportedResourceTypes"), listed("supported_resource_types"), F.lit("supportedSharingStatus"), listed("supported_sharing_status"))
            return self.node(config_key(), "ToolConfiguration", "A-D10", F.map_concat(_texts(**texts), lists), config_said())

        config_key, config_said = lambda: _cat(r, ":tool-config"), lambda: self.evidence(descriptor(), "tool_config")
        one("ToolConfiguration", configured, configuration, nodes, _NODE)
        one("hasToolConfig", configured, lambda: self.edge("hasToolConfig", "C-D10", r, config_key(), config_said()), edges, _EDGE)
        launched, host = lambda: configured() & filled(launch), lambda: ids.authority(launch)
        launch_said = lambda: self.evidence(launch, "tool_config.app_home_page_url")
        one("Tool", launched, lambda: self.node(ids.tool_key(launch, title), "Tool", "A-DOM02", _texts(name=F.coalesce(none_if_empty(title), host()), launchURL=launch, host=host()), launch_said()), nodes, _NODE)
        one("launchesApp", launched, lambda: self.edge("launchesApp", "C-D11", config_key(), ids.tool_key(launch, title), launch_said()), edges, _EDGE)
        return _all(nodes), _all(edges), _all(skips)

    def geospatial(self) -> tuple[Column | None, Column | None, Column | None]:
        """Mentions of the geospatial relations, which come after other relations."""
        if self.alone:
            # addresses beside a target count only where it is empty, and so none of them can be it
            target = lambda g: F.coalesce(none_if_empty(g["target"]), ids.first_url(g["embedded_urls"]))
            said = lambda g, at: self.evidence(F.coalesce(none_if_empty(g["name"]), target(g)), at)
            build = lambda g, at: self.edge("referencesFeature", "C-D15", self.resource, _cat("hydrologic-feature:", slugify(target(g))), said(g, at), _texts(predicateQName=g["predicate_qname"]))
            self.singles.append(("geospatial_relations", None, build, lambda g: target(g).isNotNull()))
            return None, None, None
        rows = F.transform(F.coalesce(F.col("geospatial_relations"), F.array()), lambda g, i: F.struct(g.alias("g"), _cat("geospatial_relations[", i.cast("string"), "]").alias("at"), F.coalesce(none_if_empty(g["target"]), ids.first_url(ids.embedded_urls(g["target"], g["embedded_urls"]))).alias("target")))
        found = F.filter(rows, lambda s: s["target"].isNotNull())
        key = lambda s: _cat("hydrologic-feature:", slugify(s["target"]))
        said = lambda s: self.evidence(F.coalesce(none_if_empty(s["g"]["name"]), s["target"]), s["at"])
        nodes = edges = skips = None
        if self.wants("HydrologicFeature"):
            nodes = F.transform(found, lambda s: self.node(key(s), "HydrologicFeature", "A-DOM07", _texts(identifierValue=s["target"], name=s["g"]["name"], identifierRegime=F.lit("geoconnex-url")), said(s), REFERENCED)).cast(_NODE)
        if self.wants("referencesFeature"):
            edges = F.transform(found, lambda s: self.edge("referencesFeature", "C-D15", self.resource, key(s), said(s), _texts(predicateQName=s["g"]["predicate_qname"]))).cast(_EDGE)
        if self.reasons:
            skips = F.transform(F.filter(rows, lambda s: s["target"].isNull()), lambda s: F.lit("unresolved_geospatial_target"))
        return nodes, edges, skips

    def _known(self, p: Column, named: str) -> Column:
        """A person's own identifiers and those listed for the name."""
        listed = F.filter(F.coalesce(F.col(named), F.array().cast(_NAMED)), lambda i: (i["person_name"] == p["name"]) & (p["name"] != ""))
        return F.concat(F.coalesce(p["identifiers"], F.array().cast(_IDENT)), F.transform(listed, lambda i: F.struct(i["id_type"].alias("id_type"), i["url"].alias("url"))))

    def with_keys(self, records: DataFrame) -> DataFrame:
        """Records whose people carry their key, all known identifiers and the key of their organization, found once; each only
        where a rule that is asked for reads it."""
        for field, named, relation in (("creators", "creator_identifiers", "hasCreator"), ("contributors", "contributor_identifiers", "hasContributor")):
            if self.wants("Person", "Organization", relation, "affiliatedWith", "hasIdentifier"):
                records = records.withColumn(field, self._keyed(field, named))
        return records

    def _keyed(self, field: str, named: str) -> Column:
        def keyed(p: Column) -> Column:
            known = self._known(p, named)
            if self.wants("Person"):
                p = p.withField("known", known)
            if self.wants("Person", "hasCreator", "hasContributor", "affiliatedWith", "hasIdentifier"):
                p = p.withField("key", ids.person_key(p["name"], known))
            if self.wants("Organization", "affiliatedWith"):
                p = p.withField("org", ids.organization_key(p["organization"], F.lit(None).cast("string")))
            return p

        return F.transform(F.col(field), keyed)

    def _person(self, p: Column, at: Column) -> Column:
        key = p["key"]
        urls = F.filter(p["known"], lambda i: i["url"] != "")
        shown = F.array_sort(F.array_distinct(F.transform(urls, lambda i: F.to_json(F.struct(none_if_empty(i["id_type"]).alias("idType"), i["url"].alias("url"))))))
        attributes = F.map_concat(_texts(name=p["name"], identifierRegime=key["regime"], orcid=key["orcid"]), F.create_map(F.lit(f"{self.service}UserId"), json_text(p["user_id"]), F.lit("identifiers"), _cat("[", F.array_join(shown, ","), "]")))
        return self.node(key["id"], "Person", "A-AG01", attributes, self.evidence(p["name"], at))


def dataset_target(explicit: Column, target: Column, urls: Column) -> Column:
    """Id of the dataset that a relation means: given, in its target, or in the first address that has one."""
    in_urls = F.try_element_at(F.filter(F.transform(ids.embedded_urls(target, urls), lambda u: ids.resource_id(u)), lambda x: x.isNotNull()), F.lit(1))
    return F.coalesce(none_if_empty(explicit), ids.resource_id(target), in_urls)


def reference_parts(explicit: Column, target: Column, urls: Column) -> Column:
    """Struct dataset, said, first_url, doi: what of a reference is sought by patterns. To be a column of its own, so that each
    pattern is sought once and not in every branch of reference_target."""
    said = F.coalesce(strip(target), F.lit(""))
    first = F.try_element_at(ids.embedded_urls(target, urls), F.lit(1))
    return F.struct(dataset_target(explicit, target, urls).alias("dataset"), said.alias("said"), first.alias("first_url"), F.coalesce(ids.doi(said), ids.doi(first)).alias("doi"))


def reference_target(predicate: Column, parts: Column) -> Column:
    """Struct kind, id of what a reference means; both null if it cannot be told. Only the first address counts. parts: see
    reference_parts."""
    dataset, said, first, doi = (parts[c] for c in ("dataset", "said", "first_url", "doi"))
    place = _cat(ids.authority(first), "/", F.regexp_replace(ids.url_path(first), r"\A/+|/+\z", ""))
    rules = [
        ("dataset", dataset.isNotNull(), _cat("dataset:", dataset)),
        ("paper", doi.isNotNull(), _cat("paper:doi:", slugify(doi))),
        ("repository", F.coalesce(ids.is_repository_url(first), F.lit(False)), _cat("repository:", slugify(place))),
        ("external_dataset", first.isNotNull(), _cat("dataset:url:", short_hash(first, 20))),
        ("citation", (predicate == "hsterms:isDescribedBy") & (said != ""), _cat("paper:citation:", short_hash(said, 20))),
    ]
    found = None
    for name, rule, value in rules:
        told = F.struct(F.lit(name).alias("kind"), value.alias("id"))
        found = F.when(rule, told) if found is None else found.when(rule, told)
    return found


#: phase, relation, inventory id, fields in order, predicates
_RELATION_RULES = (
    (2, "hasMember", "C-D12", ("links", "typed_relations"), ("dcterms:hasPart",)),
    (3, "isMemberOf", "C-D13", ("links", "typed_relations"), ("dcterms:isPartOf",)),
    (4, "derivedFrom", "C-D14", ("typed_relations", "links"), DERIVATIONS),
    (5, "references", "C-D19", ("related_resources", "typed_relations"), REFERENCES),
    (7, "isExecutedBy", "C-D20", ("typed_relations", "related_resources", "relations_from_meta", "links"), (EXECUTED,)),
)


#: classes of the nodes that a relation's targets are
_TARGETS = {"hasMember": ("DatasetResource",), "isMemberOf": ("DatasetResource",), "derivedFrom": ("DatasetResource",), "references": ("DatasetResource", "Paper", "Repository"), "isExecutedBy": ("Tool",)}


def _asked(rules: Rules) -> list[str]:
    """Relations whose rules give an edge or a node that is asked for."""
    return [relation for _, relation, *_ in _RELATION_RULES if rules.wants(relation, *_TARGETS[relation])]


_RELATION_NODES = tuple(sorted({c for cs in _TARGETS.values() for c in cs}))

#: what the target of a relation can turn out to be
_CASES = {"hasMember": ("dataset",), "isMemberOf": ("dataset",), "derivedFrom": ("dataset",), "references": ("dataset", "paper", "repository", "external_dataset", "citation"), "isExecutedBy": ("own_tool", "tool", "outside_tool")}


def _each_of(rows: DataFrame, column: str, name: str, place: str | None = None) -> DataFrame:
    """One row a member of an array column, none for an empty one. An inner explode of a column makes Spark infer a filter that
    computes the whole array once more, and before rows are dealt out; an outer one does not. Members are never null."""
    others = [c for c in rows.columns if c != column]
    told = rows.select(*others, F.posexplode_outer(column).alias("_place", name)).filter(F.col("_place").isNotNull())
    return told.withColumnRenamed("_place", place) if place else told.drop("_place")


def _predicate(e: Column) -> Column:
    return F.coalesce(none_if_empty(e["predicate_qname"]), F.when(F.lower(strip(e["relation_label"])) == EXECUTED_LABEL, EXECUTED))


def _entries_alone(records: DataFrame, relation: str, service_fields: dict[str, str]) -> DataFrame:
    """_entries of one relation. Entries are rows before anything is made of them, so what is made is compiled."""
    phase, _, inventory, fields, predicates = next(r for r in _RELATION_RULES if r[1] == relation)
    def listed(rank: int, field: str) -> Column:
        return F.transform(F.coalesce(F.col(field), F.array().cast(_RELATION)), lambda e, i: F.struct(F.lit(rank).alias("field_rank"), i.alias("index"), e.alias("said")))

    es = F.concat(*[listed(rank, field) for rank, field in enumerate(fields)])
    es = F.when(F.col("resource_type") == COLLECTION, es) if relation == "hasMember" else es
    each = _each_of(records.select("resource_id", _with_id(es).alias("es")), "es", "e")
    rows = each.select("resource_id", F.lit(phase).alias("phase"), "e.field_rank", "e.index", _predicate(F.col("e.said")).alias("predicate"), F.col("e.said.target_resource_id").alias("explicit"), "e.said.target", F.col("e.said.embedded_urls").alias("urls"))
    rows = first_rows(rows.filter(F.col("predicate").isin(*predicates)), ["resource_id", "phase", "predicate", "explicit", "target"], ["field_rank", "index"])
    names = F.array(*[F.lit(service_fields.get(f, f)) for f in fields])
    return rows.select("*", F.lit(relation).alias("relation"), F.lit(inventory).alias("inventory"), _cat(F.element_at(names, F.col("field_rank") + 1), "[", F.col("index").cast("string"), "]").alias("at"))


def _entries(records: DataFrame, rules: Rules, service_fields: dict[str, str]) -> DataFrame:
    """One row a relation entry and rule that is asked for, the first of each key."""
    if rules.alone:
        return _entries_alone(records, *rules.only, service_fields)

    def asked(phase: int, relation: str, inventory: str, rank: int, field: str, predicates: tuple[str, ...]) -> Column:
        def row(e: Column, i: Column) -> Column:
            return F.struct(
                F.lit(phase).alias("phase"),
                F.lit(relation).alias("relation"),
                F.lit(inventory).alias("inventory"),
                F.lit(rank).alias("field_rank"),
                i.alias("index"),
                _cat(service_fields.get(field, field) + "[", i.cast("string"), "]").alias("at"),
                _predicate(e).alias("predicate"),
                e["target_resource_id"].alias("explicit"),
                e["target"].alias("target"),
                e["embedded_urls"].alias("urls"),
            )

        return F.filter(F.transform(F.coalesce(F.col(field), F.array()), row), lambda s: s["predicate"].isin(*predicates))

    asked = [asked(phase, relation, inventory, rank, field, predicates) for phase, relation, inventory, fields, predicates in _RELATION_RULES if relation in _asked(rules) for rank, field in enumerate(fields)]
    rows = _each_of(records.select("resource_id", "resource_type", F.concat(*asked).alias("es")), "es", "e").select("resource_id", "resource_type", "e.*")
    rows = rows.filter((F.col("relation") != "hasMember") | (F.col("resource_type") == COLLECTION))
    return first_rows(rows, ["resource_id", "phase", "predicate", "explicit", "target"], ["field_rank", "index"])


def _relations(records: DataFrame, rules: Rules, service_fields: dict[str, str]) -> tuple[DataFrame | None, DataFrame | None, DataFrame | None]:
    possible = {c for relation in _asked(rules) for c in _CASES[relation]}
    entries = _entries(records, rules, service_fields)
    if "own_tool" in possible:
        tool_target = F.coalesce(none_if_empty(F.col("explicit")), ids.resource_id(F.col("target")))
        wanted = F.when(F.col("relation") == "isExecutedBy", tool_target)
        wanted = wanted.otherwise(dataset_target(F.col("explicit"), F.col("target"), F.col("urls"))) if "dataset" in possible else wanted
    else:
        wanted = dataset_target(F.col("explicit"), F.col("target"), F.col("urls"))
    entries = entries.withColumn("wanted", wanted)
    if possible == {"dataset"}:  # nothing but what is said is sought in the target
        entries = entries.withColumn("parts", F.struct(F.coalesce(strip(F.col("target")), F.lit("")).alias("said")))
    else:
        entries = entries.withColumn("parts", reference_parts(F.col("explicit"), F.col("target"), F.col("urls"))).withColumn("first", F.col("parts.first_url"))
    if "paper" in possible:
        entries = entries.withColumn("found", reference_target(F.col("predicate"), F.col("parts")))
    if possible & {"repository", "outside_tool"}:
        entries = entries.withColumn("host", ids.authority(F.col("first"))).withColumn("repo_path", F.regexp_replace(ids.url_path(F.col("first")), r"\A/+|/+\z", ""))
    # an entry without a target is shown whole
    whole = _spaced([("predicate_qname", json_text(F.col("predicate"))), ("target", json_text(F.col("target"))), ("target_resource_id", json_text(F.col("explicit"))), ("embedded_urls", F.to_json("urls"))])
    entries = entries.withColumn("shown", F.coalesce(none_if_empty(F.col("parts.said")), whole))
    if rules.wants("isExecutedBy", *_RELATION_NODES):
        tools = [F.col("title").alias("known_title"), F.coalesce("tool_config.app_home_page_url", F.lit("")).alias("known_launch")] if "own_tool" in possible else []
        corpus = records.select(F.col("resource_id").alias("known_id"), F.col("resource_type").alias("known_type"), *tools)
        if rules.alone:  # whether a target that is no tool is in the corpus is told of nodes only
            corpus = corpus.filter(F.col("known_type") == TOOL)
        rows = entries.join(corpus, F.col("wanted") == F.col("known_id"), "left")
    else:  # an edge to a dataset has its id as target, in the corpus or not
        rows = entries
    refers, executes, wanted = F.col("relation") == "references", F.col("relation") == "isExecutedBy", F.col("wanted")
    told = {
        "own_tool": lambda: executes & F.coalesce(F.col("known_type") == TOOL, F.lit(False)),
        "tool": lambda: executes & wanted.isNotNull(),
        "outside_tool": lambda: executes & F.col("first").isNotNull(),
        "dataset": lambda: ~executes & wanted.isNotNull(),
    }
    whens = [F.when(when(), name) for name, when in told.items() if name in possible]
    case = F.coalesce(*whens, *([F.when(refers, F.nullif(F.col("found.kind"), F.lit("dataset")))] if "paper" in possible else []))
    rows = rows.withColumn("case", case)
    shown, own = F.col("shown"), F.col("case") == "own_tool"
    title, launch, host, first, said_doi = F.col("known_title"), F.col("known_launch"), F.col("host"), F.col("first"), F.col("parts.doi")
    keys = {
        "own_tool": lambda: ids.tool_key(launch, title),
        "tool": lambda: _cat(f"tool:{rules.service}:", wanted),
        "outside_tool": lambda: _cat("tool:url:", short_hash(first, 20)),
        "dataset": lambda: wanted,
        "paper": lambda: _cat("paper:doi:", slugify(said_doi)),
        "repository": lambda: _cat("repository:url:", slugify(_cat(host, "/", F.col("repo_path")))),
        "external_dataset": lambda: _cat("dataset:url:", short_hash(first, 20)),
        "citation": lambda: _cat("paper:citation:", short_hash(shown, 20)),
    }
    key = F.coalesce(*[F.when(F.col("case") == name, build()) for name, build in keys.items() if name in possible])
    ordered = F.struct("resource_id", "phase", F.col("field_rank").alias("rank"), F.col("index").alias("place"))
    nodes = edges = reasons = None
    if rules.alone:
        # an array of one or none: a filter would seek all patterns once more
        said = F.struct(key.alias("target"), rules.evidence(shown, F.col("at")).alias("evidence"), _texts(predicateQName=F.col("predicate")).alias("attributes"), ordered.alias("ord"))
        found = rows.select("resource_id", F.when(F.col("case").isNotNull(), F.array(said)).alias("ms"))
        return None, _each_of(found, "ms", "m").select(F.col("resource_id").alias("source"), "m.*"), None
    hit = rows.filter(F.col("case").isNotNull()).withColumn("ord", ordered)
    if rules.wants(*_RELATION_NODES):
        nodes = _relation_nodes(hit, rules, key, possible)
    if rules.wants(*_TARGETS):
        here = rules.evidence(shown, F.col("at"))
        edges = hit.select("relation", F.col("inventory").alias("inventory_id"), F.col("resource_id").alias("source"), key.alias("target"), here.alias("evidence"), _texts(predicateQName=F.col("predicate")).alias("attributes"), "ord")
    if rules.reasons:
        reasons = rows.filter(F.col("case").isNull()).select(_unresolved(refers, executes).alias("reason"))
    return nodes, edges, reasons


def _unresolved(refers: Column, executes: Column) -> Column:
    """Why a relation entry gives no edge."""
    return (
        F.when(refers, _cat("deferred_to_llm:reference_target:", F.col("predicate")))
        .when(executes, F.lit("deferred_to_llm:isExecutedBy_target"))
        .when(F.col("relation") == "derivedFrom", _cat("unresolved_derivedFrom_target:", F.col("predicate")))
        .otherwise(_cat("unresolved_", F.col("relation"), "_target"))
    )


def _relation_nodes(hit: DataFrame, rules: Rules, key: Column, possible: set[str]) -> DataFrame:
    """Mentions of the targets of relations, from entries whose case is known."""
    none = F.lit(None).cast("string")
    have = lambda c, case: c if case in possible else none
    wanted, shown, case, own = F.col("wanted"), F.col("shown"), F.col("case"), F.col("case") == "own_tool"
    launch, title = have(F.col("known_launch"), "own_tool"), have(F.col("known_title"), "own_tool")
    first = F.col("first") if "first" in hit.columns else none
    host, path = (F.col(c) if c in hit.columns else none for c in ("host", "repo_path"))
    tools, cited = case.isin("tool", "outside_tool"), case.isin("dataset", "paper", "repository", "external_dataset", "citation")
    outside = case.isin("outside_tool", "repository", "external_dataset")
    regime = {"own_tool": f"{rules.service}-tool-resource", "tool": f"{rules.service}-resource-id", "dataset": f"{rules.service}-resource-id", "outside_tool": "external-url", "external_dataset": "external-url", "repository": "repository-url", "paper": "DOI", "citation": "citation-text"}
    klass = {"own_tool": "Tool", "tool": "Tool", "outside_tool": "Tool", "dataset": "DatasetResource", "external_dataset": "DatasetResource", "paper": "Paper", "citation": "Paper", "repository": "Repository"}
    inventory = {"Tool": "A-DOM02", "DatasetResource": "A-D01", "Paper": "A-P01", "Repository": "A-C01"}
    named = lambda table: F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), case)
    attributes = _texts(
        name=F.when(own, title).when(tools, shown),
        launchURL=F.when(own, launch),
        host=F.when(own & (launch != ""), ids.authority(launch)).when(outside, host),
        identifierRegime=named(regime),
        resourceId=F.when(case == "dataset", wanted),
        url=F.when(outside, first),
        path=F.when(case == "repository", path),
        doi=F.when(case == "paper", have(F.col("parts.doi"), "paper")),
        citation=F.when(cited, shown),
        **{f"{rules.service}ResourceId": F.when(case.isin("own_tool", "tool"), wanted)},
    )
    status = F.when(own | (case.isin("tool", "dataset") & F.col("known_id").isNotNull()), CURATED).otherwise(REFERENCED)
    told = rules.evidence(
        F.when(own, F.coalesce(none_if_empty(launch), title)).otherwise(shown),
        F.when(own, F.when(launch != "", "tool_config.app_home_page_url").otherwise("title")).otherwise(F.col("at")),
        F.when(own, wanted).otherwise(F.col("resource_id")),
    )
    node = rules.node(key, "", "", attributes, told, status).withField("class", named(klass)).withField("inventory_id", named({c: inventory[k] for c, k in klass.items()}))
    return hit.select(node.cast(_NODE[6:-1]).alias("node"), "ord").select("node.*", "ord")


def _person_identifiers(records: DataFrame, rules: Rules) -> tuple[DataFrame | None, DataFrame | None, DataFrame | None]:
    """Identifiers of people, and the edges from the person that was first mentioned under the name until then.

    A person's name is the first one given; once another is given for the same person, the name matches no more."""
    def listed(rank: int, field: str) -> Column:
        all_ = F.coalesce(F.col(field), F.array().cast(_NAMED))

        def row(i: Column, k: Column) -> Column:
            same = F.filter(all_, lambda x: (x["person_name"] == i["person_name"]) & (i["person_name"] != ""))
            fallback = ids.person_key(i["person_name"], F.transform(same, lambda x: F.struct(x["id_type"].alias("id_type"), x["url"].alias("url"))))["id"]
            return F.struct(F.lit(rank).alias("rank"), k.alias("place"), _cat(f"{field}[", k.cast("string"), "]").alias("at"), i.alias("i"), fallback.alias("fallback"))

        return F.transform(all_, row)

    fields = [listed(rank, field) for rank, field in enumerate(("creator_identifiers", "contributor_identifiers"))]
    rows = _each_of(records.select("resource_id", F.concat(*fields).alias("es")), "es", "e").select("resource_id", F.struct("resource_id", F.lit(1).alias("phase"), "e.rank", "e.place").alias("ord"), "e.at", "e.i.*", "e.fallback")
    known, value = F.coalesce(F.col("id_type").isin(*PERSON_IDENTIFIERS), F.lit(False)), none_if_empty(F.col("url"))
    orcid = F.when(F.col("id_type") == "ORCID", ids.orcid(F.col("url")))
    bad = (
        F.when(~known, _cat("unmapped_person_identifier:", F.coalesce(none_if_empty(F.col("id_type")), F.lit("unknown"))))
        .when(value.isNull(), _cat("invalid_person_identifier:", F.col("id_type")))
        .when((F.col("id_type") == "ORCID") & orcid.isNull(), F.lit("invalid_orcid_identifier"))
    )
    rows = rows.withColumn("bad", bad).withColumn("orcid", orcid)
    good = rows.filter(F.col("bad").isNull())
    said = rules.evidence(F.col("url"), F.col("at"))
    key = ids.identifier_key(F.col("url"))
    element = _NODE[6:-1]
    nodes = edges = reasons = None
    if rules.wants("Identifier"):
        nodes = good.select(rules.node(key, "Identifier", "A-ID01", _texts(identifierValue=F.col("url"), identifierType=F.col("id_type"), normalizedValue=F.col("orcid")), said).cast(element).alias("n"), "ord").select("n.*", "ord")
    if rules.wants("hasIdentifier"):
        edges = _person_edges(records, good, key, said)
    if rules.reasons:
        reasons = rows.filter(F.col("bad").isNotNull()).select(F.col("bad").alias("reason"))
    return nodes, edges, reasons


def _person_edges(records: DataFrame, good: DataFrame, key: Column, said: Column) -> DataFrame:
    named = [F.transform(F.coalesce(F.col(field), F.array()), lambda p: F.struct(p["key"]["id"].alias("id"), p["name"].alias("name"))) for field in ("creators", "contributors")]
    stated = _each_of(records.select("resource_id", F.concat(*named).alias("ps")), "ps", "p", "place").select("p.*", F.struct("resource_id", F.lit(0).alias("phase"), F.lit(0).alias("rank"), "place").alias("ord"))
    # each name of a person once, so that those whom many records name are few rows
    stated = stated.groupBy("id", "name").agg(F.min("ord").alias("ord"))
    named = F.min(F.when(F.col("name").isNotNull(), F.struct("ord", "name"))).over(Window.partitionBy("id"))
    until = F.min(F.when(F.col("name") != F.col("named.name"), F.col("ord")))
    valid = stated.withColumn("named", named).groupBy("id").agg(F.min("ord").alias("since"), F.min("named").alias("named"), until.alias("until"))
    valid = valid.select(F.col("id").alias("person"), "since", F.col("named.name").alias("valid_name"), F.coalesce("named.ord", "since").alias("from"), "until")
    # of people who have had one name alone from the start, the first to bear it comes before all others, wherever they match
    alone = F.col("until").isNull() & (F.col("from") == F.col("since"))
    valid = valid.groupBy("valid_name", F.when(~alone, F.col("person")).alias("_other")).agg(F.min(F.struct("since", "person", "from", "until")).alias("_")).select("valid_name", "_.*")
    # people without a name match rows without one
    joined = good.join(valid, good["person_name"].eqNullSafe(valid["valid_name"]) & (valid["from"] < good["ord"]) & (valid["until"].isNull() | (valid["until"] > good["ord"])), "left")
    picked = joined.groupBy(*good.columns).agg(F.min_by("person", "since").alias("person"))
    none = F.create_map().cast("map<string,string>")
    return picked.select(F.lit("hasIdentifier").alias("relation"), F.lit("A-ID01 (ID-R1)").alias("inventory_id"), F.coalesce("person", "fallback").alias("source"), key.alias("target"), said.alias("evidence"), none.alias("attributes"), "ord")


def _mentions(records: DataFrame, rules: Rules, handled: tuple[str, ...] = (), field_names: dict[str, str] | None = None) -> tuple[DataFrame | None, DataFrame | None, DataFrame | None]:
    """Mentions of nodes and of edges that the rules asked for give (None: no rule), and the reasons of what is skipped (None: only
    some rules are asked for)."""
    required = records.withColumn("resource_id", F.when(F.col("resource_id") != "", F.col("resource_id")).otherwise(F.raise_error(F.lit("a record has no resource_id")).cast("string")))
    required = rules.with_keys(required)
    nodes, edges, skips = rules.local()
    geo = rules.wants("HydrologicFeature", "referencesFeature")
    geo_nodes, geo_edges, geo_skips = rules.geospatial() if geo else (None, None, None)
    known = {f.split()[0] for f in ("resource_id resource_type title abstract citation documentation language identifier url creators contributors creator_identifiers contributor_identifiers rights subjects spatial_coverage temporal_coverage awards files tool_config links typed_relations related_resources relations_from_meta geospatial_relations").split()} | set(handled)
    reasons = None
    if rules.reasons:
        spare = [F.when(F.coalesce(~F.col(f.name).cast("string").isin("", "[]", "{}"), F.lit(False)), _cat("unmapped_top_level_field:", F.coalesce(none_if_empty(F.col("resource_type")), F.lit("unknown")), f":{f.name}")) for f in records.schema.fields if f.name not in known]
        spare = F.filter(F.array(*spare), lambda x: x.isNotNull()) if spare else F.array().cast("array<string>")
        reasons = required.select(F.explode(F.concat(skips, geo_skips, spare)).alias("reason"))

    def mentions(column: Column | None, phase) -> DataFrame | None:
        if column is None:
            return None
        # a column first: what stands inside of explode is not compiled
        rows = _each_of(required.select("resource_id", column.alias("ms")), "ms", "m", "place").select("m.*", "resource_id", "place")
        at = F.struct("resource_id", F.lit(phase).alias("phase") if isinstance(phase, int) else phase(rows).alias("phase"), F.lit(0).alias("rank"), "place")
        return rows.withColumn("ord", at).drop("resource_id", "place")

    # agents come first, their identifiers next (phase 1), the other local mentions after
    early = lambda rows: F.when(F.col("class").isin("DatasetResource", "ResourceType", "Person") | ((F.col("class") == "Organization") & ~F.contains("evidence.sourceLocation", F.lit(":awards["))), 0).otherwise(1)
    told_nodes, told_edges = [mentions(nodes, lambda rows: early(rows) * 1)], [mentions(edges, 0)]
    if geo:
        told_nodes.append(mentions(geo_nodes, 6))
        told_edges.append(mentions(geo_edges, 6))
    further = [_person_identifiers(required, rules)] if rules.wants("Identifier", "hasIdentifier") else []
    if _asked(rules):
        further.append(_relations(required, rules, field_names or {}))
    for more_nodes, more_edges, more_reasons in further:
        told_nodes.append(more_nodes)
        told_edges.append(more_edges)
        reasons = _union([reasons, more_reasons])
    return _union(told_nodes), _union(told_edges), reasons


#: Relations that one extraction each finds by its rules alone.
ALONE = ("references", "isExecutedBy", "hasCreator", "hasLicense", "hasContributor", "hasMember", "hasResourceType", "hasFile", "isMemberOf", "hasSubject", "launchesApp", "hasSpatialCoverage", "hasToolConfig", "fundedBy", "referencesFeature")


def _with_id(value: Column) -> Column:
    """value of a record, which must have an id."""
    return F.when(F.col("resource_id") != "", value).otherwise(F.raise_error(F.lit("a record has no resource_id")))


def _edges_alone(records: DataFrame, rules: Rules, field_names: dict[str, str]) -> DataFrame:
    """The edges of one relation. Members of lists are rows before anything is made of them, so that it is compiled, and mentions
    are merged where records of one id lie, if they are dealt by it. Evidence is carried without what follows from the record.
    Records without mentions go by an outer explode, since a filter would compute what it tests where a small file is one task."""
    merged: dict[tuple[str, str], DataFrame] = {}

    def add(relation: str, inventory: str, rows: DataFrame) -> None:
        merged[relation, inventory] = _union([merged.get((relation, inventory)), rows])

    if rules.only.issubset(_TARGETS):
        (relation,) = rules.only
        add(relation, next(r[2] for r in _RELATION_RULES if r[1] == relation), _relations(records, rules, field_names)[1])
    elif rules.wants("referencesFeature"):
        rules.geospatial()
    else:
        rules.local()
    for rank, (field, when, build, keep) in enumerate(rules.singles):
        relation, inventory, columns = build(F.col("x"), _cat(f"{field}[", F.col("place").cast("string"), "]"))
        listed = F.col(field) if field else F.array(F.struct(*columns[1:]))
        rows = _each_of(records.withColumn("_x", _with_id(listed if when is None else F.when(when(), listed))), "_x", "x", "place")
        if keep is not None:
            rows = rows.filter(keep(F.col("x")))
        told = columns if field else [columns[0], "x.*"]
        add(relation, inventory, rows.select(*told, F.struct("resource_id", F.lit(rank).alias("rank"), "place").alias("ord")))

    def finished(relation: str, inventory: str, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in ("source", "target")]
        first = rows.groupBy("source", "target").agg(F.min_by(F.struct(*rest), "ord").alias("first"))
        key = edge_id(F.col("source"), F.lit(relation), F.col("target"), F.lit(inventory))
        attributes = F.col("first.attributes") if "attributes" in rest else F.create_map().cast("map<string,string>")
        evidence = rules.whole(F.col("first.evidence"), F.col("first.ord.resource_id"))
        return first.select(key.alias("id"), F.lit(relation).alias("relation"), F.lit(inventory).alias("inventory_id"), "source", "target", evidence.alias("evidence"), attributes.alias("attributes"))

    return _union([finished(*names, rows) for names, rows in merged.items()])


def extract(records: DataFrame, artifact: str = "dataset", service: str = "service", handled: tuple[str, ...] = (), field_names: dict[str, str] | None = None) -> Graph:
    """The graph of dataset records (see RECORD). Columns beyond RECORD that hold something are told as skipped."""
    nodes, edges, reasons = _mentions(records, Rules(artifact, service), handled, field_names)
    return Graph(merge_nodes(nodes).drop("ord"), merge_edges(edges).drop("ord"), histogram(reasons, "reason"))


def extract_edges(records: DataFrame, *relations: str, artifact: str = "dataset", service: str = "service", field_names: dict[str, str] | None = None, told: bool = True) -> DataFrame:
    """The edges of some relations of the graph (none named: of all), by their rules alone. Without told they carry neither
    evidence nor attributes, for counts and patterns."""
    only = frozenset(relations) or frozenset(RELATIONS)
    if len(only) == 1 and only.issubset(ALONE):
        return _edges_alone(records, Rules(artifact, service, only, told, alone=True), field_names or {})
    return merge_edges(_mentions(records, Rules(artifact, service, only, told), field_names=field_names)[1].filter(F.col("relation").isin(*only))).drop("ord")


def extract_nodes(records: DataFrame, *classes: str, artifact: str = "dataset", service: str = "service", field_names: dict[str, str] | None = None) -> DataFrame:
    """The nodes of some classes of the graph, by the rules that state them alone. Mentions of one id must be of one class, as
    they are unless a record's own id looks like the key of another class."""
    return merge_nodes(_mentions(records, Rules(artifact, service, frozenset(classes)), field_names=field_names)[0].filter(F.col("class").isin(*classes))).drop("ord")
