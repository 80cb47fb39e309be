"""Catalogue: dataset records made from customers, which take every rule, and each class and relation of their graph row by
row: ids, attributes, evidence and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .extraction import READS, RECORD, Graph, extract, extract_edges, extract_nodes
from .registry import query
from .star import read

CC = "https://creativecommons.org/licenses/by/4.0/"
RUN = "The content of this resource can be executed by"


def _cat(*xs) -> Column:
    return F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs])


def _rid(k: Column) -> Column:
    return F.lpad(F.lower(F.hex(k)), 32, "0")


def records(spark: SparkSession, sf: str, *fields: str) -> DataFrame:
    """One record a customer; what its key leaves after division decides its kind and which fields it fills. fields: those to make
    beside the id (none: all)."""
    k, n, name, segment = F.col("c_custkey"), F.col("c_nationkey"), F.col("c_name"), F.col("c_mktsegment")
    empty = spark.createDataFrame([], RECORD)
    none = F.lit(None).cast("string")
    left = lambda by, *rests: (k % by).isin(*rests)

    def struct(of: str, **given) -> Column:
        kind = empty.schema[of].dataType
        kind = getattr(kind, "elementType", kind)
        return F.struct(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kind.fields])

    def some(*whens: tuple[Column, Column]) -> Column:
        return F.concat(*[F.when(when, F.array(row)).otherwise(F.array()) for when, row in whens])

    def relation(predicate: str | None, explicit: Column = none, target: Column = none, urls: Column | None = None, label: str | None = None) -> Column:
        return struct("links", predicate_qname=F.lit(predicate), relation_label=F.lit(label), target_resource_id=explicit, target=target, embedded_urls=urls if urls is not None else F.array())

    orcid = lambda: F.format_string("https://orcid.org/0000-0001-%04d-%04d", (k / 10_000).cast("int"), (k % 10_000).cast("int"))
    ident = lambda: F.when(left(3, 0), F.array(F.struct(F.lit("ORCID").alias("id_type"), orcid().alias("url"))))
    given = {
        "resource_id": lambda: _rid(k),
        "resource_type": lambda: F.when(left(50, 8), none).when(left(50, 7), "Odd").when(left(3, 0), "CompositeResource").when(left(3, 1), "CollectionResource").otherwise("ToolResource"),
        "title": lambda: F.when(~left(11, 0), _cat("Title ", k)),
        "abstract": lambda: F.when(left(2, 0), _cat("Abs ", k)),
        "language": lambda: F.lit("en"),
        "identifier": lambda: F.when(left(4, 0), _cat("http://id.org/", k)),
        "url": lambda: F.when(left(8, 0), _cat("http://id.org/", k)).when(left(4, 0, 1), _cat("http://u.org/", k)),
        "creators": lambda: F.array(struct("creators", name=name, creator_order=F.lit(1), user_id=k.cast("string"), organization=_cat("Org ", n), identifiers=ident())),
        "contributors": lambda: F.array(struct("contributors", name=_cat("Helper ", n))),
        "creator_identifiers": lambda: some(
            (left(6, 0), struct("creator_identifiers", person_name=name, id_type=F.lit("GoogleScholarID"), url=_cat("http://s/", k))),
            (left(6, 1), struct("creator_identifiers", person_name=name, id_type=F.lit("ORCID"), url=F.lit("bad"))),
            (left(6, 2), struct("creator_identifiers", person_name=name, id_type=F.lit("Other"), url=F.lit("x"))),
            (left(6, 4), struct("creator_identifiers", person_name=_cat("Nobody ", k), id_type=F.lit("ResearchGateID"), url=_cat("http://rg/", k))),
        ),
        "rights": lambda: F.when(left(3, 0), struct("rights", statement=F.lit("CC"), url=F.lit(CC))).when(left(3, 1), struct("rights", statement=_cat("Lic ", n))).otherwise(struct("rights", url=_cat("http://lic.org/", n))),
        "subjects": lambda: F.array(segment, F.lower(segment)),
        "spatial_coverage": lambda: F.when(left(5, 0), struct("spatial_coverage", eastlimit=k + 0.5, type=F.lit("box"))),
        "temporal_coverage": lambda: F.when(left(5, 1), struct("temporal_coverage", start=_cat("20", n))),
        "awards": lambda: F.when(left(7, 0), F.array(struct("awards", title=_cat("Award ", n), number=_cat("N ", n), funding_agency_name=_cat("Agency ", n % 3), funding_agency_url=F.when(n % 2 == 0, _cat("https://ror.org/0abcdef0", n % 3))))),
        "files": lambda: F.when(left(3, 0) & ~left(50, 7, 8), F.array(struct("files", file_name=F.lit("a.csv"), file_path=F.lit("data/a.csv"), extension=F.lit(".csv"), checksum=F.md5(k.cast("string"))), struct("files", file_name=_cat("b ", k, ".txt")))).when(left(9, 1), F.array(struct("files", file_name=F.lit("x")))),
        "tool_config": lambda: F.when(left(3, 2) | left(9, 3), struct("tool_config", app_home_page_url=_cat("https://app", n, ".org/run/", k), tool_version=F.when(left(2, 0), _cat("1.", k % 4)), supported_file_extensions=F.when(left(2, 0), F.array(F.lit(".nc"))))),
        "links": lambda: some((left(12, 1) & (k > 1), relation("dcterms:hasPart", explicit=_rid(k - 1), target=_cat("part of ", k))), (left(12, 7), relation("dcterms:hasPart", target=F.lit("nothing")))),
        "typed_relations": lambda: some(
            (left(4, 3), relation("dcterms:isPartOf", target=_cat("http://s.org/resource/", _rid(k - 2)))),
            (left(10, 1), relation("prov:wasDerivedFrom", explicit=_rid(k + 1_000_000))),
            (left(10, 2), relation("dcterms:references", target=_cat("doi:10.1234/Q", n, "."))),
            (left(10, 3), relation("dcterms:source", target=F.lit("see"), urls=F.array(_cat("https://github.com/o/r", n, "/"), F.lit("http://z.org")))),
            (left(10, 4), relation("dcterms:references", target=_cat("http://data.org/", n))),
            (left(10, 5), relation("hsterms:isDescribedBy", target=_cat("Someone (", k, ")"))),
            (left(10, 6), relation("dcterms:requires", target=F.lit("plain"))),
            (left(10, 7) & (k > 5), relation("hsterms:isExecutedBy", explicit=_rid(k - 1 - k % 3), target=_cat("by ", k))),
            (left(10, 8), relation("hsterms:isExecutedBy", explicit=_rid(k + 1_000_000), target=_cat("Tool text ", k))),
        ),
        "related_resources": lambda: some((left(10, 2), relation("dcterms:references", target=_cat("doi:10.1234/Q", n, ".")))),
        "relations_from_meta": lambda: some((left(10, 9), relation(None, target=F.lit("https://tool.org/run"), label=RUN))),
        "geospatial_relations": lambda: some((left(10, 0), struct("geospatial_relations", name=_cat("Gage ", n), target=_cat("https://geo.org/", n), predicate_qname=F.lit("hsterms:relation"))), (left(10, 1), struct("geospatial_relations", name=F.lit("none")))),
    }
    # a small file is one task; the rules are work for all, and what they find of a record meets where the record lies
    return read(spark, sf, "customer").repartition(_rid(k)).select(*[given.get(f.name, lambda: F.lit(None))().cast(f.dataType).alias(f.name) for f in empty.schema.fields if not fields or f.name in ("resource_id", *fields)])


def graph(spark: SparkSession, sf: str) -> Graph:
    return extract(records(spark, sf))


def _object(attributes: str = "attributes") -> Column:
    return F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(attributes), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"])), ","), F.lit("}"))



def _told() -> list[Column]:
    return [F.col(f"evidence.{a}").alias(b) for a, b in (("evidenceText", "said"), ("sourceLocation", "place"), ("extractionMethod", "method"), ("sourceArtifact", "artifact"))]


# SQL: one row a record; the same divisions as above
_C = f"""c AS (SELECT c_custkey AS k, c_nationkey AS n, c_name AS name, c_mktsegment AS seg, format('{{:032x}}', c_custkey) AS rid,
  CASE WHEN k % 50 = 8 THEN NULL WHEN k % 50 = 7 THEN 'Odd' WHEN k % 3 = 0 THEN 'CompositeResource' WHEN k % 3 = 1 THEN 'CollectionResource' ELSE 'ToolResource' END AS kind,
  CASE WHEN k % 11 <> 0 THEN 'Title ' || k END AS title, CASE WHEN k % 2 = 0 THEN 'Abs ' || k END AS abstract,
  CASE WHEN k % 4 = 0 THEN 'http://id.org/' || k END AS identifier, CASE WHEN k % 8 = 0 THEN 'http://id.org/' || k WHEN k % 4 < 2 THEN 'http://u.org/' || k END AS url,
  CASE WHEN k % 3 = 0 THEN format('0000-0001-{{:04d}}-{{:04d}}', k // 10000, k % 10000) END AS orcid,
  CASE WHEN k % 3 = 0 THEN 'person:orcid:' || format('0000-0001-{{:04d}}-{{:04d}}', k // 10000, k % 10000) ELSE 'person:name:' || regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g') END AS person,
  'https://app' || n || '.org/run/' || k AS launch, CASE WHEN k % 2 = 0 THEN '1.' || k % 4 END AS version,
  'https://app' || n || '.org' AS app FROM customer)"""


def _j(value: str) -> str:
    return f"CAST(to_json({value}) AS VARCHAR)"


def _obj(**fields: str) -> str:
    """JSON text of an object from SQL for the JSON text of its fields; those that are null are left out."""
    parts = ", ".join(f"""'"{f}":' || {v}""" for f, v in sorted(fields.items()))
    return f"'{{' || concat_ws(',', {parts or 'NULL'}) || '}}'"


def _quoted(**fields: str) -> str:
    return _obj(**{f: _j(v) for f, v in fields.items()})


def _node(of: str, kind: str, inventory: str, key: str, attributes: str, said: str, at: str, status: str = "curated", rid: str = "rid") -> str:
    return f"""SELECT {key} AS id, '{kind}' AS class, '{inventory}' AS inventory_id, {attributes} AS attributes, {said} AS said, {rid} || ':' || {at} AS place, 'deterministic' AS method, 'dataset:' || {rid} AS artifact, '{status}' AS curation_status FROM {of}"""


_NODES: dict[str, list[str]] = {}
# what other records say of a record: the parts of a collection, and what a record is part of
_REFERRED = f"""ref AS (
  SELECT k - 1 AS j, 'part of ' || k AS shown FROM c WHERE k % 12 = 1 AND k > 1 AND kind = 'CollectionResource'
  UNION ALL SELECT k - 2, 'http://s.org/resource/' || format('{{:032x}}', k - 2) FROM c WHERE k % 4 = 3),
cited AS (SELECT j, CASE count(DISTINCT {_j('shown')}) WHEN 1 THEN min({_j('shown')}) ELSE '[' || array_to_string(list_sort(list_distinct(list({_j('shown')}))), ',') || ']' END AS citation FROM ref GROUP BY j)"""
_derived = """'{"embedded_urls": [], "predicate_qname": "prov:wasDerivedFrom", "target": null, "target_resource_id": "' || format('{:032x}', k + 1000000) || '"}'"""
_far = "format('{:032x}', k + 1000000)"
_first = lambda where, by: f"(SELECT * FROM c WHERE {where} QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY k) = 1)"
_NODES["DatasetResource"] = [
    _node(
        "c LEFT JOIN cited ON j = k", "DatasetResource", "A-D01", "rid",
        _obj(resourceId=_j("rid"), resourceType=_j("kind"), title=_j("title"), abstract=_j("abstract"), language=_j("'en'"), identifier=_j("identifier"), url=_j("url"), citation="citation", identifierRegime="CASE WHEN citation IS NOT NULL THEN '\"service-resource-id\"' END"),
        f"""'{{"abstract": ' || coalesce({_j('abstract')}, 'null') || ', "title": ' || coalesce({_j('title')}, 'null') || '}}'""", "'$'",
    ),
    _node("(SELECT * FROM ref WHERE j NOT IN (SELECT k FROM c))", "DatasetResource", "A-D01", "format('{:032x}', j)", _quoted(resourceId="format('{:032x}', j)", identifierRegime="'service-resource-id'", citation="shown"), "shown", "'typed_relations[0]'", "referenced", "format('{:032x}', j + 2)"),
    _node("c WHERE k % 10 = 1", "DatasetResource", "A-D01", _far, _quoted(resourceId=_far, identifierRegime="'service-resource-id'", citation=_derived), _derived, "'typed_relations[' || (CASE WHEN k % 4 = 3 THEN 1 ELSE 0 END) || ']'", "referenced"),
    _node(_first("k % 10 = 4", "n"), "DatasetResource", "A-D01", "'dataset:url:' || substr(sha256('http://data.org/' || n), 1, 20)", _quoted(identifierRegime="'external-url'", host="'data.org'", url="'http://data.org/' || n", citation="'http://data.org/' || n"), "'http://data.org/' || n", "'typed_relations[0]'", "referenced"),
]
_NODES["ResourceType"] = [_node(_first("kind IS NOT NULL", "kind"), "ResourceType", "A-D02", "'resource-type:' || lower(kind)", _quoted(label="kind"), "kind", "'resource_type'")]
_known = """CASE k % 6 WHEN 0 THEN '[{"idType":"GoogleScholarID","url":"http://s/' || k || '"},{"idType":"ORCID","url":"https://orcid.org/' || orcid || '"}]' WHEN 3 THEN '[{"idType":"ORCID","url":"https://orcid.org/' || orcid || '"}]'
  WHEN 1 THEN '[{"idType":"ORCID","url":"bad"}]' WHEN 2 THEN '[{"idType":"Other","url":"x"}]' END"""
_NODES["Person"] = [
    _node("c", "Person", "A-AG01", "person", _obj(name=_j("name"), identifierRegime="CASE WHEN orcid IS NULL THEN '\"name-key\"' ELSE '\"ORCID\"' END", orcid=_j("orcid"), serviceUserId=_j("k || ''"), identifiers=_known), "name", "'creators[0]'"),
    _node(_first("true", "n"), "Person", "A-AG01", "'person:name:helper-' || n", _quoted(name="'Helper ' || n", identifierRegime="'name-key'"), "'Helper ' || n", "'contributors[0]'"),
]
_agency = """CASE n % 2 WHEN 0 THEN 'organization:ror:0abcdef0' || n % 3 ELSE 'organization:name:agency-' || n % 3 END"""
_agency_url = "CASE n % 2 WHEN 0 THEN 'https://ror.org/0abcdef0' || n % 3 END"
_NODES["Organization"] = [
    _node(_first("true", "n"), "Organization", "A-AG02", "'organization:name:org-' || n", _quoted(name="'Org ' || n", identifierRegime="'name-key'"), "'Org ' || n", "'creators[0].organization'"),
    _node(_first("k % 7 = 0", "n % 2, n % 3"), "Organization", "A-AG02", _agency, _obj(name=_j("'Agency ' || n % 3"), identifierRegime="CASE n % 2 WHEN 0 THEN '\"ROR\"' ELSE '\"name-key\"' END", ror=_j("CASE n % 2 WHEN 0 THEN '0abcdef0' || n % 3 END"), url=_j(_agency_url)), "'Agency ' || n % 3", "'awards[0].funding_agency_name'"),
]
_NODES["Identifier"] = [
    _node("c WHERE identifier IS NOT NULL", "Identifier", "A-ID01", "'identifier:id-org-' || k", _quoted(identifierValue="identifier", identifierType="'URL'"), "identifier", "'identifier'"),
    _node("c WHERE k % 8 > 0 AND k % 4 < 2", "Identifier", "A-ID01", "'identifier:u-org-' || k", _quoted(identifierValue="url", identifierType="'URL'"), "url", "'url'"),
    _node("c WHERE k % 6 = 0", "Identifier", "A-ID01", "'identifier:s-' || k", _quoted(identifierValue="'http://s/' || k", identifierType="'GoogleScholarID'"), "'http://s/' || k", "'creator_identifiers[0]'"),
    _node("c WHERE k % 6 = 4", "Identifier", "A-ID01", "'identifier:rg-' || k", _quoted(identifierValue="'http://rg/' || k", identifierType="'ResearchGateID'"), "'http://rg/' || k", "'creator_identifiers[0]'"),
]
_NODES["License"] = [
    _node(_first("k % 3 = 0", "1"), "License", "A-D05", "'license:cc-by-4.0'", _quoted(statement="'CC'", url=f"'{CC}'", spdxId="'CC-BY-4.0'"), "'CC'", "'rights'"),
    _node(_first("k % 3 = 1", "n"), "License", "A-D05", "'license:name:lic-' || n", _quoted(statement="'Lic ' || n"), "'Lic ' || n", "'rights'"),
    _node(_first("k % 3 = 2", "n"), "License", "A-D05", "'license:url:lic-org-' || n", _quoted(url="'http://lic.org/' || n"), "'http://lic.org/' || n", "'rights'"),
]
_NODES["Subject"] = [_node(_first("true", "seg"), "Subject", "A-D06", "'subject:' || regexp_replace(lower(seg), '[^a-z0-9]+', '-', 'g')", _obj(label=f"'[' || {_j('seg')} || ',' || {_j('lower(seg)')} || ']'"), "seg", "'subjects[0]'")]
_box = """'{"eastlimit": ' || (k + 0.5) || ', "northlimit": null, "projection": null, "southlimit": null, "type": "box", "units": null, "westlimit": null}'"""
_NODES["SpatialCoverage"] = [_node("c WHERE k % 5 = 0", "SpatialCoverage", "A-D07→A-DOM09", "rid || ':spatial'", _obj(eastlimit="(k + 0.5)", type="'\"box\"'"), _box, "'spatial_coverage'")]
_NODES["TemporalCoverage"] = [_node("c WHERE k % 5 = 1", "TemporalCoverage", "A-D08→A-DOM10", "rid || ':temporal'", _quoted(start="'20' || n"), """'{"end": null, "start": "20' || n || '"}'""", "'temporal_coverage'")]
_NODES["Award"] = [_node(_first("k % 7 = 0", "n"), "Award", "A-D09", "'award:agency-' || n % 3 || ':n-' || n", _quoted(title="'Award ' || n", number="'N ' || n", fundingAgencyName="'Agency ' || n % 3", fundingAgencyUrl=_agency_url), "'Award ' || n", "'awards[0]'")]
_NODES["DatasetFile"] = [
    _node("c WHERE kind = 'CompositeResource'", "DatasetFile", "A-D03", "rid || ':file:data-a-csv'", _quoted(fileName="'a.csv'", filePath="'data/a.csv'", extension="'.csv'", checksum="md5(k || '')"), "'a.csv'", "'files[0]'"),
    _node("c WHERE kind = 'CompositeResource'", "DatasetFile", "A-D03", "rid || ':file:b-' || k || '-txt'", _quoted(fileName="'b ' || k || '.txt'"), "'b ' || k || '.txt'", "'files[1]'"),
]
_descriptor = "coalesce(title, 'service tool') || coalesce(', v' || version, '')"
_NODES["ToolConfiguration"] = [_node("c WHERE kind = 'ToolResource'", "ToolConfiguration", "A-D10", "rid || ':tool-config'", _obj(descriptor=_j(_descriptor), launchURL=_j("launch"), toolVersion=_j("version"), supportedFileExtensions="CASE WHEN k % 2 = 0 THEN '[\".nc\"]' END"), _descriptor, "'tool_config'")]
_many = lambda value: f"CASE count(DISTINCT {value}) WHEN 0 THEN NULL WHEN 1 THEN min({value}) ELSE '[' || array_to_string(list_sort(list_distinct(list({value}) FILTER ({value} IS NOT NULL))), ',') || ']' END"
# a tool of the corpus is told by its configuration, and by the records that it executes
_TOOLS = f"""run AS (SELECT k, k - 1 - k % 3 AS j, 'by ' || k AS shown FROM c WHERE k % 10 = 7 AND k > 5),
ran AS (SELECT t.*, run.k AS by_k FROM run JOIN c t ON t.k = run.j WHERE t.kind = 'ToolResource'),
tool AS (
  SELECT n, {_many(_j("coalesce(title, 'app' || n || '.org')"))} AS names, {_many(_j('launch'))} AS launches FROM c WHERE kind = 'ToolResource' GROUP BY n),
by_title AS (SELECT n, {_many(_j('rid'))} AS ids FROM ran GROUP BY n)"""
_NODES["Tool"] = [
    _node(
        "(SELECT * FROM c WHERE kind = 'ToolResource' QUALIFY row_number() OVER (PARTITION BY n ORDER BY k) = 1) JOIN tool USING (n) LEFT JOIN by_title USING (n)", "Tool", "A-DOM02", "'tool:url:app' || n || '-org'",
        _obj(name="names", launchURL="launches", host=_j("'app' || n || '.org'"), identifierRegime="CASE WHEN ids IS NOT NULL THEN '\"service-tool-resource\"' END", serviceResourceId="ids"), "launch", "'tool_config.app_home_page_url'",
    ),
    _node("run JOIN (SELECT k AS j, kind, rid AS target FROM c) t USING (j), (SELECT 1) WHERE t.kind IS DISTINCT FROM 'ToolResource'", "Tool", "A-DOM02", "'tool:service:' || target", _quoted(name="shown", identifierRegime="'service-resource-id'", serviceResourceId="target"), "shown", "'typed_relations[' || (CASE WHEN k % 4 = 3 THEN 1 ELSE 0 END) || ']'", "curated", "format('{:032x}', k)"),
    _node("c WHERE k % 10 = 8", "Tool", "A-DOM02", f"'tool:service:' || {_far}", _quoted(name="'Tool text ' || k", identifierRegime="'service-resource-id'", serviceResourceId=_far), "'Tool text ' || k", "'typed_relations[0]'", "referenced"),
    _node(_first("k % 10 = 9", "1"), "Tool", "A-DOM02", "'tool:url:' || substr(sha256('https://tool.org/run'), 1, 20)", _quoted(name="'https://tool.org/run'", host="'tool.org'", url="'https://tool.org/run'", identifierRegime="'external-url'"), "'https://tool.org/run'", "'relations_from_meta[0]'", "referenced"),
]
_NODES["HydrologicFeature"] = [_node(_first("k % 10 = 0", "n"), "HydrologicFeature", "A-DOM07", "'hydrologic-feature:geo-org-' || n", _quoted(identifierValue="'https://geo.org/' || n", name="'Gage ' || n", identifierRegime="'geoconnex-url'"), "'Gage ' || n", "'geospatial_relations[0]'", "referenced")]
_NODES["Paper"] = [
    _node(_first("k % 10 = 2", "n"), "Paper", "A-P01", "'paper:doi:10-1234-q' || n", _quoted(identifierRegime="'DOI'", doi="'10.1234/q' || n", citation="'doi:10.1234/Q' || n || '.'"), "'doi:10.1234/Q' || n || '.'", "'related_resources[0]'", "referenced"),
    _node("c WHERE k % 10 = 5", "Paper", "A-P01", "'paper:citation:' || substr(sha256('Someone (' || k || ')'), 1, 20)", _quoted(identifierRegime="'citation-text'", citation="'Someone (' || k || ')'"), "'Someone (' || k || ')'", "'typed_relations[' || (CASE WHEN k % 4 = 3 THEN 1 ELSE 0 END) || ']'", "referenced"),
]
_NODES["Repository"] = [_node(_first("k % 10 = 3", "n"), "Repository", "A-C01", "'repository:url:github-com-o-r' || n", _obj(identifierRegime=_j("'repository-url'"), host=_j("'github.com'"), path=_j("'o/r' || n"), url=_j("'https://github.com/o/r' || n || '/'"), citation=_j("'see'")), "'see'", "'typed_relations[' || (CASE WHEN k % 4 = 3 THEN 1 ELSE 0 END) || ']'", "referenced")]


def _edge(of: str, relation: str, inventory: str, source: str, target: str, said: str, at: str, attributes: str = "'{}'", rid: str = "rid") -> str:
    whole = f"""'{{"inventoryId":' || {_j(f"'{inventory}'")} || ',"relation":"{relation}","source":' || {_j(source)} || ',"target":' || {_j(target)} || '}}'"""
    return f"""SELECT 'edge:' || substr(sha256({whole}), 1, 20) AS id, '{inventory}' AS inventory_id, {source} AS source, {target} AS target, {attributes} AS attributes, {said} AS said, {rid} || ':' || {at} AS place, 'deterministic' AS method, 'dataset:' || {rid} AS artifact FROM {of}"""


_by = lambda predicate: _quoted(predicateQName=f"'{predicate}'")
_typed = "'typed_relations[' || (CASE WHEN k % 4 = 3 THEN 1 ELSE 0 END) || ']'"
_license = "CASE k % 3 WHEN 0 THEN 'license:cc-by-4.0' WHEN 1 THEN 'license:name:lic-' || n ELSE 'license:url:lic-org-' || n END"
_EDGES: dict[str, list[str]] = {
    "hasResourceType": [_edge("c WHERE kind IS NOT NULL", "hasResourceType", "C-D01", "rid", "'resource-type:' || lower(kind)", "kind", "'resource_type'")],
    "hasCreator": [_edge("c", "hasCreator", "C-D03", "rid", "person", "name", "'creators[0]'", _obj(creatorOrder="'1'"))],
    "hasContributor": [_edge("c", "hasContributor", "C-DC05/A-AG", "rid", "'person:name:helper-' || n", "'Helper ' || n", "'contributors[0]'")],
    "affiliatedWith": [_edge("c", "affiliatedWith", "A-AG-R1", "person", "'organization:name:org-' || n", "'Org ' || n", "'creators[0].organization'")],
    "hasIdentifier": [
        _edge("c WHERE identifier IS NOT NULL", "hasIdentifier", "C-D04", "rid", "'identifier:id-org-' || k", "identifier", "'identifier'"),
        _edge("c WHERE k % 8 > 0 AND k % 4 < 2", "hasIdentifier", "C-D04", "rid", "'identifier:u-org-' || k", "url", "'url'"),
        _edge("c WHERE k % 6 = 0", "hasIdentifier", "A-ID01 (ID-R1)", "person", "'identifier:s-' || k", "'http://s/' || k", "'creator_identifiers[0]'"),
        _edge("c WHERE k % 6 = 4", "hasIdentifier", "A-ID01 (ID-R1)", "'person:name:nobody-' || k", "'identifier:rg-' || k", "'http://rg/' || k", "'creator_identifiers[0]'"),
    ],
    "hasLicense": [_edge("c", "hasLicense", "C-D05", "rid", _license, "CASE k % 3 WHEN 0 THEN 'CC' WHEN 1 THEN 'Lic ' || n ELSE 'http://lic.org/' || n END", "'rights'")],
    "hasSubject": [_edge("c", "hasSubject", "C-D06", "rid", "'subject:' || regexp_replace(lower(seg), '[^a-z0-9]+', '-', 'g')", "seg", "'subjects[0]'")],
    "hasSpatialCoverage": [_edge("c WHERE k % 5 = 0", "hasSpatialCoverage", "C-D07", "rid", "rid || ':spatial'", _box, "'spatial_coverage'")],
    "coversPeriod": [_edge("c WHERE k % 5 = 1", "coversPeriod", "C-D08", "rid", "rid || ':temporal'", """'{"end": null, "start": "20' || n || '"}'""", "'temporal_coverage'")],
    "fundedBy": [
        _edge("c WHERE k % 7 = 0", "fundedBy", "C-D09 / A-AG-R2", "rid", "'award:agency-' || n % 3 || ':n-' || n", "'Award ' || n", "'awards[0]'"),
        _edge(_first("k % 7 = 0", "n"), "fundedBy", "A-AG-R2", "'award:agency-' || n % 3 || ':n-' || n", _agency, "'Agency ' || n % 3", "'awards[0].funding_agency_name'"),
    ],
    "hasFile": [
        _edge("c WHERE kind = 'CompositeResource'", "hasFile", "C-D02", "rid", "rid || ':file:data-a-csv'", "'a.csv'", "'files[0]'"),
        _edge("c WHERE kind = 'CompositeResource'", "hasFile", "C-D02", "rid", "rid || ':file:b-' || k || '-txt'", "'b ' || k || '.txt'", "'files[1]'"),
    ],
    "hasToolConfig": [_edge("c WHERE kind = 'ToolResource'", "hasToolConfig", "C-D10", "rid", "rid || ':tool-config'", _descriptor, "'tool_config'")],
    "launchesApp": [_edge("c WHERE kind = 'ToolResource'", "launchesApp", "C-D11", "rid || ':tool-config'", "'tool:url:app' || n || '-org'", "launch", "'tool_config.app_home_page_url'")],
    "hasMember": [_edge("c WHERE k % 12 = 1 AND k > 1 AND kind = 'CollectionResource'", "hasMember", "C-D12", "rid", "format('{:032x}', k - 1)", "'part of ' || k", "'links[0]'", _by("dcterms:hasPart"))],
    "isMemberOf": [_edge("c WHERE k % 4 = 3", "isMemberOf", "C-D13", "rid", "format('{:032x}', k - 2)", "'http://s.org/resource/' || format('{:032x}', k - 2)", "'typed_relations[0]'", _by("dcterms:isPartOf"))],
    "derivedFrom": [_edge("c WHERE k % 10 = 1", "derivedFrom", "C-D14", "rid", _far, _derived, _typed, _by("prov:wasDerivedFrom"))],
    "references": [
        _edge("c WHERE k % 10 = 2", "references", "C-D19", "rid", "'paper:doi:10-1234-q' || n", "'doi:10.1234/Q' || n || '.'", "'related_resources[0]'", _by("dcterms:references")),
        _edge("c WHERE k % 10 = 3", "references", "C-D19", "rid", "'repository:url:github-com-o-r' || n", "'see'", _typed, _by("dcterms:source")),
        _edge("c WHERE k % 10 = 4", "references", "C-D19", "rid", "'dataset:url:' || substr(sha256('http://data.org/' || n), 1, 20)", "'http://data.org/' || n", "'typed_relations[0]'", _by("dcterms:references")),
        _edge("c WHERE k % 10 = 5", "references", "C-D19", "rid", "'paper:citation:' || substr(sha256('Someone (' || k || ')'), 1, 20)", "'Someone (' || k || ')'", _typed, _by("hsterms:isDescribedBy")),
    ],
    "isExecutedBy": [
        _edge("run JOIN (SELECT k AS j, kind, n, rid AS target FROM c) t USING (j)", "isExecutedBy", "C-D20", "format('{:032x}', k)", "CASE WHEN t.kind = 'ToolResource' THEN 'tool:url:app' || n || '-org' ELSE 'tool:service:' || target END", "shown", _typed, _by("hsterms:isExecutedBy"), "format('{:032x}', k)"),
        _edge("c WHERE k % 10 = 8", "isExecutedBy", "C-D20", "rid", f"'tool:service:' || {_far}", "'Tool text ' || k", "'typed_relations[0]'", _by("hsterms:isExecutedBy")),
        _edge("c WHERE k % 10 = 9", "isExecutedBy", "C-D20", "rid", "'tool:url:' || substr(sha256('https://tool.org/run'), 1, 20)", "'https://tool.org/run'", "'relations_from_meta[0]'", _by("hsterms:isExecutedBy")),
    ],
    "referencesFeature": [_edge("c WHERE k % 10 = 0", "referencesFeature", "C-D15", "rid", "'hydrologic-feature:geo-org-' || n", "'Gage ' || n", "'geospatial_relations[0]'", _by("hsterms:relation"))],
}


def _with(parts: list[str]) -> str:
    return f"WITH {_C}, {_REFERRED}, {_TOOLS}\n" + "\nUNION ALL ".join(parts)


def _register() -> None:
    def nodes_of(kind: str):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            found = extract_nodes(records(spark, sf), kind)
            return found.select("id", "class", "inventory_id", _object().alias("attributes"), *_told(), "curation_status")

        return run

    def edges_of(relation: str):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            found = extract_edges(records(spark, sf, *READS[relation]), relation)
            return found.select("id", "inventory_id", "source", "target", _object().alias("attributes"), *_told())

        return run

    for kind, parts in _NODES.items():
        query(f"extract_node_{kind}", _with(parts))(nodes_of(kind))
    for relation, parts in _EDGES.items():
        query(f"extract_edge_{relation}", _with(parts))(edges_of(relation))


_register()


@query(
    "extract_skips",
    f"""WITH {_C}, told AS (
    SELECT 'unknown_resource_type:' || coalesce(kind, 'missing') AS reason FROM c WHERE kind IS NULL OR kind = 'Odd'
    UNION ALL SELECT 'missing:resource_type' FROM c WHERE kind IS NULL
    UNION ALL SELECT 'unexpected_files_for_type:' || coalesce(kind, 'None') FROM c WHERE k % 9 = 1 AND kind IS DISTINCT FROM 'CompositeResource'
    UNION ALL SELECT 'unexpected_tool_config_for_type:' || coalesce(kind, 'None') FROM c WHERE (k % 3 = 2 OR k % 9 = 3) AND kind IS DISTINCT FROM 'ToolResource'
    UNION ALL SELECT 'invalid_orcid_identifier' FROM c WHERE k % 6 = 1 UNION ALL SELECT 'unmapped_person_identifier:Other' FROM c WHERE k % 6 = 2
    UNION ALL SELECT 'unresolved_hasMember_target' FROM c WHERE k % 12 = 7 AND kind = 'CollectionResource'
    UNION ALL SELECT 'deferred_to_llm:reference_target:dcterms:requires' FROM c WHERE k % 10 = 6
    UNION ALL SELECT 'unresolved_geospatial_target' FROM c WHERE k % 10 = 1)
    SELECT reason, count(*) AS n FROM told GROUP BY reason""",
)
def extract_skips(spark: SparkSession, sf: str) -> DataFrame:
    return graph(spark, sf).skipped
