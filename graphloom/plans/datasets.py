"""Raw dataset folders to consolidated records, ready for plans.extraction.

raw: resource_id, name, text of the files of each resource's folder (see sources.files)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.text import clean_list, clean_text, data_url_summary, extract_urls, looks_like_url, none_if_empty, readme_key
from ..functions.values import falsy_coalesce
from ..operators.documents import distinct_texts, primary_text, sections
from ..operators.records import histogram
from ..sources.files import json_or_default
from ..sources.rdf import TERMS, with_semantics

_PEOPLE = "array<struct<name:string,creator_order:bigint,user_id:string,organization:string,email:string,homepage:string,address:string,phone:string,identifiers:map<string,string>>>"
META = f"""struct<type:string,title:string,abstract:string,url:string,identifier:string,citation:string,language:string,creators:{_PEOPLE},contributors:{_PEOPLE},relations:array<struct<type:string,value:string>>,
rights:struct<statement:string,url:string>,awards:array<struct<title:string,number:string,funding_agency_name:string,funding_agency_url:string>>,additional_metadata:map<string,string>,subjects:array<string>,
spatial_coverage:struct<type:string,northlimit:double,north:double,southlimit:double,south:double,eastlimit:double,east:double,westlimit:double,west:double,units:string,projection:string>,period_coverage:struct<start:string,end:string>>"""
SYSTEM = "struct<resource_type:string,resource_title:string,abstract:string,resource_url:string,doi:string,date_created:string,date_last_updated:string,bag_url:string,published:boolean,immutable:boolean,public:boolean,discoverable:boolean,shareable:boolean,content_types:array<string>>"
INVENTORY = "array<struct<file_name:string,file_path:string,extension:string,checksum:string>>"
GEOSPATIAL = (".tif", ".tiff", ".vrt", ".shp", ".gpkg", ".nc", ".geojson", ".json")  # fixed values


def units(value: Column) -> Column:
    """Units given as text; a list written as text becomes its members, one member itself."""
    clean = clean_text(value)
    members = F.from_json(F.translate(clean, "'", '"'), "array<string>")
    listed = F.startswith(clean, F.lit("[")) & members.isNotNull()
    several = clean_list(members)
    return F.when(listed & (F.size(several) == 1), several[0]).when(listed, F.to_json(several)).otherwise(clean)


def _people(people: Column) -> Column:
    return F.transform(
        F.coalesce(people, F.array()),
        lambda p: F.struct(
            clean_text(p["name"]).alias("name"),
            p["creator_order"].alias("creator_order"),
            p["user_id"].alias("user_id"),
            *[clean_text(p[c]).alias(c) for c in ("organization", "email", "homepage", "address", "phone")],
            _identifiers(p).alias("identifiers"),
        ),
    )


def _identifiers(p: Column) -> Column:
    entries = F.filter(F.transform(F.map_entries(p["identifiers"]), lambda e: F.struct(clean_text(e["key"]).alias("id_type"), clean_text(e["value"]).alias("url"))), lambda e: e["url"].isNotNull())
    return F.coalesce(entries, F.array().cast("array<struct<id_type:string,url:string>>"))


def _flat(people: Column) -> Column:
    """Identifiers of all people, each with the person's name."""
    return F.flatten(F.transform(F.coalesce(people, F.array()), lambda p: F.transform(_identifiers(p), lambda i: F.struct(clean_text(p["name"]).alias("person_name"), i["id_type"].alias("id_type"), i["url"].alias("url")))))


def _described(r: Column, source: str) -> list[Column]:
    urls = extract_urls(r["target"])
    return [r["target"].alias("target"), looks_like_url(r["target"]).alias("target_looks_like_url"), urls.alias("embedded_urls"), (F.size(urls) > 0).alias("contains_embedded_url"), ids.resource_id(r["target"]).alias("target_resource_id"), F.lit(source).alias("source_file")]


def _merged(typed: Column, stated: Column) -> Column:
    """Typed relations with the labels stated for their target; stated ones whose target has none, once a label."""
    labels = lambda target: F.transform(F.filter(stated, lambda s: (s["target"] == target) & s["relation_label"].isNotNull()), lambda s: s["relation_label"])
    xml, meta = F.lit("raw_metadata.xml"), F.lit("meta_dump.json")
    none = F.lit(None).cast("string")
    common = lambda r: [r[c].alias(c) for c in ("target", "target_looks_like_url", "embedded_urls", "contains_embedded_url", "target_resource_id")]
    first = F.transform(typed, lambda r: F.struct(r["predicate_qname"].alias("predicate_qname"), r["predicate_uri"].alias("predicate_uri"), clean_list(labels(r["target"])).alias("relation_labels_from_meta"), *common(r), r["rdf_object_kind"].alias("rdf_object_kind"), F.when(F.size(labels(r["target"])) > 0, F.array(xml, meta)).otherwise(F.array(xml)).alias("source_files")))
    alone = F.filter(stated, lambda s: ~F.exists(typed, lambda r: r["target"] == s["target"]))
    keys = F.transform(alone, lambda s: F.struct(s["target"].alias("t"), s["relation_label"].alias("l")))
    once = F.filter(F.transform(alone, lambda s, i: F.struct(s.alias("s"), i.alias("i"))), lambda x: F.array_position(keys, F.struct(x["s"]["target"].alias("t"), x["s"]["relation_label"].alias("l"))) == x["i"] + 1)
    rest = F.transform(once, lambda x: F.struct(none.alias("predicate_qname"), none.alias("predicate_uri"), F.filter(F.array(x["s"]["relation_label"]), lambda v: v.isNotNull()).alias("relation_labels_from_meta"), *common(x["s"]), none.alias("rdf_object_kind"), F.array(meta).alias("source_files")))
    return F.concat(first, rest)


def build(raw: DataFrame, terms: str = TERMS, address: str = "https://datasets.example.org/resource/") -> DataFrame:
    """One record a resource. Broken metadata is told in the column error, not fatal."""
    wide = raw.groupBy("resource_id").agg(*[F.max(F.when(F.col("name") == n, F.col("text"))).alias(a) for n, a in (("meta_dump.json", "meta"), ("sys_meta_dump.json", "system"), ("file_inventory.json", "inventory"), ("raw_metadata.xml", "xml"))])
    for name, schema in (("meta", META), ("system", SYSTEM), ("inventory", INVENTORY)):
        wide = json_or_default(wide, name, schema).withColumnRenamed("value", f"{name}_v").withColumnRenamed("issue", f"{name}_issue")
    wide = wide.join(with_semantics(wide, "resource_id", "xml", terms), "resource_id")
    wide = wide.join(documentation(raw), "resource_id", "left")
    m, s, x = (lambda c: F.col(f"meta_v.{c}")), (lambda c: F.col(f"system_v.{c}")), (lambda c: F.col(f"semantics.{c}"))
    either = lambda *cs: clean_text(falsy_coalesce(*cs))
    typed = F.transform(F.coalesce(x("typed_relations"), F.array()), lambda r: F.struct(r["predicate_qname"].alias("predicate_qname"), r["predicate_uri"].alias("predicate_uri"), r["rdf_object_kind"].alias("rdf_object_kind"), *_described(r, "raw_metadata.xml")))
    stated = F.transform(F.filter(F.transform(F.coalesce(m("relations"), F.array()), lambda r: F.struct(clean_text(r["type"]).alias("relation_label"), clean_text(r["value"]).alias("target"))), lambda r: r["target"].isNotNull()), lambda r: F.struct(r["relation_label"].alias("relation_label"), *_described(r, "meta_dump.json")))
    geo = F.transform(F.coalesce(x("geospatial_relations"), F.array()), lambda r: F.struct(r["name"].alias("name"), F.lit("geospatial").alias("relation_category"), r["predicate_qname"].alias("predicate_qname"), r["predicate_uri"].alias("predicate_uri"), r["rdf_object_kind"].alias("rdf_object_kind"), *_described(r, "raw_metadata.xml")))
    rows = wide.withColumns({"typed_relations": typed, "relations_from_meta": stated, "geospatial_relations": geo}).withColumn("related_resources", _merged(F.col("typed_relations"), F.col("relations_from_meta")))
    links = F.array_distinct(F.transform(F.filter("related_resources", lambda r: r["target_resource_id"].isNotNull()), lambda r: F.struct(r["predicate_qname"].alias("predicate_qname"), r["predicate_uri"].alias("predicate_uri"), r["target_resource_id"].alias("target_resource_id"), r["target"].alias("target"))))
    rows = rows.withColumn("links", links)
    inventory = F.coalesce("inventory_v", F.array().cast(INVENTORY))
    extensions = F.filter(F.transform(inventory, lambda f: F.lower(clean_text(f["extension"]))), lambda e: e.isNotNull())
    names = F.array_sort(F.array_distinct(extensions))
    counted = F.map_from_arrays(names, F.transform(names, lambda n: F.size(F.filter(extensions, lambda e: e == n)).cast("bigint")))
    side = lambda a, b: falsy_coalesce(F.col(f"meta_v.spatial_coverage.{a}"), F.col(f"meta_v.spatial_coverage.{b}"))
    member = lambda q: F.filter("typed_relations", lambda r: r["predicate_qname"] == q)
    kind = falsy_coalesce(m("type"), s("resource_type"), x("resource_xml_type"), F.lit("CompositeResource"))
    config = F.col("semantics.tool_config")
    return rows.select(
        "resource_id",
        kind.alias("resource_type"),
        either(m("title"), s("resource_title")).alias("title"),
        either(m("abstract"), s("abstract")).alias("abstract"),
        either(m("url"), s("resource_url"), F.concat(F.lit(address), "resource_id", F.lit("/"))).alias("url"),
        *[clean_text(m(c)).alias(c) for c in ("identifier", "citation", "language")],
        _people(m("creators")).alias("creators"),
        _people(m("contributors")).alias("contributors"),
        _flat(m("creators")).alias("creator_identifiers"),
        _flat(m("contributors")).alias("contributor_identifiers"),
        F.when(m("rights").isNotNull(), F.struct(clean_text(m("rights.statement")).alias("statement"), clean_text(m("rights.url")).alias("url"))).alias("rights"),
        F.transform(F.coalesce(m("awards"), F.array()), lambda a: F.struct(*[clean_text(a[c]).alias(c) for c in ("title", "number", "funding_agency_name", "funding_agency_url")])).alias("awards"),
        m("additional_metadata").alias("additional_metadata"),
        F.col("system_v").alias("system_metadata"),
        clean_list(m("subjects")).alias("subjects"),
        F.when(m("spatial_coverage").isNotNull(), F.struct(clean_text(m("spatial_coverage.type")).alias("type"), side("northlimit", "north").alias("northlimit"), side("southlimit", "south").alias("southlimit"), side("eastlimit", "east").alias("eastlimit"), side("westlimit", "west").alias("westlimit"), units(m("spatial_coverage.units")).alias("units"), clean_text(m("spatial_coverage.projection")).alias("projection"))).alias("spatial_coverage"),
        F.when(m("period_coverage").isNotNull(), F.struct(clean_text(m("period_coverage.start")).alias("start"), clean_text(m("period_coverage.end")).alias("end"))).alias("temporal_coverage"),
        "relations_from_meta",
        "typed_relations",
        "related_resources",
        "links",
        "geospatial_relations",
        F.when(x("resource_xml_type") == "CollectionResource", F.struct(F.size(member("dcterms:hasPart")).cast("bigint").alias("member_count"), F.transform(member("dcterms:hasPart"), lambda r: F.struct(r["target"].alias("citation_or_reference"), r["target_resource_id"].alias("member_resource_id"))).alias("members"), clean_list(F.transform(member("hsterms:isDescribedBy"), lambda r: r["target"])).alias("described_by"))).alias("collection_summary"),
        F.when(config.isNotNull(), config.dropFields("tool_icon_data_url").withField("tool_icon_data_url_summary", data_url_summary(config["tool_icon_data_url"]))).alias("tool_config"),
        "documentation",
        inventory.alias("files"),
        F.struct(F.size(inventory).cast("bigint").alias("total_files"), counted.alias("extensions"), F.exists(inventory, lambda f: F.startswith(F.lower(F.coalesce(clean_text(f["file_name"]), F.lit(""))), F.lit("readme"))).alias("has_readme_file")).alias("file_summary"),
        F.arrays_overlap(names, F.array(*[F.lit(g) for g in GEOSPATIAL])).alias("has_geospatial_files"),
        F.struct(*[F.size(c).cast("bigint").alias(n) for c, n in (("relations_from_meta", "meta_relation_count"), ("typed_relations", "typed_relation_count"), ("related_resources", "merged_relation_count"), ("links", "link_count"), ("geospatial_relations", "geospatial_relation_count"))]).alias("relation_summary"),
        F.concat_ws("; ", none_if_empty(F.concat_ws("; ", "meta_issue", "system_issue", "inventory_issue")), F.col("semantics.error")).alias("error"),
    )


def documentation(raw: DataFrame) -> DataFrame:
    """resource_id, documentation: the different readme files of a resource, with their sections."""
    readmes = raw.filter(F.lower("name").isin("readme.md", "readme.txt")).select("resource_id", "name", "text")
    # an empty file is no readme; one under two names has one text
    kept = distinct_texts(readmes.filter(readme_key(F.col("text")) != ""), ["resource_id"], "text", "name")
    parts = sections(kept.withColumn("key", F.struct("resource_id", "name")), "key", "text")
    section = F.struct(*[c for c in parts.columns if c != "key"])
    trees = parts.groupBy("key").agg(F.array_sort(F.collect_list(section)).alias("readme_sections"))
    files = kept.withColumn("key", F.struct("resource_id", "name")).join(trees, "key", "left")
    one = F.struct(F.col("name").alias("source_file"), F.col("text").alias("readme_text_raw"), clean_text(F.col("text")).alias("readme_text_clean"), F.length("text").cast("bigint").alias("readme_char_count"), "readme_sections")
    listed = files.groupBy("resource_id").agg(F.array_sort(F.collect_list(one)).alias("readme_files"))
    return listed.join(primary_text(kept, ["resource_id"], "name"), "resource_id").select("resource_id", F.struct(F.lit(True).alias("readme_present"), F.size("readme_files").cast("bigint").alias("readme_file_count"), F.col("name").alias("primary_readme_file"), "readme_files").alias("documentation"))


def failures(records: DataFrame) -> DataFrame:
    """status, n: records with and without errors."""
    return histogram(records.select(F.when(F.col("error") == "", "ok").otherwise("failed").alias("status")), "status")


def _shaped(value: Column, have, want) -> Column:
    """A value cast to a type by field names; fields it lacks are null."""
    from pyspark.sql.types import ArrayType, StructType

    if isinstance(want, StructType) and isinstance(have, StructType):
        fields = [(_shaped(value[f.name], have[f.name].dataType, f.dataType) if f.name in have.names else F.lit(None).cast(f.dataType)).alias(f.name) for f in want.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(want, ArrayType) and isinstance(have, ArrayType):
        return F.transform(value, lambda x: _shaped(x, have.elementType, want.elementType))
    return value.cast(want)


def for_extraction(records: DataFrame) -> DataFrame:
    """Records with the columns that plans.extraction reads; documentation becomes JSON text."""
    from pyspark.sql.types import StructType

    from .extraction import RECORD

    given = records.withColumn("documentation", F.to_json("documentation"))
    want = StructType.fromDDL(RECORD)
    return given.select(*[(_shaped(F.col(f.name), given.schema[f.name].dataType, f.dataType) if f.name in given.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in want.fields])
