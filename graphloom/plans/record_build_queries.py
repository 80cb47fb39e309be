"""Catalogue: raw dataset folders made from customers, and the records built of them, block by block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.rdf import TERMS
from . import datasets
from .registry import query
from .star import read


def _cat(*xs) -> Column:
    return F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs])


RDF = f'<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:dcterms="http://purl.org/dc/terms/" xmlns:hsterms="{TERMS}">'


def raw(spark: SparkSession, sf: str) -> DataFrame:
    """resource_id, name, text: what a customer's key leaves after division decides what is in its folder."""
    key, nation, name = F.col("c_custkey"), F.col("c_nationkey"), F.col("c_name")
    left = lambda by, rest, yes, no: F.when(key % by == rest, yes).otherwise(no)
    spatial = left(4, 0, _cat(',"spatial_coverage":{"type":"box","northlimit":0.0,"north":', nation, '.5,"southlimit":', key, ',"units":"[\'m\', \' km \']"}'), F.lit(""))
    meta = _cat(
        '{"title":"  Title  ', key, ' ","abstract":', left(3, 0, F.lit("null"), _cat('"A\\r\\nb ', key, '"')), ',"type":', left(5, 0, F.lit('""'), F.lit('"CompositeResource"')), ',"url":', left(2, 0, F.lit("null"), _cat('"http://u.org/', key, '"')),
        ',"subjects":["Water"," Water ","","', nation, '"],"creators":[{"name":" ', name, ' ","creator_order":1,"identifiers":{"ORCID":"http://orcid.org/', key, '","Blank":" "}}],"relations":[{"type":"Is part of","value":"http://s.org/resource/', F.md5(key.cast("string")), '"},{"type":"Note","value":"see http://x.org/', nation, '."},{"type":"Empty","value":" "}]', spatial, "}",
    )
    system = _cat('{"resource_title":"System ', key, '","resource_type":"CollectionResource","abstract":"System abstract ', key, '","resource_url":"http://sys.org/', key, '"}')
    inventory = _cat('[{"file_name":"a.CSV","extension":".CSV"},{"file_name":"b', key, '.csv","extension":".csv"},{"file_name":"README.md","extension":".md"}', left(3, 1, F.lit(',{"file_name":"g.tif","extension":".tif"}'), F.lit("")), "]")
    part = _cat('<dc:relation><rdf:Description><dcterms:isPartOf rdf:resource="http://s.org/resource/', F.md5(key.cast("string")), '"/></rdf:Description></dc:relation><dc:relation><rdf:Description><dcterms:references>Book ', nation, "</dcterms:references></rdf:Description></dc:relation>")
    config = _cat("<hsterms:AppHomePageUrl><rdf:Description><hsterms:value>https://app", nation, ".org</hsterms:value></rdf:Description></hsterms:AppHomePageUrl><hsterms:RequestUrlBase><rdf:Description><hsterms:value>https://r.org/%0Aq</hsterms:value></rdf:Description></hsterms:RequestUrlBase><hsterms:ToolIcon><rdf:Description><hsterms:data_url>data:image/png;base64,AA", nation, "</hsterms:data_url></rdf:Description></hsterms:ToolIcon>")
    kind = F.when(key % 6 == 1, "ToolResource").when(key % 6 == 2, "CollectionResource").otherwise("CompositeResource")
    member = F.when(key % 6 == 2, _cat('<dc:relation><rdf:Description><dcterms:hasPart rdf:resource="http://s.org/resource/', F.md5(_cat("m", key)), '"/></rdf:Description></dc:relation>')).otherwise("")
    xml = F.when(key % 10 == 7, "<broken").otherwise(_cat(RDF, "<hsterms:", kind, ">", part, member, F.when(key % 6 == 1, config).otherwise(""), "</hsterms:", kind, "></rdf:RDF>"))
    files = [("meta_dump.json", left(20, 0, F.lit("{"), meta)), ("sys_meta_dump.json", system), ("file_inventory.json", inventory), ("raw_metadata.xml", xml), ("README.md", _cat("# Head ", nation, "\nbody"))]
    rows = F.array(*[F.struct(F.lit(n).alias("name"), t.alias("text")) for n, t in files])
    twin = F.when(key % 4 == 1, F.array(F.struct(F.lit("readme.txt").alias("name"), _cat("# Head ", nation, "\r\nbody\n").alias("text")))).when(key % 4 == 2, F.array(F.struct(F.lit("readme.txt").alias("name"), F.lit("other").alias("text")))).when(key % 4 == 3, F.array(F.struct(F.lit("readme.txt").alias("name"), F.lit(" \n").alias("text")))).otherwise(F.array())
    return read(spark, sf, "customer").select(F.md5(_cat("r", key)).alias("resource_id"), F.explode(F.concat(rows, twin)).alias("f")).select("resource_id", "f.*")


def built(spark: SparkSession, sf: str) -> DataFrame:
    return datasets.build(raw(spark, sf))


_C = "c AS (SELECT c_custkey AS k, c_nationkey AS n, c_name AS name, md5('r' || c_custkey) AS resource_id, c_custkey % 20 = 0 AS broken, c_custkey % 10 = 7 AS no_xml FROM customer)"


@query(
    "dataset_record_fields",
    f"""WITH {_C} SELECT resource_id, CASE WHEN broken OR k % 5 = 0 THEN 'CollectionResource' ELSE 'CompositeResource' END AS resource_type, CASE WHEN broken THEN 'System ' || k ELSE 'Title ' || k END AS title,
    CASE WHEN broken OR k % 3 = 0 THEN 'System abstract ' || k ELSE 'A' || chr(10) || 'b ' || k END AS abstract, CASE WHEN broken OR k % 2 = 0 THEN 'http://sys.org/' || k ELSE 'http://u.org/' || k END AS url, CASE WHEN broken THEN '' ELSE 'Water|' || n END AS subjects,
    CASE WHEN broken THEN '' ELSE name END AS creators, CASE WHEN broken THEN '' ELSE name || '=ORCID=http://orcid.org/' || k END AS identifiers, concat_ws('; ', CASE WHEN broken THEN 'invalid_json' END, CASE WHEN no_xml THEN 'xml' END) AS error FROM c""",
)
def record_fields(spark: SparkSession, sf: str) -> DataFrame:
    flat = F.array_join(F.transform("creator_identifiers", lambda i: F.concat_ws("=", i["person_name"], i["id_type"], i["url"])), "|")
    error = F.regexp_replace("error", r"(\Ainvalid_json)?(; )?[^;]*(token|syntax|closed)[^;]*\z", "$1$2xml")
    return built(spark, sf).select("resource_id", "resource_type", "title", "abstract", "url", F.array_join("subjects", "|").alias("subjects"), F.array_join(F.transform("creators", lambda c: c["name"]), "|").alias("creators"), flat.alias("identifiers"), error.alias("error"))


@query(
    "dataset_record_coverage",
    f"""WITH {_C} SELECT resource_id, 'box' AS kind, n + 0.5::DOUBLE AS northlimit, k::DOUBLE AS southlimit, '["m","km"]' AS units FROM c WHERE NOT broken AND k % 4 = 0""",
)
def record_coverage(spark: SparkSession, sf: str) -> DataFrame:
    s = lambda c: F.col(f"spatial_coverage.{c}")
    return built(spark, sf).filter("spatial_coverage IS NOT NULL").select("resource_id", s("type").alias("kind"), s("northlimit").alias("northlimit"), s("southlimit").alias("southlimit"), s("units").alias("units"))


@query(
    "dataset_record_relations",
    f"""WITH {_C}, part AS (SELECT *, 'http://s.org/resource/' || md5(k::VARCHAR) AS target FROM c)
    SELECT resource_id, 'dcterms:isPartOf' AS predicate, target, CASE WHEN broken THEN '' ELSE 'Is part of' END AS labels, md5(k::VARCHAR) AS dataset, CASE WHEN broken THEN 'raw_metadata.xml' ELSE 'raw_metadata.xml|meta_dump.json' END AS files FROM part WHERE NOT no_xml
    UNION ALL SELECT resource_id, 'dcterms:references', 'Book ' || n, '', NULL, 'raw_metadata.xml' FROM part WHERE NOT no_xml
    UNION ALL SELECT resource_id, 'dcterms:hasPart', 'http://s.org/resource/' || md5('m' || k), '', md5('m' || k), 'raw_metadata.xml' FROM part WHERE NOT no_xml AND k % 6 = 2
    UNION ALL SELECT resource_id, NULL, target, 'Is part of', md5(k::VARCHAR), 'meta_dump.json' FROM part WHERE no_xml AND NOT broken
    UNION ALL SELECT resource_id, NULL, 'see http://x.org/' || n || '.', 'Note', NULL, 'meta_dump.json' FROM part WHERE NOT broken""",
)
def record_relations(spark: SparkSession, sf: str) -> DataFrame:
    rows = built(spark, sf).select("resource_id", F.explode("related_resources").alias("r"))
    return rows.select("resource_id", F.col("r.predicate_qname").alias("predicate"), "r.target", F.array_join("r.relation_labels_from_meta", "|").alias("labels"), F.col("r.target_resource_id").alias("dataset"), F.array_join("r.source_files", "|").alias("files"))


@query(
    "dataset_record_summaries",
    f"""WITH {_C} SELECT resource_id, 3 + (k % 3 = 1)::BIGINT AS total_files, '.csv=2;.md=1' || CASE WHEN k % 3 = 1 THEN ';.tif=1' ELSE '' END AS extensions, true AS has_readme, k % 3 = 1 AS geospatial,
    CASE WHEN broken THEN 0 ELSE 2 END::BIGINT AS stated, CASE WHEN no_xml THEN 0 ELSE 2 + (k % 6 = 2)::INT END::BIGINT AS typed, CASE WHEN no_xml THEN 0 ELSE 2 + (k % 6 = 2)::INT END::BIGINT + CASE WHEN broken THEN 0 WHEN no_xml THEN 2 ELSE 1 END::BIGINT AS merged,
    (CASE WHEN no_xml THEN CASE WHEN broken THEN 0 ELSE 1 END ELSE 1 + (k % 6 = 2)::INT END)::BIGINT AS links, CASE WHEN NOT no_xml AND k % 6 = 2 THEN 1::BIGINT END AS members FROM c""",
)
def record_summaries(spark: SparkSession, sf: str) -> DataFrame:
    extensions = F.array_join(F.transform(F.array_sort(F.map_entries("file_summary.extensions")), lambda e: _cat(e["key"], "=", e["value"])), ";")
    count = lambda c: F.col(f"relation_summary.{c}")
    return built(spark, sf).select(
        "resource_id", F.col("file_summary.total_files").alias("total_files"), extensions.alias("extensions"), F.col("file_summary.has_readme_file").alias("has_readme"), F.col("has_geospatial_files").alias("geospatial"),
        count("meta_relation_count").alias("stated"), count("typed_relation_count").alias("typed"), count("merged_relation_count").alias("merged"), count("link_count").alias("links"), F.col("collection_summary.member_count").alias("members"),
    )


@query(
    "dataset_record_tools",
    f"""WITH {_C} SELECT resource_id, 'https://app' || n || '.org' AS home, 'https://r.org/q' AS base, true AS icon, 'image/png' AS media, length('data:image/png;base64,AA' || n)::INT AS icon_chars FROM c WHERE k % 6 = 1 AND NOT no_xml""",
)
def record_tools(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda c: F.col(f"tool_config.{c}")
    icon = "tool_icon_data_url_summary"
    return built(spark, sf).filter("tool_config IS NOT NULL").select("resource_id", t("app_home_page_url").alias("home"), t("request_url_base").alias("base"), t(f"{icon}.present").alias("icon"), t(f"{icon}.media_type").alias("media"), t(f"{icon}.char_length").alias("icon_chars"))


@query(
    "dataset_record_readmes",
    f"""WITH {_C} SELECT resource_id, 1 + (k % 4 = 2)::BIGINT AS files, 'README.md' AS first, 'Head ' || n AS heading, 'body' AS body FROM c""",
)
def record_readmes(spark: SparkSession, sf: str) -> DataFrame:
    d = lambda c: F.col(f"documentation.{c}")
    section = F.element_at(F.element_at(d("readme_files"), 1)["readme_sections"], 1)
    return built(spark, sf).select("resource_id", d("readme_file_count").alias("files"), d("primary_readme_file").alias("first"), section["heading"].alias("heading"), section["section_text"].alias("body"))


@query("dataset_record_failures", f"WITH {_C} SELECT CASE WHEN broken OR no_xml THEN 'failed' ELSE 'ok' END AS status, count(*) AS n FROM c GROUP BY 1")
def record_failures(spark: SparkSession, sf: str) -> DataFrame:
    return datasets.failures(built(spark, sf))
