"""Catalogue: formats that Spark has no reader for, over rows made from the driver tables. SQL says what was written into them."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import zip_members
from ..sources.rdf import with_semantics
from ..session import map_arrow
from .papers import chunks
from .registry import query
from .repositories import dependencies, findings
from .star import read


def _manifests(spark: SparkSession, sf: str) -> DataFrame:
    """A requirements file and a project file for each customer, from its orders."""
    orders = read(spark, sf, "orders")
    name = F.concat(F.lit("pkg-"), (F.col("o_orderkey") % 97).cast("string"))
    line = F.concat(name, F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("=="), (F.col("o_orderkey") % 5).cast("string"))).when(F.col("o_orderkey") % 7 == 0, "[extra]>1  # why").otherwise(""))
    lines = orders.groupBy(F.concat(F.lit("repo"), F.col("o_custkey").cast("string")).alias("repo")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    plain = lines.select("repo", F.lit("requirements.txt").alias("path"), F.array_join("lines", "\n").alias("text"))
    quoted = F.transform("lines", lambda x: F.concat(F.lit('"'), F.regexp_replace(x, r"\s+#.*", ""), F.lit('"')))
    project = lines.select("repo", F.lit("pyproject.toml").alias("path"), F.concat(F.lit('[project]\nname = "p"\ndependencies = ['), F.array_join(quoted, ", "), F.lit(']\n[build-system]\nrequires = ["wheel", "cython"]\n')).alias("text"))
    return plain.unionByName(project).withColumn("file_role", F.lit("dependency_manifest")).withColumn("file_no", F.when(F.col("path") == "pyproject.toml", 0).otherwise(1))


_LINES = """l AS (SELECT 'repo' || o_custkey AS repo, 'pkg-' || o_orderkey % 97 AS name, CASE WHEN o_orderkey % 3 = 0 THEN '==' || o_orderkey % 5 WHEN o_orderkey % 7 = 0 THEN '[extra]>1  # why' ELSE '' END AS rest FROM orders)"""


@query(
    "requirement_parse",
    f"""WITH {_LINES} SELECT repo, name, nullif(regexp_replace(replace(min(rest), '[extra]', ''), '\\s+#.*', ''), '') AS version_spec, 'runtime' AS dep_group, 2 * count(*)::INT AS sources FROM l GROUP BY repo, name
    UNION ALL SELECT DISTINCT repo, 'cython', NULL, 'build', 1 FROM l""",
)
def requirement_parse(spark: SparkSession, sf: str) -> DataFrame:
    files = _manifests(spark, sf)
    found = findings(files).join(files.select("repo", "path", "file_no"), ["repo", "path"])
    merged = dependencies(found).select("repo", F.explode("dependencies").alias("d"))
    return merged.select("repo", "d.name", "d.version_spec", "d.dep_group", F.size("d.sources").alias("sources"))


@query(
    "manifest_findings",
    f"""WITH {_LINES}, r AS (SELECT count(DISTINCT repo) AS repos, count(*) AS lines FROM l)
    SELECT * FROM (SELECT 'requirements.txt' AS path, 'need' AS kind, lines AS n FROM r UNION ALL SELECT 'pyproject.toml', 'need', lines + repos FROM r
      UNION ALL SELECT unnest(['requirements.txt', 'pyproject.toml']), 'verdict', repos FROM r UNION ALL SELECT 'pyproject.toml', 'software', repos FROM r)""",
)
def manifest_findings(spark: SparkSession, sf: str) -> DataFrame:
    return findings(_manifests(spark, sf)).groupBy("path", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    "zip_members",
    """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages)
    SELECT page_id, 'index.html' AS path, octet_length(encode(html)) AS size_bytes, sha256(html) AS digest FROM p UNION ALL SELECT page_id, 'meta/length.txt', length(length(html)::VARCHAR), sha256(length(html)::VARCHAR) FROM p""",
)
def zipped(spark: SparkSession, sf: str) -> DataFrame:
    """Each page's archive of two files, opened again."""

    def pack(batches):
        for batch in batches:
            out = []
            for html in batch.column(1).to_pylist():
                data = io.BytesIO()
                with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr("top/index.html", html or "")
                    z.writestr("top/meta/length.txt", str(len(html or "")))
                out.append(data.getvalue())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["page_id", "content"])

    archives = map_arrow(read(spark, sf, "pages").select("page_id", "html"), pack, "page_id bigint, content binary")
    return zip_members(archives, "page_id").select("page_id", "path", "size_bytes", F.sha2("content", 256).alias("digest"))


_RDF = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:dcterms="http://purl.org/dc/terms/" xmlns:h="https://terms.example.org/"><h:CollectionResource>%s</h:CollectionResource></rdf:RDF>'


@query("rdf_relations", "SELECT s_nationkey, 'dcterms:hasPart' AS predicate_qname, 'http://x.org/resource/' || md5(s_suppkey::VARCHAR) AS target, 'uri_ref' AS rdf_object_kind FROM supplier")
def rdf_relations(spark: SparkSession, sf: str) -> DataFrame:
    """Each supplier as a collection whose parts are the suppliers of the same nation."""
    part = F.concat(F.lit('<dc:relation><rdf:Description><dcterms:hasPart rdf:resource="http://x.org/resource/'), F.md5(F.col("s_suppkey").cast("string")), F.lit('"/></rdf:Description></dc:relation>'))
    head, _, tail = _RDF.partition("%s")
    docs = read(spark, sf, "supplier").groupBy("s_nationkey").agg(F.concat(F.lit(head), F.array_join(F.array_sort(F.collect_list(part)), ""), F.lit(tail)).alias("xml"))
    found = with_semantics(docs, "s_nationkey", "xml")
    return found.select("s_nationkey", F.explode("semantics.typed_relations").alias("r")).select("s_nationkey", "r.predicate_qname", "r.target", "r.rdf_object_kind")


@query(
    "model_answers",
    r"""WITH c AS (SELECT conv_id AS paper_id, CASE WHEN turn % 2 = 0 THEN 'Method' ELSE 'Result' END AS kind, repeat(text, 4) AS text, role FROM conversations WHERE conv_id % 3 < 2),
    j AS (SELECT *, '{"chunk_type":"' || kind || '","text":' || CAST(to_json(text) AS VARCHAR) || ',"supporting_quote":["' || role || '"]}' AS said, regexp_replace(text, '^\s+|\s+$', '', 'g') AS bare FROM c),
    k AS (SELECT *, CASE WHEN length(bare) > 1500 THEN regexp_replace(left(bare, 1500), '\s+$', '') ELSE bare END AS body FROM j),
    p AS (SELECT *, row_number() OVER (PARTITION BY paper_id, kind ORDER BY said) AS place FROM k WHERE length(body) >= 120)
    SELECT paper_id, kind AS chunk_type, paper_id || '__' || kind || '__' || place AS chunk_id, length(body)::INT AS n_chars FROM p WHERE place <= CASE kind WHEN 'Method' THEN 8 ELSE 10 END""",
)
def model_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as recorded answers of a model: fenced, with prose around, or broken."""
    turns = read(spark, sf, "conversations")
    chunk = F.to_json(F.struct(F.when(F.col("turn") % 2 == 0, "Method").otherwise("Result").alias("chunk_type"), F.repeat("text", 4).alias("text"), F.array("role").alias("supporting_quote")))
    listed = turns.groupBy(F.col("conv_id").alias("paper_id")).agg(F.array_join(F.array_sort(F.collect_list(chunk)), ",").alias("all"))
    whole = F.concat(F.lit('{"chunks":['), "all", F.lit("]}"))
    answer = F.when(F.col("paper_id") % 3 == 0, F.concat(F.lit("```json\n"), whole, F.lit("\n```"))).when(F.col("paper_id") % 3 == 1, F.concat(F.lit("Sure: "), whole, F.lit(" Done."))).otherwise(F.concat(F.lit("{"), whole))
    return chunks(listed.select("paper_id", answer.alias("answer"))).select("paper_id", "chunk_type", "chunk_id", F.length("text").alias("n_chars"))


