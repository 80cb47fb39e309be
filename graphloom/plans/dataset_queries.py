"""Catalogue: dataset records made from orders and run through the extraction rules, and requirement lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, requirements
from .extraction import RECORD, Graph, extract, extract_edges
from .registry import query
from .star import read


def _records(spark: SparkSession, sf: str) -> DataFrame:
    """One record an order: the customer is its creator, its lines are files, its neighbours are related."""
    orders = read(spark, sf, "orders")
    files = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_set(F.concat(F.lit("f/"), F.col("l_linenumber").cast("string"), F.lit(".csv")))).alias("names"))
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    cat = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    none = F.lit(None).cast("string")
    name = cat("Customer ", c)
    status = F.col("o_orderstatus")

    def relation(predicate: str, explicit=none, target=none):
        return F.struct(F.lit(predicate).alias("predicate_qname"), none.alias("relation_label"), explicit.alias("target_resource_id"), target.alias("target"), F.array().cast("array<string>").alias("embedded_urls"))

    some = lambda when, r: F.when(when, F.array(r)).otherwise(F.array())
    relations = F.concat(
        some(k % 4 == 0, relation("dcterms:isPartOf", F.md5(cat("r", (k - 1).cast("string"))))),
        some(k % 5 == 0, relation("dcterms:references", target=cat("doi:10.1234/x", (F.col("o_custkey") % 50).cast("string")))),
        some(k % 5 == 1, relation("dcterms:source", target=cat("http://data.org/", (F.col("o_custkey") % 20).cast("string")))),
        some(k % 5 == 2, relation("dcterms:requires", target=F.lit("nothing to be found"))),
    )
    given = {
        "resource_id": F.md5(cat("r", k.cast("string"))),
        "resource_type": F.when(status == "F", "CompositeResource").when(status == "O", "CollectionResource").otherwise("ToolResource"),
        "title": cat("Order ", k.cast("string")),
        "creators": F.array(F.struct(name.alias("name"), F.lit(1).cast("bigint").alias("creator_order"), none.alias("user_id"), cat("Org ", (F.col("o_custkey") % 10).cast("string")).alias("organization"), F.array().cast("array<struct<id_type:string,url:string>>").alias("identifiers"))),
        "creator_identifiers": F.when(k % 6 == 0, F.array(F.struct(name.alias("person_name"), F.lit("GoogleScholarID").alias("id_type"), cat("http://s/", c).alias("url")), F.struct(name.alias("person_name"), F.lit("Other").alias("id_type"), c.alias("url")))),
        "rights": F.struct(cat("L", (k % 3).cast("string")).alias("statement"), none.alias("url")),
        "subjects": F.array("o_orderpriority"),
        "files": F.when(status == "F", F.transform("names", lambda n: F.struct(none.alias("checksum"), F.lit(".csv").alias("extension"), n.alias("file_name"), n.alias("file_path")))),
        "typed_relations": relations,
    }
    joined = orders.join(files, F.col("o_orderkey") == F.col("k"), "left")
    empty = spark.createDataFrame([], RECORD)
    config = F.when(status == "P", F.struct(*[(cat("https://app", (F.col("o_custkey") % 7).cast("string"), ".org/run") if f.name == "app_home_page_url" else F.lit(None).cast(f.dataType)).alias(f.name) for f in empty.schema["tool_config"].dataType.fields]))
    given["tool_config"] = config
    return joined.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in empty.schema.fields])


def _graph(spark: SparkSession, sf: str) -> Graph:
    return extract(_records(spark, sf))


@query(
    "dataset_graph_nodes",
    """WITH o AS (SELECT * FROM orders), t AS (SELECT DISTINCT o_orderkey - 1 AS k FROM o WHERE o_orderkey % 4 = 0)
    SELECT 'DatasetResource' AS class, 'curated' AS curation_status, count(*) AS n FROM o
    UNION ALL SELECT 'DatasetResource', 'referenced', (SELECT count(*) FROM t WHERE k NOT IN (SELECT o_orderkey FROM o)) + (SELECT count(DISTINCT o_custkey % 20) FROM o WHERE o_orderkey % 5 = 1)
    UNION ALL SELECT 'ResourceType', 'curated', count(DISTINCT o_orderstatus) FROM o
    UNION ALL SELECT 'Person', 'curated', count(DISTINCT o_custkey) FROM o
    UNION ALL SELECT 'Organization', 'curated', count(DISTINCT o_custkey % 10) FROM o
    UNION ALL SELECT 'Subject', 'curated', count(DISTINCT o_orderpriority) FROM o
    UNION ALL SELECT 'License', 'curated', count(DISTINCT o_orderkey % 3) FROM o
    UNION ALL SELECT 'DatasetFile', 'curated', count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem JOIN o ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F')
    UNION ALL SELECT 'ToolConfiguration', 'curated', count(*) FROM o WHERE o_orderstatus NOT IN ('F', 'O') HAVING count(*) > 0
    UNION ALL SELECT 'Tool', 'curated', count(DISTINCT o_custkey % 7) FROM o WHERE o_orderstatus NOT IN ('F', 'O') HAVING count(*) > 0
    UNION ALL SELECT 'Paper', 'referenced', count(DISTINCT o_custkey % 50) FROM o WHERE o_orderkey % 5 = 0
    UNION ALL SELECT 'Identifier', 'curated', count(DISTINCT o_custkey) FROM o WHERE o_orderkey % 6 = 0""",
)
def dataset_graph_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return _graph(spark, sf).nodes.groupBy("class", "curation_status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "dataset_graph_edges",
    """WITH o AS (SELECT * FROM orders)
    SELECT r AS relation, count(*) AS n FROM o CROSS JOIN (VALUES ('hasResourceType'), ('hasCreator'), ('hasSubject'), ('hasLicense')) v(r) GROUP BY r
    UNION ALL SELECT 'affiliatedWith', count(DISTINCT o_custkey) FROM o
    UNION ALL SELECT 'hasFile', count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem JOIN o ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F')
    UNION ALL SELECT r, count(*) FROM o CROSS JOIN (VALUES ('hasToolConfig'), ('launchesApp')) v(r) WHERE o_orderstatus NOT IN ('F', 'O') GROUP BY r
    UNION ALL SELECT 'isMemberOf', count(*) FROM o WHERE o_orderkey % 4 = 0
    UNION ALL SELECT 'references', count(*) FROM o WHERE o_orderkey % 5 IN (0, 1)
    UNION ALL SELECT 'hasIdentifier', count(DISTINCT o_custkey) FROM o WHERE o_orderkey % 6 = 0""",
)
def dataset_graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    return extract_edges(_records(spark, sf), told=False).groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


@query("dataset_graph_skips", "SELECT 'unmapped_person_identifier:Other' AS reason, count(*) AS n FROM orders WHERE o_orderkey % 6 = 0 UNION ALL SELECT 'deferred_to_llm:reference_target:dcterms:requires', count(*) FROM orders WHERE o_orderkey % 5 = 2")
def dataset_graph_skips(spark: SparkSession, sf: str) -> DataFrame:
    return _graph(spark, sf).skipped


@query(
    "requirement_lines",
    r"""WITH l AS (SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN 'Pkg_' || o_custkey || '==1  # pinned' WHEN 1 THEN 'git+https://github.com/Org/R' || o_custkey || '.git@v1#egg=x  # y' WHEN 2 THEN '  A.b-' || o_custkey || '  ' WHEN 3 THEN '# only a comment' ELSE 'x#y' END AS line FROM orders),
    u AS (SELECT k, line, regexp_replace(CASE WHEN contains(line, '://') AND contains(line, '#egg=') THEN line ELSE regexp_replace(line, '\s+#.*$', '') END, '^\s+|\s+$', '', 'g') AS text FROM l)
    SELECT k, text, regexp_replace(lower(text), '[-_.]+', '-', 'g') AS canonical FROM u""",
)
def requirement_lines(spark: SparkSession, sf: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    line = (
        F.when(k % 5 == 0, F.concat(F.lit("Pkg_"), c, F.lit("==1  # pinned")))
        .when(k % 5 == 1, F.concat(F.lit("git+https://github.com/Org/R"), c, F.lit(".git@v1#egg=x  # y")))
        .when(k % 5 == 2, F.concat(F.lit("  A.b-"), c, F.lit("  ")))
        .when(k % 5 == 3, "# only a comment")
        .otherwise("x#y")
    )
    text = requirements.uncommented(line)
    return read(spark, sf, "orders").select(k.alias("k"), text.alias("text"), requirements.canonical_name(text).alias("canonical"))


@query(
    "vcs_url_normalise",
    """SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN 'https://github.com/o/r' || s_suppkey WHEN 1 THEN 'https://github.com/o/r' || s_suppkey WHEN 2 THEN 'https://github.com/o/r' || s_suppkey WHEN 3 THEN 'ssh://git@host/o/r' || s_suppkey WHEN 4 THEN 'https://x.org/r' || s_suppkey ELSE 'https://u@x.org/r' || s_suppkey END AS url,
    CASE s_suppkey % 3 WHEN 0 THEN 'https://github.com/o/r' || s_suppkey || '/tree/c' || s_suppkey END AS pinned FROM supplier""",
)
def vcs_url_normalise(spark: SparkSession, sf: str) -> DataFrame:
    k, key = F.col("s_suppkey"), F.col("s_suppkey").cast("string")
    cat = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    raw = (
        F.when(k % 6 == 0, cat(" git+https://github.com/o/r", key, ".git@main "))
        .when(k % 6 == 1, cat("git@github.com:o/r", key, ".git"))
        .when(k % 6 == 2, cat("git+https://github.com/o/r", key, "#egg=x&subdirectory=y"))
        .when(k % 6 == 3, cat("git+ssh://git@host/o/r", key, ".git"))
        .when(k % 6 == 4, cat("https://x.org/r", key, "/"))
        .otherwise(cat("https://u@x.org/r", key))
    )
    pinned = requirements.pinned_address(F.when(k % 3 == 0, cat("https://github.com/o/r", key, "/")), F.when(k % 3 != 1, cat("c", key)))
    return read(spark, sf, "supplier").select("s_suppkey", requirements.repository_url(raw).alias("url"), pinned.alias("pinned"))


@query(
    "conda_requirement",
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 3 THEN NULL ELSE 'part-' || p_size END AS name, CASE p_partkey % 4 WHEN 0 THEN '1.' || p_size WHEN 1 THEN '2=py_0' END AS version,
    p_partkey % 5 IN (0, 1) AS spdx, p_partkey % 3 = 0 AS symlink FROM part""",
)
def conda_requirement(spark: SparkSession, sf: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    entry = F.when(k % 4 == 0, F.concat(F.lit(" Part_"), size, F.lit(" = 1."), size)).when(k % 4 == 1, F.concat(F.lit("part."), size, F.lit("=2=py_0"))).when(k % 4 == 2, F.concat(F.lit("PART-"), size, F.lit("="))).otherwise("# note")
    parts = requirements.conda_parts(entry)
    license_ = F.when(k % 5 == 0, "MIT").when(k % 5 == 1, "CC-BY-4.0").when(k % 5 == 2, "NOASSERTION").when(k % 5 == 3, "no spaces please")
    body = F.when(k % 3 == 0, " ../env.yml\n").when(k % 3 == 1, "../a\n../b").otherwise("name: x")
    return read(spark, sf, "part").select("p_partkey", parts["name"].alias("name"), parts["version"].alias("version"), requirements.is_spdx(license_).alias("spdx"), paths.symlink_as_text(body).alias("symlink"))
