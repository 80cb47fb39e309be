"""Catalogue: readers and writers, run against each other. What is written comes from the driver tables, so SQL says what must
be read again. Files lie in a folder of their own below the shared checkpoint folder."""

from __future__ import annotations

import uuid
import xml.etree.ElementTree as ET
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as graphs_of
from ..operators import metrics
from ..session import checkpoint_dir
from ..sources import files, graphs, service, sinks
from ..streaming import resume
from . import ontology, papers, repositories, star
from .registry import query
from .star import read


def _folder(spark: SparkSession, label: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/graphloom-{label}-{uuid.uuid4().hex}"


def _local(path: str) -> str:
    """Of a folder on this machine, its path; transports over files take no URI."""
    return path.removeprefix("file://").removeprefix("file:")


def _nations(spark: SparkSession, sf: str) -> list:
    """The rows of a dimension table, 25 of them."""
    return read(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey").collect()


@query(
    "store_graph_document",
    """SELECT 'node' AS kind, 'nation:' || n_nationkey AS id, 'Nation' AS type, '{"identifier":' || n_nationkey || ',"name":"' || n_name || '"}' AS attributes, 'curated' AS status FROM nation
    UNION ALL SELECT 'node', 'region:' || r_regionkey, 'Region', '{"identifier":' || r_regionkey || ',"name":"' || r_name || '"}', 'curated' FROM region
    UNION ALL SELECT 'edge', 'nation:' || n_nationkey || '>region:' || n_regionkey, 'partOf', '{}', NULL FROM nation""",
)
def graph_document(spark: SparkSession, sf: str) -> DataFrame:
    """A graph written as one document and read again."""
    path = f"{_folder(spark, 'graph')}/graph.json"
    nodes = graphs_of.merge_nodes(star.nodes(spark, sf).filter("class IN ('Nation', 'Region')"))
    edges = star.edges(spark, sf, with_id=True).filter("relation = 'partOf'").withColumn("evidence", F.lit(None).cast(graphs_of.EVIDENCE)).withColumn("attributes", F.create_map().cast("map<string,string>"))
    sinks.write_graph(*graphs.document(nodes, edges), path)
    nodes, edges = graphs.read_graph(spark, path)
    shown = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_keys("attributes")), lambda k: F.concat(F.lit('"'), k, F.lit('":'), F.col("attributes")[k])), ","), F.lit("}"))
    return nodes.select(F.lit("node").alias("kind"), "id", F.col("class").alias("type"), shown.alias("attributes"), F.col("curation_status").alias("status")).unionByName(
        edges.select(F.lit("edge").alias("kind"), F.concat("source", F.lit(">"), "target").alias("id"), F.col("relation").alias("type"), shown.alias("attributes"), F.lit(None).cast("string").alias("status"))
    )


@query("store_json_records", "SELECT s_suppkey, s_name, s_nationkey FROM supplier UNION ALL SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def json_records(spark: SparkSession, sf: str) -> DataFrame:
    """Records as a list, and as the list under a name that an object holds, read again."""
    folder, rows = _folder(spark, "records"), read(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    sinks.write_json_records(rows, f"{folder}/list.json", ["s_suppkey"])
    named = rows.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.lpad(F.col("s_suppkey").cast("string"), 9, "0").alias("key"), F.struct(*rows.columns).alias("value"))))).alias("m")).select(F.to_json("m").alias("value"))
    named.coalesce(1).write.text(f"{folder}/named")
    schema = "s_suppkey bigint, s_name string, s_nationkey bigint"
    both = [files.json_records(spark, f"{folder}/{n}", schema) for n in ("list.json", "named")]
    return both[0].unionByName(both[1])


@query(
    "store_id_list",
    """SELECT 'id' AS kind, md5(n_name) AS id, n_nationkey * 2 AS ord FROM nation UNION ALL SELECT 'odd', 'short' || n_nationkey, n_nationkey * 2 + 1 FROM nation""",
)
def id_list(spark: SparkSession, sf: str) -> DataFrame:
    """A list of ids in any case with odd ones between; later mentions of an id do not count."""
    import hashlib

    folder, names = _folder(spark, "ids"), [r["n_name"] for r in _nations(spark, sf)]
    digest = lambda n: hashlib.md5(n.encode()).hexdigest()
    lines = [x for k, n in enumerate(names) for x in (f"{digest(n).upper()},{n}", f"short{k}")]
    sinks.write_files(spark, folder, {"ids.csv": "\ufeff" + "\r\n".join([*lines, *map(digest, names), ""])})
    place = f"{folder}/ids.csv"
    found = files.id_list(spark, place).select(F.lit("id").alias("kind"), "id", F.col("ord").cast("bigint").alias("ord"))
    return found.unionByName(files.odd_ids(spark, place).select(F.lit("odd").alias("kind"), "id", F.col("ord").cast("bigint").alias("ord")))


@query(
    "store_texts",
    """SELECT 'r' || n_regionkey AS repo, 'docs/' || n_nationkey || '.txt' AS path, true AS is_content, 'é ' || n_name || chr(10) || 'end' AS text FROM nation WHERE n_regionkey < 3
    UNION ALL SELECT 'r' || r_regionkey, 'repo_metadata.json', false, '{}' FROM region WHERE r_regionkey < 3""",
)
def texts(spark: SparkSession, sf: str) -> DataFrame:
    """Repository folders of files in two encodings with any line ends; some repositories are asked for."""
    folder = _folder(spark, "folders")
    contents: dict[str, str | bytes] = {}
    for r in _nations(spark, sf):
        text = f"é {r['n_name']}\r\nend"
        contents[f"r{r['n_regionkey']}/contents/docs/{r['n_nationkey']}.txt"] = text.encode("latin-1") if r["n_nationkey"] % 2 else b"\xef\xbb\xbf" + text.encode()
        contents[f"r{r['n_regionkey']}/repo_metadata.json"] = "{}"
    sinks.write_files(spark, folder, contents)
    return repositories.raw_files(spark, folder, ("r0", "r1", "r2"))


@query(
    "store_paged_service",
    """SELECT n_nationkey AS id, n_name AS name, 'o/' || n_name AS full_name, n_nationkey * 3 AS size_kb, CASE WHEN n_nationkey % 2 = 0 THEN 'sha' || n_nationkey END AS head FROM nation WHERE lower(n_name) NOT IN ('france', 'china')""",
)
def paged_service(spark: SparkSession, sf: str) -> DataFrame:
    """Listed repositories, ten a page, and the commits at their heads; some are empty and have none."""
    import json

    folder, rows = _folder(spark, "service"), _nations(spark, sf)
    items = [{"id": r["n_nationkey"], "name": r["n_name"], "full_name": f"o/{r['n_name']}", "default_branch": "main", "size": r["n_nationkey"] * 3} for r in rows]
    pages = {f"orgs/o/repos/{at // 10 + 1}.json": json.dumps(items[at : at + 10]) for at in range(0, len(items), 10)}
    heads = {f"{service.commit_path(x['full_name'], 'main')}/1.json": json.dumps({"sha": f"sha{x['id']}"}) for x in items if x["id"] % 2 == 0}
    sinks.write_files(spark, folder, pages | heads)
    listed = service.repositories(service.paged(spark, ["orgs/o/repos"], folder=_local(folder)), ("France", "CHINA"))
    commits = service.head_commits(spark, listed.select("full_name", F.col("default_branch").alias("branch")), folder=_local(folder))
    return listed.join(commits, "full_name").select("id", "name", "full_name", "size_kb", F.col("sha").alias("head"))


@query(
    "store_archives",
    """SELECT 'o/' || n_nationkey AS full_name, CASE WHEN n_nationkey % 5 = 0 THEN 'skipped' WHEN n_nationkey % 5 = 1 THEN 'failed' ELSE 'success' END AS status, CASE WHEN n_nationkey % 5 > 1 THEN 'a.txt=' || n_name END AS members FROM nation""",
)
def archives(spark: SparkSession, sf: str) -> DataFrame:
    """Snapshots pinned by commit: some repositories have no commit, some archives are not there."""
    import io
    import zipfile

    folder, contents, commits = _folder(spark, "archives"), {}, []
    for r in _nations(spark, sf):
        k = r["n_nationkey"]
        commits.append((f"o/{k}", None if k % 5 == 0 else f"sha{k}"))
        if k % 5 > 1:
            data = io.BytesIO()
            with zipfile.ZipFile(data, "w") as z:
                z.writestr("top/a.txt", r["n_name"])
            contents[f"o/{k}/sha{k}.zip"] = data.getvalue()
    sinks.write_files(spark, folder, contents)
    get = service.bytes_from_files(_local(folder))
    got = service.archives(spark.createDataFrame(commits, "full_name string, sha string"), lambda name, sha: get(name, f"{sha}.zip"))
    members = files.zip_members(got.filter("status = 'success'"), "full_name")
    listed = members.groupBy("full_name").agg(F.array_join(F.array_sort(F.collect_list(F.concat("path", F.lit("="), F.col("content").cast("string")))), ",").alias("members"))
    return got.select("full_name", "status").join(listed, "full_name", "left")


@query(
    "store_dataset_parts",
    """SELECT 'd' || n_nationkey AS resource_id, 'meta_dump.json' AS name, '{"n": ' || n_nationkey || '}' AS text, false AS failed FROM nation UNION ALL SELECT 'd' || n_nationkey, unnest(['sys_meta_dump.json', 'raw_metadata.xml']), NULL, true FROM nation
    UNION ALL SELECT 'd' || n_nationkey, 'file_inventory.json', CASE WHEN n_nationkey % 3 = 0 THEN '[]' ELSE '[{"file_name": "ReadMe.md", "extension": ".md"}, {"file_name": "x.csv", "extension": ".csv"}]' END, n_nationkey % 3 = 0 FROM nation
    UNION ALL SELECT 'd' || n_nationkey, 'ReadMe.md', CASE WHEN n_nationkey % 3 = 1 THEN '# ' || n_name END, n_nationkey % 3 <> 1 FROM nation WHERE n_nationkey % 3 > 0""",
)
def dataset_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of dataset resources, each with its own failures."""
    import json

    folder, rows, contents = _folder(spark, "parts"), _nations(spark, sf), {}
    for r in rows:
        k = r["n_nationkey"]
        contents[f"d{k}/meta_dump.json"] = json.dumps({"n": k})
        if k % 3:
            contents[f"d{k}/file_inventory.json"] = json.dumps([{"file_name": "ReadMe.md", "extension": ".md"}, {"file_name": "x.csv", "extension": ".csv"}])
        if k % 3 == 1:
            contents[f"d{k}/ReadMe.md"] = f"# {r['n_name']}"
    sinks.write_files(spark, folder, contents)
    ids = spark.createDataFrame([(f"d{r['n_nationkey']}",) for r in rows], "resource_id string")
    return service.dataset_parts(ids, service.bytes_from_files(_local(folder))).select("resource_id", "name", "text", F.col("error").isNotNull().alias("failed"))


@query("store_download_report", "SELECT CASE n_nationkey % 5 WHEN 0 THEN 'skipped' WHEN 1 THEN 'failed' ELSE 'success' END AS status, count(*) AS n, CASE WHEN n_nationkey % 5 < 2 THEN string_agg(n_name, ',' ORDER BY n_name) ELSE '' END AS names FROM nation GROUP BY 1, n_nationkey % 5 < 2, CASE n_nationkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END, CASE WHEN n_nationkey % 5 < 2 THEN n_nationkey % 5 END".replace("CASE WHEN n_nationkey % 5 < 2 THEN string_agg(n_name, ',' ORDER BY n_name) ELSE '' END", "coalesce(string_agg(n_name, ',' ORDER BY n_name) FILTER (n_nationkey % 5 < 2), '')"))
def download_report(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "nation").select("n_name", F.when(F.col("n_nationkey") % 5 == 0, "skipped").when(F.col("n_nationkey") % 5 == 1, "failed").otherwise("success").alias("status"), F.lit(None).cast("string").alias("error"))
    counts, others = service.download_report(rows, "n_name")
    listed = others.groupBy("status").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("names"))
    return counts.join(listed, "status", "left").select("status", "n", F.coalesce("names", F.lit("")).alias("names"))


@query("store_resumed_run", "SELECT s_suppkey, s_suppkey * 2 AS twice FROM supplier")
def resumed_run(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs, of which the second does what the first has left; then a stream over the files of both."""
    folder = _folder(spark, "runs")
    rows, step = read(spark, sf, "supplier").select("s_suppkey"), lambda df: df.withColumn("twice", F.col("s_suppkey") * 2)
    first = resume.run_pending(spark, rows.filter("s_suppkey % 3 = 0"), "s_suppkey", step, f"{folder}/done")
    second = resume.run_pending(spark, rows, "s_suppkey", step, f"{folder}/done")
    assert resume.run_pending(spark, rows, "s_suppkey", step, f"{folder}/done") == 0 and first + second == rows.count()
    for _ in range(2):  # a second run of the stream finds no new file
        resume.stream_files(spark, f"{folder}/done", "s_suppkey bigint, twice bigint", lambda df: df, f"{folder}/streamed", f"{folder}/seen")
    return spark.read.parquet(f"{folder}/streamed")


@query(
    "store_trajectory",
    """WITH s AS (SELECT r_regionkey, count(n_nationkey) AS nodes FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1)
    SELECT row_number() OVER (ORDER BY CASE WHEN r_regionkey < 3 THEN 9 - r_regionkey ELSE 1000000 END, 'r' || r_regionkey) - 1 AS place, '| r' || r_regionkey || ' | ' || nodes || ' | 0 | 2.000000 | 0.000000 | 1.000000 |' AS line FROM s""",
)
def trajectory(spark: SparkSession, sf: str) -> DataFrame:
    """Snapshots of the graph of each region, written and read again in their order, as lines of a table."""
    folder = _folder(spark, "snapshots")
    all_nodes = star.nodes(spark, sf).filter("class = 'Nation'").join(read(spark, sf, "nation").select(star.node_key("Nation", F.col("n_nationkey")).alias("id"), "n_regionkey"), "id")
    none = star.edges(spark, sf, with_id=True).limit(0)
    for k in sorted({r["n_regionkey"] for r in _nations(spark, sf)}):
        nodes = all_nodes.filter(F.col("n_regionkey") == k).drop("n_regionkey").withColumn("attributes", F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit('"x"'), F.lit("c"), F.lit('" "')))
        sinks.write_snapshot(metrics.snapshot_record(nodes, none, f"r{k}", order=9 - k if k < 3 else None), _local(folder))
    lines = sinks.trajectory_table(_local(folder)).splitlines()[2:]
    return spark.createDataFrame(list(enumerate(lines)), "place bigint, line string")


@query(
    "store_schema_document",
    """WITH n AS (SELECT n_nationkey AS k FROM nation) SELECT 'ObjectProperty' AS kind, 3 + count(DISTINCT k % 7) FILTER (k % 7 < 6) AS n FROM n UNION ALL SELECT 'DatatypeProperty', 2 + count(DISTINCT k % 4) + count(DISTINCT k % 7) FILTER (k % 7 = 6) FROM n
    UNION ALL SELECT 'AnnotationProperty', 7 UNION ALL SELECT 'Ontology', 1 UNION ALL SELECT 'Restriction', (SELECT count(*) FROM n WHERE k % 5 <> 2 AND k % 3 < 2) + (SELECT count(*) FROM region) + (SELECT count(*) FROM n WHERE k % 7 IN (SELECT k % 7 FROM n WHERE k % 7 < 6 GROUP BY 1 HAVING bool_or(k % 6 = 0)))""",
)
def schema_document(spark: SparkSession, sf: str) -> DataFrame:
    """A compiled schema written as RDF/XML; what is declared in the document, by kind."""
    from .schema_queries import _compiled

    path = Path(_local(_folder(spark, "schema"))) / "schema.owl"
    path.parent.mkdir(parents=True)
    ontology.write_rdfxml(_compiled(spark, sf).triples, str(path))
    kinds: dict[str, int] = {}
    for e in ET.parse(path).getroot().iter(f"{{{ontology.RDF}}}type"):
        kind = e.get(f"{{{ontology.RDF}}}resource").rpartition("#")[2]
        kinds[kind] = kinds.get(kind, 0) + 1
    return spark.createDataFrame([x for x in kinds.items() if x[0] != "Class"], "kind string, n bigint")


@query(
    "store_papers",
    """SELECT CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey::VARCHAR ELSE n_name END AS paper_id, 'Extract.' || chr(10) || chr(10) || 'paper_id: ' || CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey::VARCHAR ELSE n_name END || chr(10) || chr(10) || '# ' || n_name AS prompt
    FROM nation ORDER BY n_nationkey % 2, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey ELSE 0 END, n_name LIMIT 16""",
)
def read_papers(spark: SparkSession, sf: str) -> DataFrame:
    """The first papers of a folder, numbers before names, as prompts."""
    folder, contents = _folder(spark, "papers"), {}
    for r in _nations(spark, sf):
        name = str(r["n_nationkey"]) if r["n_nationkey"] % 2 == 0 else r["n_name"]
        contents[f"{name}/markdown/{name}_md.md"] = f"# {r['n_name']}"
        contents[f"{name}/other.md"] = "no paper"
    sinks.write_files(spark, folder, contents)
    return papers.prompts(papers.read_papers(spark, folder, 16), "Extract.")


@query(
    "store_answers",
    """SELECT n_nationkey AS paper_id, CASE n_nationkey % 4 WHEN 3 THEN '' ELSE n_name END AS title, CASE n_nationkey % 4 WHEN 3 THEN '' ELSE 'k' || n_nationkey END AS keywords, CASE n_nationkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END::BIGINT AS calls, n_nationkey % 4 = 3 AS failed FROM nation""",
)
def answers(spark: SparkSession, sf: str) -> DataFrame:
    """A model that rejects some parameters, or all: which call it answers, and what of its answers is metadata."""
    import json

    def model(prompt: str, effort: bool, temperature: bool) -> str:
        key, name = prompt.split("|")
        if int(key) % 4 == 3 or int(key) % 4 > 0 and temperature or int(key) % 4 > 1 and effort:
            raise ValueError("rejected")
        return json.dumps({"title": f" {name} ", "keywords": [f"k{key}"], "abstract": f"{effort}{temperature}"})

    asked = read(spark, sf, "nation").select(F.col("n_nationkey").alias("paper_id"), F.concat(F.col("n_nationkey").cast("string"), F.lit("|"), "n_name").alias("prompt"))
    said = papers.answered(asked, model)
    told = papers.metadata(said).join(said.select("paper_id", "error"), "paper_id")
    calls = F.when(F.col("abstract") == "TrueTrue", 1).when(F.col("abstract") == "TrueFalse", 2).otherwise(3).cast("bigint")
    return told.select("paper_id", "title", F.array_join("keywords", ",").alias("keywords"), calls.alias("calls"), F.col("error").isNotNull().alias("failed"))


@query(
    "allowed_entities",
    """SELECT p_partkey, p_brand AS category, p_type AS class FROM part WHERE (p_brand, p_type) IN (SELECT p_brand, p_type FROM part WHERE p_size > 25)""",
)
def allowed(spark: SparkSession, sf: str) -> DataFrame:
    parts = read(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("category"), F.col("p_type").alias("class"), "p_size")
    return papers.allowed_entities(parts.drop("p_size"), parts.filter("p_size > 25").select("category", "class"))
