"""Catalogue: operators on records and documents over the driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import json_object
from ..functions.values import json_text
from ..operators import documents, records
from ..streaming.resume import pending
from .extraction import reference_parts, reference_target
from .registry import query
from .star import read


def _key(x: str) -> Column:
    return F.col(x).cast("string")


@query(
    "corpus_diff",
    """WITH o AS (SELECT DISTINCT o_custkey % 25 AS repo, o_orderpriority || ':' || o_custkey AS path FROM orders WHERE o_orderstatus <> 'O'),
    n AS (SELECT DISTINCT o_custkey % 25 AS repo, o_orderpriority || ':' || o_custkey AS path FROM orders WHERE o_orderstatus <> 'F'),
    b AS (SELECT coalesce(o.repo, n.repo) AS repo, o.path AS old, n.path AS new FROM o FULL JOIN n ON o.repo = n.repo AND o.path = n.path)
    SELECT repo, count(*) FILTER (WHERE new IS NULL) AS removed, count(*) FILTER (WHERE old IS NULL) AS added, count(*) FILTER (WHERE old IS NOT NULL AND new IS NOT NULL) AS kept FROM b GROUP BY repo""",
)
def corpus_diff(spark: SparkSession, sf: str) -> DataFrame:
    orders = read(spark, sf, "orders").select((F.col("o_custkey") % 25).alias("repo"), F.concat_ws(":", "o_orderpriority", _key("o_custkey")).alias("path"), "o_orderstatus")
    return records.difference(orders.filter("o_orderstatus <> 'O'"), orders.filter("o_orderstatus <> 'F'"), ["repo", "path"], ["repo"])


@query(
    "dependency_merge",
    """WITH d AS (SELECT l_partkey % 500 AS name, l_linestatus = 'F' AS is_vcs, CASE l_returnflag WHEN 'A' THEN 'dev' WHEN 'N' THEN 'runtime' ELSE 'build' END AS dep_group,
      printf('%012d:%04d', l_orderkey, l_linenumber) AS ord, 'm' || l_suppkey AS path, l_shipdate::DATE::VARCHAR AS raw, l_quantity AS version FROM lineitem)
    SELECT name, is_vcs, arg_min(version, ord) AS version, CASE WHEN bool_or(dep_group = 'runtime') THEN 'runtime' WHEN bool_or(dep_group = 'dev') THEN 'dev' ELSE 'build' END AS dep_group,
      count(*) AS sources, min(path || ' ' || raw) AS first_source FROM d GROUP BY name, is_vcs""",
)
def dependency_merge(spark: SparkSession, sf: str) -> DataFrame:
    declared = read(spark, sf, "lineitem").select(
        (F.col("l_partkey") % 500).alias("name"),
        (F.col("l_linestatus") == "F").alias("is_vcs"),
        F.when(F.col("l_returnflag") == "A", "dev").when(F.col("l_returnflag") == "N", "runtime").otherwise("build").alias("dep_group"),
        # numbers of one width sort like their text
        (F.col("l_orderkey") * 10_000 + F.col("l_linenumber")).alias("ord"),
        F.concat(F.lit("m"), _key("l_suppkey")).alias("manifest_path"),
        F.col("l_shipdate").cast("date").cast("string").alias("raw_line"),
        F.col("l_quantity").alias("version"),
    )
    merged = records.merge_dependencies(declared, ["name", "is_vcs"])
    first = F.array_min(F.transform("sources", lambda s: F.concat_ws(" ", s["manifest_path"], s["raw_line"])))
    return merged.select("name", "is_vcs", "version", "dep_group", F.size("sources").cast("bigint").alias("sources"), first.alias("first_source"))


@query(
    "requirements_lock_class",
    """WITH m AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'N') AS marked, count(*) FILTER (WHERE l_linestatus = 'F') AS pinned, count(*) FILTER (WHERE l_tax < 0.01) AS transitive FROM lineitem GROUP BY 1)
    SELECT l_orderkey, n, marked, pinned, CASE WHEN marked >= greatest(1, floor(n * 0.8)) OR (n >= 60 AND pinned >= 60 AND transitive >= 2) THEN 'lock' ELSE 'direct' END AS classification FROM m""",
)
def requirements_lock_class(spark: SparkSession, sf: str) -> DataFrame:
    lines = read(spark, sf, "lineitem")
    found = records.lock_class(lines, ["l_orderkey"], F.col("l_returnflag") == "N", F.col("l_linestatus") == "F", F.col("l_tax") < 0.01)
    return found.select("l_orderkey", "n", "marked", "pinned", "classification")


@query(
    "relation_dedup_fields",
    """WITH e AS (SELECT l_orderkey AS resource, CASE l_returnflag WHEN 'A' THEN 'hasPart' WHEN 'N' THEN 'isPartOf' ELSE 'source' END AS predicate, l_partkey % 20 AS target, 0 AS field_rank, 'links' AS field, l_linenumber AS idx FROM lineitem WHERE l_linestatus = 'F'
      UNION ALL SELECT l_orderkey, CASE l_returnflag WHEN 'A' THEN 'hasPart' WHEN 'N' THEN 'isPartOf' ELSE 'source' END, l_partkey % 20, 1, 'typed', l_linenumber FROM lineitem)
    SELECT resource, predicate, target, field, idx FROM (SELECT *, row_number() OVER (PARTITION BY resource, predicate, target ORDER BY field_rank, idx) AS rn FROM e) WHERE rn = 1""",
)
def relation_dedup_fields(spark: SparkSession, sf: str) -> DataFrame:
    lines = read(spark, sf, "lineitem")
    predicate = F.when(F.col("l_returnflag") == "A", "hasPart").when(F.col("l_returnflag") == "N", "isPartOf").otherwise("source")
    entries = lines.select(F.col("l_orderkey").alias("resource"), predicate.alias("predicate"), (F.col("l_partkey") % 20).alias("target"), F.col("l_linenumber").alias("index"), "l_linestatus")
    found = records.relation_entries([("links", entries.filter("l_linestatus = 'F'").drop("l_linestatus")), ("typed", entries.drop("l_linestatus"))], ["resource", "predicate", "target"])
    return found.select("resource", "predicate", "target", "field", F.col("index").alias("idx"))


@query(
    "relation_predicates",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'dcterms:references' WHEN 1 THEN 'hsterms:isExecutedBy' END AS predicate FROM events""",
)
def relation_predicates(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    given = F.when(k % 4 == 0, "dcterms:references").when(k % 4 == 1, "")
    label = F.when(k % 4 == 2, "The content of this resource references").otherwise("  The content of this resource Can Be Executed By ")
    label = F.when(k % 4 == 3, F.lit(None).cast("string")).otherwise(label)
    return read(spark, sf, "events").select("event_id", records.relation_predicate(given, label).alias("predicate"))


@query(
    "resolve_reference_cascade",
    """SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'dataset' WHEN 1 THEN 'paper' WHEN 2 THEN 'paper' WHEN 3 THEN 'repository' WHEN 4 THEN 'external_dataset' WHEN 5 THEN 'citation' ELSE NULL END AS kind,
    CASE o_orderkey % 7 WHEN 0 THEN 'dataset:' || md5('r' || o_custkey) WHEN 1 THEN 'paper:doi:10-1234-p' || o_custkey WHEN 2 THEN 'paper:doi:10-5555-q' || o_custkey WHEN 3 THEN 'repository:github-com-org-r' || o_custkey
      WHEN 4 THEN 'dataset:url:' || substr(sha256('http://data.org/d' || o_custkey), 1, 20) WHEN 5 THEN 'paper:citation:' || substr(sha256('Somebody (2020), a title ' || o_custkey), 1, 20) END AS target FROM orders""",
)
def resolve_reference_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """One order of each kind: dataset id, DOI in the text, address with a DOI, code host, other address, citation, nothing."""
    k, c = F.col("o_orderkey") % 7, _key("o_custkey")
    cat = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    target = (
        F.when(k == 0, cat("https://datasets.example.org/resource/", F.md5(cat("r", c))))
        .when(k == 1, cat("Paper, doi:10.1234/P", c, "."))
        .when(k == 2, F.lit("see the linked paper"))
        .when(k == 3, cat("https://github.com/Org/R", c))
        .when(k == 4, cat("http://data.org/d", c))
        .when(k == 5, cat("Somebody (2020), a title ", c))
        .otherwise("plain words")
    )
    urls = F.when(k == 2, F.array(cat("https://doi.org/10.5555/q", c), F.lit("https://github.com/other"))).otherwise(F.array().cast("array<string>"))
    predicate = F.when(k == 5, "hsterms:isDescribedBy").otherwise("dcterms:references")
    parts = read(spark, sf, "orders").select("o_orderkey", predicate.alias("predicate"), reference_parts(F.lit(None).cast("string"), target, urls).alias("parts"))
    found = reference_target(F.col("predicate"), F.col("parts"))
    return parts.select("o_orderkey", found["kind"].alias("kind"), found["id"].alias("target"))


@query(
    "merge_relations_xml_meta",
    """WITH x AS (SELECT l_orderkey AS r, 't' || l_partkey % 30 AS target, l_returnflag AS predicate, min(l_linenumber) AS ord FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL),
    m AS (SELECT l_orderkey AS r, 't' || l_partkey % 30 AS target, l_linestatus || l_suppkey % 3 AS label, min(l_linenumber) AS ord FROM lineitem WHERE l_tax > 0.02 GROUP BY ALL),
    l AS (SELECT r, target, string_agg(label, ',' ORDER BY ord, label) AS labels FROM m GROUP BY r, target)
    SELECT x.r AS resource, x.target, x.predicate, coalesce(l.labels, '') AS labels, 'typed' AS origin FROM x LEFT JOIN l USING (r, target)
    UNION ALL SELECT r, target, NULL, label, 'stated' FROM m WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.r = m.r AND x.target = m.target)""",
)
def merge_relations(spark: SparkSession, sf: str) -> DataFrame:
    lines = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("resource"), F.concat(F.lit("t"), (F.col("l_partkey") % 30).cast("string")).alias("target"), F.col("l_linenumber").alias("ord"), "l_returnflag", "l_tax", F.concat("l_linestatus", (F.col("l_suppkey") % 3).cast("string")).alias("label"))
    typed = lines.filter("l_returnflag <> 'N'").select("resource", "target", F.col("l_returnflag").alias("predicate"), "ord")
    stated = lines.filter("l_tax > 0.02").select("resource", "target", "label", "ord")
    found = records.merge_relations(typed, stated, ["resource"])
    return found.select("resource", "target", "predicate", F.array_join("labels", ",").alias("labels"), "origin")


@query(
    "readme_dedup",
    r"""WITH d AS (SELECT source, lower(lang) || '-' || doc_id || '.md' AS name, regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '^\s+|\s+$', '', 'g') AS body FROM documents)
    SELECT source, min(name) AS name, count(*) AS copies FROM d GROUP BY source, body""",
)
def readme_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("source", F.concat(F.lower("lang"), F.lit("-"), _key("doc_id"), F.lit(".md")).alias("name"), "text")
    return documents.distinct_texts(docs, ["source"], "text", "name", copies="copies").select("source", "name", "copies")


@query(
    "primary_readme",
    """WITH d AS (SELECT source, CASE WHEN doc_id % 3 = 0 THEN 'Read' || doc_id || '.MD' ELSE 'read' || doc_id || '.txt' END AS name FROM documents)
    SELECT source, arg_min(name, (CASE WHEN lower(name) LIKE '%.md' THEN '0' ELSE '1' END) || lower(name) || name) AS name FROM d GROUP BY source""",
)
def primary_readme(spark: SparkSession, sf: str) -> DataFrame:
    key = _key("doc_id")
    name = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Read"), key, F.lit(".MD"))).otherwise(F.concat(F.lit("read"), key, F.lit(".txt")))
    return documents.primary_text(read(spark, sf, "documents").select("source", name.alias("name")), ["source"], "name")


@query(
    "readme_sections",
    r"""WITH t AS (SELECT conv_id, turn, role, CASE WHEN turn % 3 > 0 THEN text ELSE '' END AS own FROM conversations),
    n AS (SELECT *, lead(turn) OVER w AS next_turn, lead(own) OVER w AS next_own FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    s AS (SELECT conv_id, (turn - turn // 4)::INT AS section_id, (turn % 4)::INT AS heading_level, role AS heading, next_turn % 4 > turn % 4 AS deeper,
      regexp_replace(own || CASE WHEN next_turn % 4 = 0 THEN chr(10) || next_own ELSE '' END, '^\s+|\s+$', '', 'g') AS body FROM n WHERE turn % 4 > 0)
    SELECT conv_id, section_id, CASE WHEN heading_level > 1 THEN section_id - 1 END AS parent_section_id, heading, heading_level, repeat('#', heading_level) AS heading_marker, CASE WHEN body = '' THEN heading ELSE body END AS section_text, coalesce(deeper, false) AS has_children
    FROM s WHERE body <> '' OR coalesce(deeper, false)""",
)
def readme_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as documents: a turn is a heading, its depth from the turn's number, followed by its text."""
    turns = read(spark, sf, "conversations")
    marks = F.repeat(F.lit("#"), (F.col("turn") % 4).cast("int"))
    body = F.concat(F.when(F.col("turn") % 4 > 0, F.concat(marks, F.lit(" "), F.col("role"), F.lit("\n"))).otherwise(F.lit("---\n")), F.when(F.col("turn") % 3 > 0, F.col("text")).otherwise(F.lit("")))
    pieces = turns.select("conv_id", F.struct("turn", body.alias("body")).alias("p"))
    docs = pieces.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["body"]), "\n").alias("text"))
    return documents.sections(docs, "conv_id", "text")


_CAPS = {"Method": 3, "Result": 2, "Background": 1}


@query(
    "chunk_caps",
    r"""WITH c AS (SELECT conv_id % 40 AS paper_id, conv_id * 1000 + turn AS ord, CASE role WHEN 'user' THEN 'Method' WHEN 'assistant' THEN ' Result ' ELSE 'Other' END AS kind,
      regexp_replace(text || ' ' || text || ' ' || text, '^\s+|\s+$', '', 'g') AS t, turn FROM conversations),
    k AS (SELECT paper_id, ord, trim(kind) AS chunk_type, CASE WHEN length(t) > 1500 THEN regexp_replace(left(t, 1500), '\s+$', '') ELSE t END AS text FROM c WHERE turn % 5 <> 4),
    f AS (SELECT *, row_number() OVER (PARTITION BY paper_id, chunk_type ORDER BY ord) AS place FROM k WHERE chunk_type IN ('Method', 'Result') AND length(text) >= 120)
    SELECT paper_id, chunk_type, sha256(text) AS digest, paper_id || '__' || chunk_type || '__' || place AS chunk_id FROM f WHERE place <= CASE chunk_type WHEN 'Method' THEN 3 ELSE 2 END""",
)
def chunk_caps(spark: SparkSession, sf: str) -> DataFrame:
    turns = read(spark, sf, "conversations")
    quote = F.when(F.col("turn") % 5 == 4, '["", " "]').when(F.col("turn") % 2 == 0, json_text(F.col("role"))).otherwise(F.concat(F.lit('[" q ", 5, '), json_text(F.col("role")), F.lit("]")))
    chunks = turns.select(
        (F.col("conv_id") % 40).alias("paper_id"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"),
        F.when(F.col("role") == "user", "Method").when(F.col("role") == "assistant", " Result ").otherwise("Other").alias("chunk_type"),
        F.concat_ws(" ", "text", "text", "text").alias("text"),
        quote.alias("supporting_quote"),
        F.lit(None).cast("string").alias("section_hint"),
    )
    found = documents.normalise_chunks(chunks, _CAPS)
    return found.select("paper_id", "chunk_type", F.sha2("text", 256).alias("digest"), "chunk_id")


@query(
    "contributors_topk",
    """WITH c AS (SELECT user_id % 20 AS repo, user_id, count(*) AS contributions, min(event_id) AS first FROM events GROUP BY 1, 2)
    SELECT repo, user_id, contributions, place FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY first) AS place FROM c) WHERE place <= 10""",
)
def contributors_topk(spark: SparkSession, sf: str) -> DataFrame:
    users = read(spark, sf, "events").groupBy((F.col("user_id") % 20).alias("repo"), "user_id").agg(F.count(F.lit(1)).alias("contributions"), F.min("event_id").alias("first"))
    return records.top_in_order(users, ["repo"], [F.col("first")], 10).select("repo", "user_id", "contributions", F.col("place").cast("bigint").alias("place"))


@query(
    "contributors_sorted",
    """WITH c AS (SELECT DISTINCT user_id % 20 AS repo, CASE WHEN user_id % 7 <> 0 THEN user_id END AS id, 'u' || user_id AS login, event_type = 'click' AS is_bot FROM events)
    SELECT repo, id, login, is_bot, row_number() OVER (PARTITION BY repo ORDER BY (id IS NULL), coalesce(id, 0), login, is_bot) AS place FROM c""",
)
def contributors_sorted(spark: SparkSession, sf: str) -> DataFrame:
    user = F.col("user_id")
    people = read(spark, sf, "events").select((user % 20).alias("repo"), F.when(user % 7 != 0, user).alias("id"), F.concat(F.lit("u"), user.cast("string")).alias("login"), (F.col("event_type") == "click").alias("is_bot")).distinct()
    return records.placed(people, ["repo"], [F.col("id").isNull(), F.coalesce("id", F.lit(0)), F.col("login"), F.col("is_bot")])


@query("resume_anti_join", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    return pending(read(spark, sf, "documents").select("doc_id"), read(spark, sf, "labels"), "doc_id")


@query("skip_reasons", "SELECT 'deferred:' || event_type AS reason, count(*) AS n FROM events WHERE value < 50 GROUP BY 1")
def skip_reasons(spark: SparkSession, sf: str) -> DataFrame:
    skipped = read(spark, sf, "events").filter("value < 50").select(F.concat(F.lit("deferred:"), "event_type").alias("reason"))
    return records.histogram(skipped, "reason")


@query(
    "unmapped_fields",
    """SELECT 'unmapped_top_level_field:' || f AS reason, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS f FROM events) GROUP BY 1""",
)
def unmapped_fields(spark: SparkSession, sf: str) -> DataFrame:
    events = read(spark, sf, "events").select(F.json_object_keys(json_object(F.col("props"))).alias("fields"))
    return records.unhandled_fields(events, F.col("fields"), ("title", "abstract"))


@query(
    "extension_histogram",
    r"""SELECT lower(regexp_extract(url, '\.([a-z]+)(?:/|$|\?|#)', 1)) AS extension, count(*) AS n FROM pages WHERE regexp_extract(url, '\.([a-z]+)(?:/|$|\?|#)', 1) <> '' GROUP BY 1""",
)
def extension_histogram(spark: SparkSession, sf: str) -> DataFrame:
    ext = F.lower(F.regexp_extract("url", r"\.([a-z]+)(?:/|$|\?|#)", 1))
    return records.histogram(read(spark, sf, "pages").select(ext.alias("extension")).filter("extension <> ''"), "extension")


@query(
    "incremental_order",
    """SELECT row_number() OVER (ORDER BY (try_cast(id AS BIGINT) IS NULL), try_cast(id AS BIGINT), id) AS place, id FROM (SELECT CASE WHEN n_nationkey % 3 = 0 THEN n_name ELSE CAST(n_nationkey * 7 % 23 AS VARCHAR) END AS id FROM nation)""",
)
def numeric_first_order(spark: SparkSession, sf: str) -> DataFrame:
    """Ids as lists of papers are ordered: numbers by value, then the rest by text."""
    from ..sources.files import numeric_first

    ids = read(spark, sf, "nation").select(F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name")).otherwise((F.col("n_nationkey") * 7 % 23).cast("string")).alias("id"))
    return records.placed(ids, [], [numeric_first(F.col("id"))]).select("place", "id")
