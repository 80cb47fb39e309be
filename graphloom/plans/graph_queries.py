"""Catalogue: the star-schema graph, its merge and validation operators, and its metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import short_hash
from ..functions.values import canonical_json, informative_count, json_text
from ..operators import graph, metrics
from ..operators.records import first_mention_before
from . import star
from .registry import query
from .star import read

NODES_SQL = """
  SELECT 'region:' || r_regionkey AS id, 'Region' AS class, (r_name IS NOT NULL)::BIGINT AS informative FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'Nation', (n_name IS NOT NULL)::BIGINT FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'Customer', (c_name IS NOT NULL)::BIGINT + (c_mktsegment IS NOT NULL)::BIGINT + (c_acctbal IS NOT NULL)::BIGINT FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'Supplier', (s_name IS NOT NULL)::BIGINT + (s_acctbal IS NOT NULL)::BIGINT FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, 'Part', (p_name IS NOT NULL)::BIGINT + (p_brand IS NOT NULL)::BIGINT + (p_type IS NOT NULL)::BIGINT + (p_size IS NOT NULL)::BIGINT FROM part
  UNION ALL SELECT 'order:' || o_orderkey, 'Order', (o_orderstatus IS NOT NULL)::BIGINT + (o_orderpriority IS NOT NULL)::BIGINT + (o_totalprice IS NOT NULL)::BIGINT FROM orders
"""
EDGES_SQL = """
  SELECT 'partOf' AS relation, 'nation:' || n_nationkey AS source, 'region:' || n_regionkey AS target FROM nation
  UNION SELECT 'locatedIn', 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer
  UNION SELECT 'locatedIn', 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier
  UNION SELECT 'placed', 'customer:' || o_custkey, 'order:' || o_orderkey FROM orders
  UNION SELECT 'contains', 'order:' || l_orderkey, 'part:' || l_partkey FROM lineitem
  UNION SELECT 'supplies', 'supplier:' || l_suppkey, 'part:' || l_partkey FROM lineitem
"""
GRAPH_SQL = f"WITH nodes AS ({NODES_SQL}), edges AS ({EDGES_SQL})"
INCIDENCE_SQL = f"""{GRAPH_SQL},
ends AS (SELECT relation, source AS id FROM edges UNION ALL SELECT relation, target FROM edges WHERE target <> source),
per AS (SELECT id, count(*) AS incident, count(DISTINCT relation) AS kinds FROM ends GROUP BY id),
every AS (SELECT n.*, coalesce(p.incident, 0) AS incident, coalesce(p.kinds, 0) AS kinds FROM nodes n LEFT JOIN per p USING (id)),
totals AS (SELECT class, count(*) AS nodes, CAST(sum(informative) AS BIGINT) AS informative_total,
  CAST(sum(incident) AS BIGINT) AS incident_total, CAST(sum(kinds) AS BIGINT) AS relation_type_total FROM every GROUP BY class)"""


@query("graph_nodes_by_class", f"{GRAPH_SQL} SELECT class, count(*) AS nodes FROM nodes GROUP BY class")
def nodes_by_class(spark: SparkSession, sf: str) -> DataFrame:
    return star.nodes(spark, sf).groupBy("class").agg(F.count(F.lit(1)).alias("nodes"))


@query("graph_edges_by_relation", f"{GRAPH_SQL} SELECT relation, count(*) AS edges FROM edges GROUP BY relation")
def edges_by_relation(spark: SparkSession, sf: str) -> DataFrame:
    return star.edges(spark, sf).groupBy("relation").agg(F.count(F.lit(1)).alias("edges"))


@query(
    "graph_edge_ids",
    f"""{GRAPH_SQL} SELECT 'edge:' || substr(sha256('{{"inventoryId":"R-' || relation || '","relation":"' || relation || '","source":"' || source || '","target":"' || target || '"}}'), 1, 20) AS id,
    relation, source, target FROM edges""",
)
def edge_ids(spark: SparkSession, sf: str) -> DataFrame:
    return star.edges(spark, sf, with_id=True).select("id", "relation", "source", "target")


@query(
    "graph_edge_dedup",
    """SELECT 'order:' || l_orderkey AS source, 'part:' || l_partkey AS target, CAST(min(l_linenumber) AS BIGINT) AS first_line, count(*) AS mentions
    FROM lineitem GROUP BY l_orderkey, l_partkey""",
)
def edge_dedup(spark: SparkSession, sf: str) -> DataFrame:
    lines = read(spark, sf, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").cast("bigint").alias("first_line"), F.count(F.lit(1)).alias("mentions"))
    return lines.select(star.node_key("Order", F.col("l_orderkey")).alias("source"), star.node_key("Part", F.col("l_partkey")).alias("target"), "first_line", "mentions")


def _part_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Each line says of its part what it was returned as; lines of one part disagree."""
    lines = read(spark, sf, "lineitem")
    place = F.format_string("%012d:%04d", "l_orderkey", "l_linenumber")
    return lines.select(
        star.node_key("Part", F.col("l_partkey")).alias("id"),
        F.lit("Part").alias("class"),
        F.concat(F.lit("line:"), place).alias("inventory_id"),
        F.create_map(F.lit("flag"), json_text(F.col("l_returnflag")), F.lit("unit"), json_text(F.lit("piece")), F.lit("note"), F.lit('""')).alias("attributes"),
        F.lit(None).cast(graph.EVIDENCE).alias("evidence"),
        F.when(F.col("l_linestatus") == "F", graph.CURATED).otherwise(graph.REFERENCED).alias("curation_status"),
        place.alias("ord"),
    )


@query(
    "graph_node_merge",
    """WITH m AS (SELECT l_partkey, l_returnflag, l_linestatus, printf('%012d:%04d', l_orderkey, l_linenumber) AS ord FROM lineitem),
    v AS (SELECT l_partkey, count(DISTINCT l_returnflag) AS n, min(l_returnflag) AS only_one,
      '[' || string_agg(DISTINCT '"' || l_returnflag || '"', ',' ORDER BY '"' || l_returnflag || '"') || ']' AS several FROM m GROUP BY l_partkey),
    f AS (SELECT l_partkey, 'line:' || min(ord) AS inventory_id, max((l_linestatus = 'F')::INT) AS curated FROM m GROUP BY l_partkey)
    SELECT 'part:' || v.l_partkey AS id, f.inventory_id, CASE WHEN n = 1 THEN '"' || only_one || '"' ELSE several END AS flag, '"piece"' AS unit,
      2::INT AS attribute_count, CASE WHEN curated = 1 THEN 'curated' ELSE 'referenced' END AS curation_status
    FROM v JOIN f USING (l_partkey)""",
)
def node_merge(spark: SparkSession, sf: str) -> DataFrame:
    merged = graph.merge_nodes(_part_mentions(spark, sf))
    return merged.select("id", "inventory_id", F.col("attributes")["flag"].alias("flag"), F.col("attributes")["unit"].alias("unit"), F.size("attributes").alias("attribute_count"), "curation_status")


@query(
    "graph_curation_upgrade",
    """WITH stubs AS (SELECT DISTINCT 'customer:' || o_custkey AS id FROM orders),
    corpus AS (SELECT DISTINCT 'customer:' || c_custkey AS id FROM customer WHERE c_mktsegment <> 'BUILDING')
    SELECT s.id, CASE WHEN c.id IS NULL THEN 'referenced' ELSE 'curated' END AS curation_status FROM stubs s LEFT JOIN corpus c USING (id)""",
)
def curation_upgrade(spark: SparkSession, sf: str) -> DataFrame:
    stubs = read(spark, sf, "orders").select(star.node_key("Customer", F.col("o_custkey")).alias("id"))
    corpus = read(spark, sf, "customer").filter("c_mktsegment <> 'BUILDING'").select(star.node_key("Customer", F.col("c_custkey")).alias("id"))
    return graph.curation(stubs, corpus)


@query(
    "graph_validate_dangling",
    f"""{GRAPH_SQL}, kept AS (SELECT id FROM nodes WHERE id NOT IN (SELECT 'part:' || p_partkey FROM part WHERE p_size > 45)),
    ends AS (SELECT relation, source, target, 'source' AS side, source AS missing FROM edges UNION ALL SELECT relation, source, target, 'target', target FROM edges)
    SELECT relation, side, count(*) AS loose_ends, count(DISTINCT missing) AS missing_nodes FROM ends WHERE missing NOT IN (SELECT id FROM kept) GROUP BY relation, side""",
)
def validate_dangling(spark: SparkSession, sf: str) -> DataFrame:
    nodes = star.nodes(spark, sf).filter("class <> 'Part' OR CAST(attributes['size'] AS INT) <= 45")
    edges = star.edges(spark, sf).withColumn("id", F.col("relation"))  # all that is asked of an edge here
    loose = graph.dangling(nodes, edges).withColumnRenamed("edge", "relation")
    return loose.groupBy("relation", "side").agg(F.count(F.lit(1)).alias("loose_ends"), F.countDistinct("missing").alias("missing_nodes"))


@query(
    "graph_validate_duplicate_ids",
    """SELECT 'order:' || l_orderkey AS id, count(*) AS times FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1""",
)
def validate_duplicate_ids(spark: SparkSession, sf: str) -> DataFrame:
    return graph.duplicate_ids(read(spark, sf, "lineitem").select(star.node_key("Order", F.col("l_orderkey")).alias("id")))


@query(
    "graph_violations",
    f"""{GRAPH_SQL}, lost AS (SELECT 'part:' || p_partkey AS id FROM part WHERE p_size > 45 UNION ALL SELECT 'supplier:' || s_suppkey FROM supplier WHERE s_suppkey % 10 = 0),
    ends AS (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges)
    SELECT 'node without id' AS issue, count(*) AS n FROM supplier WHERE s_suppkey % 10 = 0 HAVING count(*) > 0
    UNION ALL SELECT 'repeated node id', count(*) + (SELECT (count(*) > 1)::INT FROM supplier WHERE s_suppkey % 10 = 0) FROM nation WHERE n_nationkey % 5 = 0
    UNION ALL SELECT 'node without class', count(*) FROM region
    UNION ALL SELECT 'edge without id', 2 * count(*) FROM nation WHERE n_nationkey = 3
    UNION ALL SELECT 'repeated edge id', count(*) FROM nation
    UNION ALL SELECT 'edge without relation', 2 * count(*) FROM nation WHERE n_nationkey < 3
    UNION ALL SELECT 'loose end', count(*) FROM ends WHERE id IN (SELECT id FROM lost)""",
)
def violations(spark: SparkSession, sf: str) -> DataFrame:
    """The star graph, broken in every way that a graph can be."""
    lost, part_of = F.col("id").rlike("\\Asupplier:[0-9]*0\\z"), F.col("relation") == "partOf"
    nodes = star.nodes(spark, sf).select("id", "class", "attributes").filter("class <> 'Part' OR CAST(attributes['size'] AS INT) <= 45")
    nodes = nodes.select(F.when(lost, "").otherwise(F.col("id")).alias("id"), F.when(F.col("class") == "Region", "").otherwise(F.col("class")).alias("class"))
    nodes = nodes.union(read(spark, sf, "nation").filter("n_nationkey % 5 = 0").select(star.node_key("Nation", F.col("n_nationkey")), F.lit("Nation")))
    edges = star.edges(spark, sf, with_id=True)
    few = lambda *keys: F.col("source").isin([f"nation:{k}" for k in keys])
    edges = edges.select(F.when(part_of & few(3), "").otherwise(F.col("id")).alias("id"), F.when(part_of & few(0, 1, 2), "").otherwise(F.col("relation")).alias("relation"), "source", "target")
    edges = edges.union(edges.filter(F.startswith("source", F.lit("nation:"))))
    return graph.violations(nodes, edges).groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


@query("metric_incident", f"{INCIDENCE_SQL} SELECT class, CAST(sum(incident) AS BIGINT) AS incident_total, max(incident) AS most, count(*) FILTER (WHERE incident = 0) AS isolated FROM every GROUP BY class")
def incident(spark: SparkSession, sf: str) -> DataFrame:
    rows = metrics.incidence(star.nodes(spark, sf).select("id", "class"), star.edges(spark, sf))
    return rows.groupBy("class").agg(F.sum("incident").alias("incident_total"), F.max("incident").alias("most"), F.count_if(F.col("incident") == 0).alias("isolated"))


@query("metric_relation_types", f"{INCIDENCE_SQL} SELECT class, kinds AS relation_types, count(*) AS nodes FROM every GROUP BY class, kinds")
def relation_types(spark: SparkSession, sf: str) -> DataFrame:
    rows = metrics.incidence(star.nodes(spark, sf).select("id", "class"), star.edges(spark, sf))
    return rows.groupBy("class", "relation_types").agg(F.count(F.lit(1)).alias("nodes"))


@query("metric_informative_attributes", f"{GRAPH_SQL} SELECT class, CAST(sum(informative) AS BIGINT) AS informative_total FROM nodes GROUP BY class")
def informative_attributes(spark: SparkSession, sf: str) -> DataFrame:
    return star.nodes(spark, sf).groupBy("class").agg(F.sum(informative_count(F.col("attributes"), metrics.administrative())).alias("informative_total"))


@query(
    "metric_density",
    f"""{INCIDENCE_SQL} SELECT class, nodes, informative_total, incident_total, round_even(informative_total / nodes, 6) AS attributes_per_node,
    round_even(incident_total / nodes, 6) AS incident_per_node, round_even(round_even(informative_total / nodes, 6) + round_even(incident_total / nodes, 6), 6) AS information_density FROM totals""",
)
def density(spark: SparkSession, sf: str) -> DataFrame:
    rows = metrics.structural(star.nodes(spark, sf), star.edges(spark, sf), by=["class"])
    return rows.select("class", "nodes", "informative_total", "incident_total", "attributes_per_node", "incident_per_node", "information_density")


@query("metric_density_whole", f"{INCIDENCE_SQL} SELECT CAST(sum(nodes) AS BIGINT) AS nodes, round_even(round_even(sum(informative_total) / sum(nodes), 6) + round_even(sum(incident_total) / sum(nodes), 6), 6) AS information_density FROM totals")
def density_whole(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.structural(star.nodes(spark, sf), star.edges(spark, sf)).select("nodes", "information_density")


@query("metric_richness", f"{INCIDENCE_SQL} SELECT class, relation_type_total, round_even(relation_type_total / nodes, 6) AS relational_richness FROM totals")
def richness(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.structural(star.nodes(spark, sf), star.edges(spark, sf), by=["class"]).select("class", "relation_type_total", "relational_richness")


def _counted_parts(spark: SparkSession, sf: str) -> DataFrame:
    lines = read(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    parts = read(spark, sf, "part").join(lines, F.col("p_partkey") == F.col("l_partkey"), "left")
    return parts.select(F.col("p_brand").alias("class"), F.when(F.col("n").isNull(), F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("mentionCount"), F.col("n").cast("string"))).alias("attributes"))


@query(
    "metric_consolidation",
    """WITH m AS (SELECT p_brand, coalesce(n, 1) AS n FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey) ON p_partkey = l_partkey)
    SELECT CASE WHEN grouping(p_brand) = 1 THEN NULL ELSE p_brand END AS class, grouping(p_brand)::INT AS whole, count(*) AS entities, CAST(sum(n) AS BIGINT) AS mentions,
      round_even(count(*) / sum(n), 6) AS ratio FROM m GROUP BY GROUPING SETS ((p_brand), ())""",
)
def consolidation(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.consolidation(_counted_parts(spark, sf))


@query("metric_explicit_counts", "SELECT 'counted' AS nodes, count(*) > 0 AS explicit_counts FROM part JOIN lineitem ON p_partkey = l_partkey UNION ALL SELECT 'plain', false")
def explicit_counts(spark: SparkSession, sf: str) -> DataFrame:
    counted = _counted_parts(spark, sf)
    plain = counted.withColumn("attributes", F.map_filter("attributes", lambda k, _: k != "mentionCount"))
    found = lambda name, nodes: metrics.has_mention_counts(nodes).select(F.lit(name).alias("nodes"), "explicit_counts")
    return found("counted", counted).unionByName(found("plain", plain))


@query(
    "trajectory_rows",
    """WITH s AS (SELECT o_orderpriority AS label, CASE WHEN o_orderpriority LIKE '%-%' AND substr(o_orderpriority, 1, 1) BETWEEN '1' AND '9' AND substr(o_orderpriority, 1, 1) <> '3'
        THEN CAST(substr(o_orderpriority, 1, 1) AS BIGINT) END AS given, count(*) AS nodes, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1, 2)
    SELECT row_number() OVER (ORDER BY coalesce(given, 1000000), label) AS place, label, nodes, printf('%.6f', round_even(nodes / customers, 6)) AS density,
      '| ' || replace(label, '|', '\\|') || ' | ' || nodes || ' | ' || printf('%.6f', round_even(nodes / customers, 6)) || ' |' AS line FROM s""",
)
def trajectory(spark: SparkSession, sf: str) -> DataFrame:
    """One snapshot a priority; those without an order of their own come last."""
    orders = read(spark, sf, "orders")
    digit = F.substring("o_orderpriority", 1, 1)
    given = F.when(F.contains("o_orderpriority", F.lit("-")) & digit.between("1", "9") & (digit != "3"), digit.cast("bigint"))
    rows = orders.groupBy(F.col("o_orderpriority").alias("label"), given.alias("given")).agg(F.count(F.lit(1)).alias("nodes"), F.countDistinct("o_custkey").alias("customers"))
    density = F.format_string("%.6f", metrics.average(F.col("nodes"), F.col("customers")))
    # one row a snapshot, so one task orders them
    place = F.row_number().over(Window.orderBy(F.coalesce("given", F.lit(1_000_000)), "label")).cast("bigint")
    line = F.concat(F.lit("| "), F.concat_ws(" | ", F.replace("label", F.lit("|"), F.lit("\\|")), F.col("nodes").cast("string"), density), F.lit(" |"))
    return rows.select(place.alias("place"), "label", "nodes", density.alias("density"), line.alias("line"))


@query("short_hash_docs", "SELECT doc_id, substr(sha256(coalesce(text, '')), 1, 16) AS short, substr(sha256('doc:' || doc_id), 1, 20) AS key FROM documents")
def short_hash_docs(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    return docs.select("doc_id", short_hash(F.coalesce("text", F.lit(""))).alias("short"), short_hash(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")), 20).alias("key"))


@query("canonical_json_orders", """SELECT o_orderkey, '{"key":' || o_orderkey || ',"priority":"' || o_orderpriority || '","status":"' || o_orderstatus || '","void":null}' AS json FROM orders""")
def canonical_json_orders(spark: SparkSession, sf: str) -> DataFrame:
    orders = read(spark, sf, "orders")
    return orders.select("o_orderkey", canonical_json(status=F.col("o_orderstatus"), key=F.col("o_orderkey"), priority=F.col("o_orderpriority"), void=F.lit(None).cast("string")).alias("json"))


@query(
    "pit_person_lookup",
    """WITH first AS (SELECT o_custkey % 50 AS name, min(o_orderkey) AS at FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1),
    who AS (SELECT f.name, f.at, 'person:' || o_custkey AS person FROM first f JOIN orders o ON o.o_orderkey = f.at)
    SELECT o.o_orderkey, CASE WHEN w.at <= o.o_orderkey THEN w.person END AS person FROM orders o LEFT JOIN who w ON w.name = o.o_custkey % 50""",
)
def pit_person_lookup(spark: SparkSession, sf: str) -> DataFrame:
    orders = read(spark, sf, "orders").withColumn("name", F.col("o_custkey") % 50)
    mentions = orders.filter("o_orderstatus <> 'P'").select("name", "o_orderkey", F.concat(F.lit("person:"), F.col("o_custkey").cast("string")).alias("person"))
    return first_mention_before(orders.select("name", "o_orderkey"), mentions, "name", "o_orderkey", "person").select("o_orderkey", "person")
