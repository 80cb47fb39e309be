"""Graph tables and their operators.

A mention is one statement about a node or an edge; nodes and edges are what mentions of one id add up to. Every mention carries
ord, an orderable column: "first" always means the least ord, whatever the partitioning.

nodes: id, class, inventory_id, attributes (map of JSON text), evidence, curation_status, ord
edges: id, relation, inventory_id, source, target, evidence, attributes, ord
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import short_hash
from ..functions.values import canonical_json, clean_attributes

CURATED, REFERENCED = "curated", "referenced"
EVIDENCE = "struct<evidenceText:string,sourceLocation:string,extractionMethod:string,sourceArtifact:string>"


def edge_id(source: Column, relation: Column, target: Column, inventory_id: Column) -> Column:
    """Key of a statement, the same wherever it is found."""
    whole = canonical_json(source=source, relation=relation, target=target, inventoryId=inventory_id)
    return F.concat(F.lit("edge:"), short_hash(whole, 20))


def evidence(text: Column, resource: Column, path: Column, method: str = "deterministic", artifact: str = "dataset") -> Column:
    return F.struct(
        F.coalesce(text, F.lit("")).alias("evidenceText"),
        F.concat(resource, F.lit(":"), path).alias("sourceLocation"),
        F.lit(method).alias("extractionMethod"),
        F.concat(F.lit(f"{artifact}:"), resource).alias("sourceArtifact"),
    )


def merge_values(values: Column) -> Column:
    """One value stays itself; several become a list in the order of their JSON text."""
    return F.when(F.size(values) == 1, F.element_at(values, 1)).otherwise(F.concat(F.lit("["), F.array_join(F.array_sort(values), ","), F.lit("]")))


def merge_nodes(mentions: DataFrame) -> DataFrame:
    """One row a node: first class, inventory id and evidence; attributes merged by value; curated if any mention is.

    One shuffle by id, after the distinct (name, value) pairs of each id were combined where they lie.
    """
    each = mentions.select("id", "class", "inventory_id", "evidence", "curation_status", "ord", F.explode_outer(F.map_entries(clean_attributes(F.col("attributes")))).alias("entry"))
    first = F.min_by(F.struct("class", "inventory_id", "evidence"), "ord")
    merged = each.groupBy("id").agg(first.alias("first"), F.max(F.col("curation_status") == CURATED).alias("curated"), F.collect_set("entry").alias("entries"), F.min("ord").alias("ord"))
    names = F.array_sort(F.array_distinct(F.transform("entries", lambda e: e["key"])))
    attributes = F.transform(names, lambda k: F.struct(k.alias("key"), merge_values(F.transform(F.filter("entries", lambda e: e["key"] == k), lambda e: e["value"])).alias("value")))
    return merged.select(
        "id",
        F.col("first.class").alias("class"),
        F.col("first.inventory_id").alias("inventory_id"),
        F.map_from_entries(attributes).alias("attributes"),
        F.col("first.evidence").alias("evidence"),
        F.when(F.col("curated"), CURATED).otherwise(REFERENCED).alias("curation_status"),
        "ord",
    )


def dedup_edges(mentions: DataFrame) -> DataFrame:
    """The first mention of each edge id."""
    columns = [c for c in mentions.columns if c != "id"]
    return mentions.groupBy("id").agg(F.min_by(F.struct(*columns), "ord").alias("first")).select("id", *[F.col(f"first.{c}").alias(c) for c in columns])


def merge_edges(mentions: DataFrame) -> DataFrame:
    """The first mention of each edge, with its id: compared by what the id is a hash of, so that an edge is hashed once and
    columns that nobody reads are not carried."""
    keys = ["source", "relation", "target", "inventory_id"]
    rest = [c for c in mentions.columns if c not in keys]
    merged = mentions.groupBy(*keys).agg(F.min_by(F.struct(*rest), "ord").alias("first"))
    return merged.select(edge_id(*[F.col(c) for c in keys]).alias("id"), "relation", "inventory_id", "source", "target", *[F.col(f"first.{c}").alias(c) for c in rest])


def duplicate_ids(rows: DataFrame) -> DataFrame:
    """id, times of ids that occur more than once."""
    return rows.groupBy("id").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """edge, side, missing: ends of edges that are no node."""
    ends = edges.select(F.col("id").alias("edge"), F.explode(F.array(F.struct(F.lit("source").alias("side"), F.col("source").alias("missing")), F.struct(F.lit("target").alias("side"), F.col("target").alias("missing")))).alias("e")).select("edge", "e.side", "e.missing")
    return ends.join(nodes.select(F.col("id").alias("missing")), "missing", "left_anti").select("edge", "side", "missing")


def violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """issue, id of every broken rule of a graph: missing or repeated ids, missing class or relation, loose ends."""
    empty = lambda c: F.coalesce(F.col(c) == "", F.lit(True))
    said = lambda df, issue, c="id": df.select(F.lit(issue).alias("issue"), F.col(c).alias("id"))
    return (
        said(nodes.filter(empty("id")), "node without id")
        .union(said(edges.filter(empty("id")), "edge without id"))
        .union(said(duplicate_ids(nodes), "repeated node id"))
        .union(said(duplicate_ids(edges), "repeated edge id"))
        .union(said(nodes.filter(empty("class")), "node without class"))
        .union(said(edges.filter(empty("relation")), "edge without relation"))
        .union(said(dangling(nodes, edges), "loose end", "edge"))
    )


def check(nodes: DataFrame, edges: DataFrame) -> None:
    """Raises on the first violation."""
    found = violations(nodes, edges).orderBy("issue", "id").first()
    if found:
        raise ValueError(f"{found['issue']}: {found['id']}")


def curation(targets: DataFrame, corpus: DataFrame) -> DataFrame:
    """id, curation_status: curated if the corpus holds the id, else referenced. Both sides are reduced to ids first."""
    known = corpus.select(F.col("id").alias("known")).distinct()
    return targets.select("id").distinct().join(known, F.col("id") == F.col("known"), "left").select("id", F.when(F.col("known").isNotNull(), CURATED).otherwise(REFERENCED).alias("curation_status"))
