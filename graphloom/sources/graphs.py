"""Graph documents {nodes: [...], edges: [...]} as tables, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import EVIDENCE

_NODES = f"array<struct<id:string,class:string,inventoryId:string,attributes:map<string,variant>,evidence:{EVIDENCE},curationStatus:string>>"
_EDGES = f"array<struct<id:string,relation:string,inventoryId:string,source:string,target:string,evidence:{EVIDENCE},attributes:map<string,variant>>>"


def _texts(attributes: Column) -> Column:
    return F.transform_values(F.coalesce(attributes, F.create_map().cast("map<string,variant>")), lambda _, v: F.to_json(v))


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes, edges of a graph document; attribute values as canonical JSON text. Raises if it is no such document."""
    text = spark.read.text(path, wholetext=True)
    shape = text.select(F.schema_of_variant(F.try_variant_get(F.try_parse_json("value"), "$.nodes", "variant")).alias("n"), F.schema_of_variant(F.try_variant_get(F.try_parse_json("value"), "$.edges", "variant")).alias("e")).first()
    for name, kind in (("nodes", shape["n"]), ("edges", shape["e"])):
        if not (kind or "").startswith("ARRAY"):
            raise ValueError(f"{path}: {name} must be a list")
    parsed = text.select(F.from_json("value", f"struct<nodes:{_NODES},edges:{_EDGES}>").alias("g"))
    nodes = parsed.select(F.posexplode("g.nodes").alias("ord", "n"))
    edges = parsed.select(F.posexplode("g.edges").alias("ord", "e"))
    return (
        nodes.select("n.id", "n.class", F.col("n.inventoryId").alias("inventory_id"), _texts(F.col("n.attributes")).alias("attributes"), "n.evidence", F.col("n.curationStatus").alias("curation_status"), "ord"),
        edges.select("e.id", "e.relation", F.col("e.inventoryId").alias("inventory_id"), "e.source", "e.target", "e.evidence", _texts(F.col("e.attributes")).alias("attributes"), "ord"),
    )


def document(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables with the document's names, and attributes as values again; empty attributes of edges are left out by the writer."""
    values = lambda c: F.transform_values(c, lambda _, v: F.parse_json(v))
    return (
        nodes.select("id", "class", F.col("inventory_id").alias("inventoryId"), values("attributes").alias("attributes"), "evidence", F.col("curation_status").alias("curationStatus")),
        edges.select("id", "relation", F.col("inventory_id").alias("inventoryId"), "source", "target", "evidence", F.when(F.size("attributes") > 0, values("attributes")).alias("attributes")),
    )
