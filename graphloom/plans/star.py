"""A property graph from the driver's star schema: one node a row of a dimension, edges along keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import json_text
from ..operators.graph import CURATED, EVIDENCE, dedup_edges, edge_id

#: class, table, key, name column, further attributes
CLASSES = (
    ("Region", "region", "r_regionkey", "r_name", ()),
    ("Nation", "nation", "n_nationkey", "n_name", ()),
    ("Customer", "customer", "c_custkey", "c_name", ("c_mktsegment", "c_acctbal")),
    ("Supplier", "supplier", "s_suppkey", "s_name", ("s_acctbal",)),
    ("Part", "part", "p_partkey", "p_name", ("p_brand", "p_type", "p_size")),
    ("Order", "orders", "o_orderkey", None, ("o_orderstatus", "o_orderpriority", "o_totalprice")),
)
#: relation, table, source class, source key, target class, target key
RELATIONS = (
    ("partOf", "nation", "Nation", "n_nationkey", "Region", "n_regionkey"),
    ("locatedIn", "customer", "Customer", "c_custkey", "Nation", "c_nationkey"),
    ("locatedIn", "supplier", "Supplier", "s_suppkey", "Nation", "s_nationkey"),
    ("placed", "orders", "Customer", "o_custkey", "Order", "o_orderkey"),
    ("contains", "lineitem", "Order", "l_orderkey", "Part", "l_partkey"),
    ("supplies", "lineitem", "Supplier", "l_suppkey", "Part", "l_partkey"),
)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def node_key(kind: str, key: Column) -> Column:
    return F.concat(F.lit(kind.lower() + ":"), key.cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, class, inventory_id, attributes, evidence, curation_status, ord."""
    out = None
    for kind, table, key, name, further in CLASSES:
        df = read(spark, sf_dir, table)
        pairs = [F.lit("identifier"), F.col(key).cast("string")]
        if name:
            pairs += [F.lit("name"), json_text(F.col(name))]
        for c in further:
            value = F.col(c).cast("string") if dict(df.dtypes)[c] != "string" else json_text(F.col(c))
            pairs += [F.lit(c.partition("_")[2]), value]
        part = df.select(
            node_key(kind, F.col(key)).alias("id"),
            F.lit(kind).alias("class"),
            F.lit(f"S-{kind}").alias("inventory_id"),
            F.create_map(*pairs).alias("attributes"),
            F.lit(None).cast(EVIDENCE).alias("evidence"),
            F.lit(CURATED).alias("curation_status"),
            F.col(key).cast("bigint").alias("ord"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def edge_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """relation, inventory_id, source, target, ord; lines that state the same edge again are mentions of it."""
    out = None
    for relation, table, source, source_key, target, target_key in RELATIONS:
        df = read(spark, sf_dir, table)
        part = df.select(
            F.lit(relation).alias("relation"),
            F.lit(f"R-{relation}").alias("inventory_id"),
            node_key(source, F.col(source_key)).alias("source"),
            node_key(target, F.col(target_key)).alias("target"),
            (F.col("l_linenumber") if table == "lineitem" else F.lit(0)).cast("bigint").alias("ord"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def edges(spark: SparkSession, sf_dir: str, with_id: bool = False) -> DataFrame:
    """Distinct edges. The id is a hash of the other columns; without it they are compared themselves."""
    mentions = edge_mentions(spark, sf_dir)
    if not with_id:
        return mentions.select("relation", "source", "target").distinct()
    # the natural key first, so that an edge is hashed once
    first = mentions.groupBy("relation", "inventory_id", "source", "target").agg(F.min("ord").alias("ord"))
    return first.select(edge_id(F.col("source"), F.col("relation"), F.col("target"), F.col("inventory_id")).alias("id"), "*")
