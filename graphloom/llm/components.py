"""Connected components. Up to MOST_LOCAL links are joined in one executor task; more by alternating large-star and small-star
rounds, of which nothing is collected but whether one is the last. Both give the same roots."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow

#: Links (16 bytes each) that one task joins at most.
MOST_LOCAL = 200_000


def _large_star(edges: DataFrame) -> DataFrame:
    """Joins every larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Joins a node and its smaller neighbours to the least of these."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    others = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.union(least.select("u", F.col("m").alias("v"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one root at most, and no root has one itself: then no round would change a thing."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("led")).union(edges.select(F.col("v").alias("n"), F.lit(0).alias("led")))
    at = ends.groupBy("n").agg(F.sum("led").alias("led"), F.count(F.lit(1)).alias("all"))
    return at.filter((F.col("led") > 1) | ((F.col("led") == 1) & (F.col("all") > 1))).isEmpty()


def _joined(batches):
    """u, v: every node but the roots, and its root; of all links that reach this task."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := above.get(top, top)) != top:
            top = up
        while x != top:
            above[x], x = top, above[x]
        return top

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = sorted((root(u), root(v)))
            above[b] = a
            above.setdefault(a, a)
    ends = [(x, top) for x in above if (top := root(x)) != x]
    yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in ends], pa.int64()) for k in (0, 1)], names=["u", "v"])


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """node, root: for every linked node but the roots themselves, the least node reachable. Nodes are bigint."""
    edges = cut(links.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).filter("u <> v").distinct())
    if edges.limit(MOST_LOCAL + 1).count() <= MOST_LOCAL:
        edges = cut(map_arrow(edges.coalesce(1), _joined, "u bigint, v bigint"))
    else:
        while not _settled(edges):
            edges = cut(_small_star(_large_star(edges)))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
