"""Shared helpers: input columns, lineage cuts, shared folders."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, cut, map_arrow, ship, small_batches, stored

__all__ = ["SPACE", "WORD", "checkpoint_dir", "cut", "map_arrow", "meet", "remove_folder", "shared_folder", "ship", "slices", "small_batches", "stored", "table", "text_of"]

#: ASCII white space that separates words, as a character class body.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder name (not yet created) below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/graphloom-{label}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def text_of(docs: DataFrame, column: str = "text"):
    """The text column; null counts as empty."""
    return F.coalesce(docs[column].cast("string"), F.lit(""))


def meet(table: DataFrame, side: DataFrame, same: Column, rows: str, most: int) -> DataFrame:
    """table beside its row of side, which holds every key of table once and, in column rows, how many rows of table have it.

    A side of up to most rows is broadcast. Of a larger one only the keys with the most rows are, fewer than most by
    counting, and the others meet in a shuffle in which no key is hot. side should be materialised."""
    if side.count() <= most:
        return table.join(F.broadcast(side), same)
    bound = max(side.agg(F.sum(rows)).first()[0] // max(most, 1), 1)
    marked = table.join(F.broadcast(side.filter(F.col(rows) > bound).withColumn("_met", F.lit(True))), same, "left")
    rest = marked.filter("_met is null").drop("_met", *side.columns)
    return marked.filter("_met").drop("_met").unionByName(rest.join(side, same))


def slices(lengths, limit: int):
    """(start, stop) runs of rows whose lengths add up to about limit; a longer row stands alone."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)
