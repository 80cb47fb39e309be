"""Mixing of sources to target weights by capped water-filling, in DataFrame operations only.

A source's target is its share, by weight, of a total; no target may exceed a number of epochs over its source.
What a capped source cannot take goes to the others in proportion to their weights, until none is above its cap: the level,
words for each unit of weight, is raised from sums over all sources until the set of capped ones stays as it is.
Documents then repeat: each one whole floor(target / size of source) times, and in a seeded order again until the rest of the
target is used up; the document at the border is taken in part.

The seeded order of a source is cut into buckets by the leading bits of a hash. Sums of buckets tell which bucket holds the
border: documents before it are taken, those after it are not, and only the rows of the border's bucket are put in order. So
neither a hot source nor its texts are shuffled.

Defined results: null text has size 0 and is never taken in part; very long texts are counted whole; a null source is a source
(last in order); repeated rows are rows of their own; other columns, whatever their names, pass through mixed_documents() and
are not read by takes(); an empty table gives an empty result. A source without words gets target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, WORD, cut, meet, text_of

#: Rows of a source that share one bucket of the seeded order, about; buckets that are summed together to find the border.
BUCKET_ROWS, BUCKETS = 2048, 4096
WEIGHTS = (3.0, 1.0, 2.0)
#: Sources that are broadcast at most; beyond, only those with the most rows.
MOST_BROADCAST = 200_000
_OWN = "source <=> plan_source"


def _draw(seed: int, key: Column, text: Column) -> Column:
    """60 bits from the seed, the id and the text."""
    mixed = F.md5(F.concat(F.lit(f"{seed}:"), key, F.lit(":"), F.md5(text)))
    return F.conv(F.substring(mixed, 1, 15), 16, 10).cast("bigint")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def _ranked(sizes: DataFrame) -> DataFrame:
    """sizes with rank: the place of each source by code point, null last. Counted by ranges, so that no task sees all."""
    order = F.col("source").asc_nulls_last()
    dealt = cut(sizes.repartitionByRange(order).withColumn("part", F.spark_partition_id()))
    # one row a range: as many as there are partitions
    ahead = F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("rows")).select("part", ahead.alias("ahead"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(order))
    return dealt.withColumn("inside", inside).join(F.broadcast(starts), "part").withColumn("rank", F.col("ahead") + F.col("inside") - 1).drop("part", "ahead", "inside")


def targets(sizes: DataFrame, share: float = 1.5, epochs: float = 2.0, weights: tuple = WEIGHTS) -> DataFrame:
    """Targets of sources: the columns of sizes, and target. sizes: source, source_size, one row a source (null allowed)."""
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    weighed = cut(_ranked(sizes).withColumn("weight", cycle).withColumn("cap", F.col("source_size") * F.lit(float(epochs))).drop("rank"))
    rate = F.col("cap") / F.col("weight")
    total = weighed.agg(F.sum("source_size")).first()[0]
    level, before = None, -1.0
    while total is not None and level != before:  # each round caps one more source at least
        before = level
        capped = F.lit(False) if level is None else rate < F.lit(level)
        got = weighed.agg(F.sum(F.when(capped, F.col("cap")).otherwise(0.0)).alias("caps"), F.sum(F.when(~capped, F.col("weight"))).alias("weights")).first()
        if got["weights"] is None:  # all are capped
            level = None
            break
        level = (float(total) * share - got["caps"]) / got["weights"]
    goal = F.col("cap") if level is None else F.least("cap", F.lit(level) * F.col("weight"))
    return weighed.withColumn("target", goal).drop("weight", "cap")


def _sized(docs: DataFrame, seed: int, id_column: str, source_column: str) -> DataFrame:
    """doc_id, source, size, draw."""
    text = text_of(docs)
    return docs.select(docs[id_column].alias("doc_id"), docs[source_column].cast("string").alias("source"), word_count(text).alias("size"), _draw(seed, F.coalesce(docs[id_column].cast("string"), F.lit("")), text).alias("draw"))


def _bucket(rows: int) -> Column:
    """Of a draw: as many buckets as rows / BUCKET_ROWS, rounded up to a power of two."""
    bits = max(0, (max(rows, 1) // BUCKET_ROWS).bit_length())
    return F.shiftrightunsigned("draw", 60 - bits) if bits else F.lit(0).cast("bigint")


def _at_border(sums: DataFrame, column: str) -> DataFrame:
    """Of sums (source, column, sum, left): the first row of each source, by column, whose sum passes what is left; left less
    what lies before it."""
    before = F.coalesce(F.sum("sum").over(Window.partitionBy("source").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    passed = sums.withColumn("left", F.col("left") - before).filter((F.col("left") >= 0) & (F.col("sum") > F.col("left")))
    return passed.select("source", column, "left")


def _plan(sized: DataFrame, rows: int, share: float, epochs: float, weights: tuple) -> DataFrame:
    """One row a source: plan_source, source_size, target, rows, whole (repetitions), border (its bucket; null: none), left
    (words of the last repetition that fall into that bucket). Materialised."""
    sums = cut(sized.withColumn("bucket", _bucket(rows)).groupBy("source", "bucket").agg(F.sum("size").alias("sum"), F.count(F.lit(1)).alias("rows")))
    sizes = sums.groupBy("source").agg(F.sum("sum").alias("source_size"), F.sum("rows").alias("rows"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    goals = cut(targets(sizes, share, epochs, weights).withColumn("whole", whole).withColumn("left", F.round("target").cast("bigint") - F.col("whole") * F.col("source_size")))
    same = lambda a, b: a.eqNullSafe(b)
    wide = F.floor(F.col("bucket") / BUCKETS)
    coarse = sums.withColumn("wide", wide).groupBy("source", "wide").agg(F.sum("sum").alias("sum"))
    left = goals.select(F.col("source").alias("_source"), "left")
    found = _at_border(coarse.join(left, same(F.col("source"), F.col("_source"))).drop("_source"), "wide").select(F.col("source").alias("_source"), F.col("wide").alias("_wide"), "left")
    inner = sums.withColumn("wide", wide).join(found, same(F.col("source"), F.col("_source")) & (F.col("wide") == F.col("_wide"))).select("source", "bucket", "sum", "left")
    border = _at_border(inner, "bucket").select(F.col("source").alias("_source"), F.col("bucket").alias("border"), F.col("left").alias("_left"))
    plan = goals.join(border, same(F.col("source"), F.col("_source")), "left")
    return cut(plan.select(F.col("source").alias("plan_source"), "source_size", "target", "rows", "whole", "border", F.col("_left").alias("left")))


def _border_parts(table: DataFrame) -> DataFrame:
    """Rows of the borders' buckets (source, draw, doc_id, size, left) with part: words of the last repetition."""
    inside = Window.partitionBy("source").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum("size").over(inside), F.lit(0))
    return table.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - ahead)))


def takes(docs: DataFrame, share: float = 1.5, epochs: float = 2.0, weights: tuple = WEIGHTS, seed: int = 7, id_column: str = "doc_id", source_column: str = "source") -> DataFrame:
    """Rows of doc_id, size, source_size, target, taken. taken = size * whole repetitions + words of the last, partial
    repetition; it adds up to the rounded target for each source."""
    sized = cut(_sized(docs, seed, id_column, source_column))
    rows = sized.count()
    planned = meet(sized.withColumn("bucket", _bucket(rows)), _plan(sized, rows, share, epochs, weights), F.expr(_OWN), "rows", MOST_BROADCAST)
    at_border = F.coalesce(F.col("bucket") == F.col("border"), F.lit(False))
    others = planned.filter(~at_border).withColumn("part", F.when(F.coalesce(F.col("bucket") < F.col("border"), F.lit(True)), F.col("size")).otherwise(F.lit(0).cast("bigint")))
    every = others.unionByName(_border_parts(planned.filter(at_border)))
    return every.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("whole") + F.col("part")).alias("taken"))


def mixed_documents(docs: DataFrame, share: float = 1.5, epochs: float = 2.0, weights: tuple = WEIGHTS, seed: int = 7, id_column: str = "doc_id", source_column: str = "source") -> DataFrame:
    """The mix itself, with the columns of docs: each document as often as taken says; the last, partial repetition
    of the document at a source's border holds its first words, up to the end of the last word taken. Documents
    without words take no words and leave the mix.
    """
    n = docs.select(F.lit(1)).count()
    plan = _plan(_sized(docs, seed, id_column, source_column), n, share, epochs, weights)
    text = text_of(docs)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_column].alias("doc_id"), docs[source_column].cast("string").alias("source"), text.alias("text"), _draw(seed, F.coalesce(docs[id_column].cast("string"), F.lit("")), text).alias("draw"))
    planned = meet(rows.withColumn("bucket", _bucket(n)), plan, F.expr(_OWN), "rows", MOST_BROADCAST)
    at_border = F.coalesce(F.col("bucket") == F.col("border"), F.lit(False))
    again = F.col("whole") + F.coalesce(F.col("bucket") < F.col("border"), F.lit(True)).cast("bigint")
    whole = planned.filter(~at_border & (again > 0) & F.col("text").rlike(WORD)).select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), again))).select("row.*")
    parts = _border_parts(planned.filter(at_border).withColumn("size", word_count(F.col("text")))).filter("size > 0")
    parts = parts.withColumn("words", F.concat(F.array_repeat("size", F.col("whole").cast("int")), F.when(F.col("part") > 0, F.array("part")).otherwise(F.array().cast("array<bigint>"))))
    parts = parts.select("row", "text", "size", F.explode("words").alias("words"))
    leading = F.concat(F.lit(rf"\A(?:[{SPACE}]*+{WORD}+){{"), F.col("words").cast("string"), F.lit("}+"))
    cut_off = F.col("words") < F.col("size")
    first = F.call_function("regexp_extract", F.col("text"), leading, F.lit(0))
    columns = {c: F.col("row")[c] for c in docs.columns} | {"text": F.when(cut_off, first).otherwise(F.col("row")["text"])}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(cut_off, F.length(first)).otherwise(F.col("row")["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return whole.unionByName(parts.select(*[x.alias(c) for c, x in columns.items()]))
