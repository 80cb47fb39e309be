"""Operators on records of a corpus: ordered first-wins joins and deduplication, dependencies, histograms, set differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..session import cut


def first_rows(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key by order, all columns kept. One combine-able aggregate, no sort of a key's rows."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_first"))
    return picked.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest]).select(*df.columns)


def relation_entries(fields: list[tuple[str, DataFrame]], keys: list[str]) -> DataFrame:
    """Entries of several relation fields, each key once: the first by field order, then by place (column index)."""
    out = None
    for rank, (name, df) in enumerate(fields):
        part = df.withColumn("field", F.lit(name)).withColumn("field_rank", F.lit(rank))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return first_rows(out, keys, ["field_rank", "index"])


def relation_predicate(predicate: Column, label: Column) -> Column:
    """The predicate, or the one that a label stands for."""
    label = F.lower(strip(label))
    return F.coalesce(F.nullif(predicate, F.lit("")), F.when(label == "the content of this resource can be executed by", F.lit("hsterms:isExecutedBy")))


def merge_relations(typed: DataFrame, stated: DataFrame, keys: list[str]) -> DataFrame:
    """Typed relations with the labels stated for the same target, and stated ones whose target has no typed relation.

    typed: keys, target, predicate, ord; stated: keys, target, label, ord. labels are distinct, in order."""
    on = [*keys, "target"]
    typed = first_rows(typed, [*on, "predicate"], ["ord"])
    labelled = stated.groupBy(*on).agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ord", "label"))), lambda s: s["label"])).alias("labels"))
    xml = typed.join(labelled, on, "left").select(*on, "predicate", F.coalesce("labels", F.array().cast("array<string>")).alias("labels"), F.lit("typed").alias("origin"))
    alone = first_rows(stated, [*on, "label"], ["ord"]).join(typed.select(*on).distinct(), on, "left_anti")
    return xml.unionByName(alone.select(*on, F.lit(None).cast("string").alias("predicate"), F.array("label").alias("labels"), F.lit("stated").alias("origin")))


def first_mention_before(rows: DataFrame, mentions: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """rows with the value of the first mention of their key, if it comes no later than the row.

    Mentions are reduced to the first of each key before the join; it is the earliest, so it decides for every row."""
    first = mentions.groupBy(F.col(key).alias("_key")).agg(F.min(F.struct(F.col(order).alias("at"), F.col(value).alias("value"))).alias("_m"))
    joined = rows.join(first, F.col(key) == F.col("_key"), "left")
    return joined.withColumn(value, F.when(F.col("_m.at") <= F.col(order), F.col("_m.value"))).drop("_key", "_m")


GROUP_RANK = {"runtime": 4, "optional": 3, "dev": 2, "build": 1}


def group_rank(group: Column, ranks: dict[str, int] | None = None) -> Column:
    out = F.lit(0)
    for name, rank in (ranks or GROUP_RANK).items():
        out = F.when(group == name, rank).otherwise(out)
    return out


def merge_dependencies(declared: DataFrame, keys: list[str], ranks: dict[str, int] | None = None) -> DataFrame:
    """One row a dependency: the first declaration's fields, the highest-ranked group, all sources sorted.

    declared: keys, dep_group, ord, manifest_path, raw_line, and any other fields."""
    rest = [c for c in declared.columns if c not in (*keys, "dep_group", "ord", "manifest_path", "raw_line")]
    first = F.min_by(F.struct(F.lit(0).alias("_"), *rest), "ord")
    out = declared.groupBy(*keys).agg(
        first.alias("_first"),
        F.min_by("dep_group", F.struct(-group_rank(F.col("dep_group"), ranks), F.col("ord"))).alias("dep_group"),
        F.array_sort(F.collect_list(F.struct("manifest_path", "raw_line"))).alias("sources"),
    )
    return out.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest], "dep_group", "sources")


def lock_class(lines: DataFrame, manifest: list[str], marked: Column, pinned: Column, transitive: Column) -> DataFrame:
    """direct or lock for each requirements manifest: marked lines are most of them, or there are many pins of which
    some are known as indirect."""
    sums = lines.groupBy(*manifest).agg(F.count(F.lit(1)).alias("n"), F.count_if(marked).alias("marked"), F.count_if(pinned).alias("pinned"), F.count_if(transitive).alias("transitive"))
    by_marks = F.col("marked") >= F.greatest(F.lit(1), F.floor(F.col("n") * 0.8))
    by_pins = (F.col("n") >= 60) & (F.col("pinned") >= 60) & (F.col("transitive") >= 2)
    return sums.withColumn("classification", F.when((F.col("n") > 0) & (by_marks | by_pins), "lock").otherwise("direct"))


def histogram(df: DataFrame, column: str, null_name: str = "None") -> DataFrame:
    return df.groupBy(F.coalesce(F.col(column), F.lit(null_name)).alias(column)).agg(F.count(F.lit(1)).alias("n"))


def difference(old: DataFrame, new: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """by, removed, added, kept: how many distinct keys only the old, only the new, or both hold. One shuffle by key."""
    both = old.select(*keys).withColumn("_o", F.lit(1)).withColumn("_n", F.lit(0)).unionByName(new.select(*keys).withColumn("_o", F.lit(0)).withColumn("_n", F.lit(1)))
    flags = both.groupBy(*keys).agg(F.max("_o").alias("o"), F.max("_n").alias("n"))
    return flags.groupBy(*by).agg(F.count_if((F.col("o") == 1) & (F.col("n") == 0)).alias("removed"), F.count_if((F.col("o") == 0) & (F.col("n") == 1)).alias("added"), F.count_if((F.col("o") == 1) & (F.col("n") == 1)).alias("kept"))


def differing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """keys, change: the distinct keys that only the old (removed) or only the new (added) holds, by name. One shuffle."""
    both = old.select(*keys, F.lit(1).alias("_o"), F.lit(0).alias("_n")).unionByName(new.select(*keys, F.lit(0).alias("_o"), F.lit(1).alias("_n")))
    flags = both.groupBy(*keys).agg(F.max("_o").alias("_o"), F.max("_n").alias("_n"))
    return flags.filter("_o <> _n").select(*keys, F.when(F.col("_o") == 1, "removed").otherwise("added").alias("change"))


def missing_keys(present: Column, required: tuple[str, ...]) -> Column:
    """Required names that are not among present ones, sorted; null if none is missing."""
    missing = F.array_sort(F.array_except(F.array(*[F.lit(k) for k in required]), F.coalesce(present, F.array().cast("array<string>"))))
    return F.when(F.size(missing) > 0, missing)


def placed(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """df with place: the number of each row within its group (all rows without by), in order.

    Rows are dealt to ranges of group and order; those of a range are numbered where they lie, after the rows that the
    ranges before it have of the group. So no task sees a whole group, however large."""
    names = [f"_order{k}" for k in range(len(order))]
    keyed = df.select("*", *[c.alias(n) for c, n in zip(order, names, strict=True)])
    dealt = cut(keyed.repartitionByRange(*by, *names).withColumn("_range", F.spark_partition_id()))
    ahead = F.coalesce(F.sum("_rows").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = dealt.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_rows")).select(F.struct(*by, "_range").alias("_own"), ahead.alias("_ahead"))
    inside = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*names))
    numbered = dealt.withColumn("_inside", inside).join(starts, F.struct(*by, "_range").eqNullSafe(F.col("_own")))
    return numbered.select(*df.columns, (F.col("_ahead") + F.col("_inside")).alias("place"))


def top_in_order(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group by order, with their place."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("place", place).filter(F.col("place") <= k)


def unhandled_fields(records: DataFrame, fields: Column, handled: tuple[str, ...], kept: tuple[str, ...] = ()) -> DataFrame:
    """reason, n: top-level fields that no rule reads."""
    names = records.select(F.explode(F.array_except(fields, F.array(*[F.lit(h) for h in (*handled, *kept)]))).alias("field"))
    return names.groupBy(F.concat(F.lit("unmapped_top_level_field:"), "field").alias("reason")).agg(F.count(F.lit(1)).alias("n"))
