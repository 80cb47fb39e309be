"""Operators on documents: heading trees, duplicate texts, chunk normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import limit_words, readme_key, section_body, strip, strip_end, supporting_quotes, unix_lines

# Chunk types in order, most items of each, and limits.
CHUNK_CAPS = {"Background": 3, "Research Goal": 5, "Problem": 5, "Method": 8, "Data": 6, "Result": 10, "Discussion-Limitation": 6, "Conclusion": 3}
MOST_CHARS, LEAST_CHARS, MOST_QUOTE_WORDS = 1500, 120, 50

HEADING = r"\A(#{1,6})\s+(.*\S)\s*\z"
INTRODUCTION = "README Introduction"


def sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, section_id, parent_section_id, heading, heading_level, heading_marker, section_text, has_children.

    A heading's parent is the nearest heading before it of a lower level; text before the first heading is an introduction of
    level 0. Sections without text and children are dropped, but keep their number; those with children only show their
    heading as text. Documents are windows of their own lines."""
    lines = docs.select(F.col(key).alias("key"), F.posexplode(F.split(unix_lines(F.col(text)), "\n", -1)).alias("line_no", "line"))
    level = F.length(F.regexp_extract("line", HEADING, 1))
    lines = lines.withColumn("level", level)
    by_line = Window.partitionBy("key").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    numbered = lines.withColumn("number", F.sum((F.col("level") > 0).cast("int")).over(by_line))
    body = F.filter(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "level", "line"))), lambda s: F.when(s["level"] == 0, s["line"])), lambda x: x.isNotNull())
    grouped = numbered.groupBy("key", "number").agg(
        F.max("level").alias("heading_level"),
        F.max(F.when(F.col("level") > 0, F.regexp_extract("line", HEADING, 2))).alias("heading"),
        body.alias("lines"),
    )
    grouped = grouped.withColumn("section_text", section_body(F.col("lines"))).drop("lines")
    # an empty preamble is no section
    grouped = grouped.filter((F.col("number") > 0) | (F.col("section_text") != ""))
    order = Window.partitionBy("key").orderBy("number")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ids = F.row_number().over(order)
    grouped = grouped.withColumn("section_id", ids).withColumn("following", F.lead("heading_level").over(order))
    at = [F.last(F.when(F.col("heading_level") == k, F.col("section_id")), ignorenulls=True).over(before) for k in range(1, 7)]
    for k, a in enumerate(at, 1):
        grouped = grouped.withColumn(f"at{k}", a)
    # the nearest heading of a lower level that no heading of a still lower level has closed is the latest of them
    parent = F.lit(None).cast("int")
    for k in range(2, 7):
        lower = [F.coalesce(F.col(f"at{j}"), F.lit(0)) for j in range(1, k)]
        best = F.greatest(*lower) if len(lower) > 1 else lower[0]
        parent = F.when(F.col("heading_level") == k, F.nullif(best, F.lit(0))).otherwise(parent)
    grouped = grouped.withColumn("parent_section_id", parent).withColumn("has_children", F.coalesce((F.col("heading_level") > 0) & (F.col("following") > F.col("heading_level")), F.lit(False)))
    kept = grouped.filter((F.col("section_text") != "") | F.col("has_children"))
    top = F.col("heading_level") == 0
    return kept.select(
        F.col("key").alias(key),
        "section_id",
        "parent_section_id",
        F.when(top, INTRODUCTION).otherwise(F.col("heading")).alias("heading"),
        "heading_level",
        F.when(~top, F.repeat(F.lit("#"), F.col("heading_level"))).alias("heading_marker"),
        F.when(F.col("section_text") == "", F.col("heading")).otherwise(F.col("section_text")).alias("section_text"),
        "has_children",
    )


def distinct_texts(docs: DataFrame, key: list[str], text: str, name: str, copies: str | None = None) -> DataFrame:
    """One row a different text of each key (line ends and outer blanks aside): the first by lower-case name. copies: name of
    a column that tells how many rows have the text."""
    marked = docs.withColumn("_same", F.sha2(readme_key(F.col(text)), 256))
    rest = [c for c in docs.columns if c not in key]
    picked = marked.groupBy(*key, "_same").agg(F.min_by(F.struct(*rest), F.struct(F.lower(name), F.col(name))).alias("_first"), F.count(F.lit(1)).alias("_copies"))
    more = [F.col("_copies").alias(copies)] if copies else []
    return picked.select(*key, *[F.col(f"_first.{c}").alias(c) for c in rest], *more).select(*docs.columns, *([copies] if copies else []))


def primary_text(docs: DataFrame, key: list[str], name: str) -> DataFrame:
    """key, name: the first Markdown file of each key, else the first file."""
    rank = F.struct(~F.endswith(F.lower(name), F.lit(".md")), F.lower(name), F.col(name))
    return docs.groupBy(*key).agg(F.min_by(name, rank).alias(name))


def normalise_chunks(chunks: DataFrame, caps: dict[str, int] | None = None, key: str = "paper_id") -> DataFrame:
    """key, chunk_type, text, supporting_quote, section_hint, chunk_id.

    chunks: key, ord, chunk_type, text, supporting_quote (JSON text), section_hint. Types outside caps, chunks without quotes
    and short texts go; long texts are cut first, and the first of each type stay."""
    caps = caps or CHUNK_CAPS
    cut = F.when(F.length(strip(F.col("text"))) > MOST_CHARS, strip_end(F.left(strip(F.col("text")), F.lit(MOST_CHARS)))).otherwise(strip(F.col("text")))
    quotes = F.filter(F.transform(supporting_quotes(F.col("supporting_quote")), lambda q: limit_words(q, MOST_QUOTE_WORDS)), lambda q: q != "")
    rows = chunks.select(F.col(key), "ord", strip(F.col("chunk_type")).alias("chunk_type"), F.coalesce(cut, F.lit("")).alias("text"), quotes.alias("supporting_quote"), F.coalesce(strip(F.col("section_hint")), F.lit("")).alias("section_hint"))
    rows = rows.filter(F.col("chunk_type").isin(*caps) & (F.size("supporting_quote") > 0) & (F.length("text") >= LEAST_CHARS))
    most = F.lit(0)
    for kind, n in caps.items():
        most = F.when(F.col("chunk_type") == kind, n).otherwise(most)
    place = F.row_number().over(Window.partitionBy(key, "chunk_type").orderBy("ord"))
    # a number first, so that no task ranks more of a group than that
    rows = rows.withColumn("place", place).filter(F.col("place") <= max(caps.values(), default=0)).filter(F.col("place") <= most)
    name = F.concat_ws("__", F.col(key).cast("string"), F.translate("chunk_type", " -", "__"), F.col("place").cast("string"))
    return rows.select(key, "chunk_type", "text", "supporting_quote", "section_hint", name.alias("chunk_id"))
