"""Papers: prompts, model calls and their answers as tables. The model is any function from prompt to text; by default
recorded answers are replayed."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import compress_text, json_object, strip
from ..functions.values import json_text
from ..operators.documents import normalise_chunks
from ..session import map_arrow
from ..sources.files import numeric_first
from ..sources.service import paced

#: Which parameters a call sends, tried in turn: models may reject some.
CALLS = ({"effort": True, "temperature": True}, {"effort": True, "temperature": False}, {"effort": False, "temperature": False})
METADATA = "title string, abstract string, keywords array<string>, authors array<struct<author:string,affiliation:string,email:string,orcid:string,is_corresponding:boolean>>"


def prompts(papers: DataFrame, instruction: str, head: int = 80_000, tail: int = 60_000) -> DataFrame:
    """paper_id, prompt: the instruction, the id and the (shortened) text of each paper."""
    text = F.concat(F.lit(instruction + "\n\npaper_id: "), F.col("paper_id").cast("string"), F.lit("\n\n"), compress_text(F.col("text"), head, tail))
    return papers.select("paper_id", text.alias("prompt"))


def called(model: Callable[..., str], prompt: str) -> tuple[str | None, str | None]:
    """The answer of the first call that the model accepts, else the errors of all."""
    failed = []
    for k, options in enumerate(CALLS, 1):
        try:
            return model(prompt, **options), None
        except Exception as e:
            failed.append(f"[attempt{k}] {type(e).__name__}: {e}")
    return None, "\n".join(failed)


def answered(asked: DataFrame, model: Callable[..., str], pause: float = 0.0) -> DataFrame:
    """paper_id, answer, error: what the model says to each prompt. A call that fails with all parameters gives its errors.
    pause: seconds between the calls of a task, for models with a limit."""
    model = paced(model, pause)

    def run(batches):
        for batch in batches:
            answers, errors = zip(*[called(model, p) for p in batch.column(1).to_pylist()], strict=True) if batch.num_rows else ([], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(answers, pa.string()), pa.array(errors, pa.string())], names=["paper_id", "answer", "error"])

    kind = asked.schema["paper_id"].dataType.simpleString()
    return map_arrow(asked, run, f"paper_id {kind}, answer string, error string")


def replayed(asked: DataFrame, recorded: DataFrame) -> DataFrame:
    """paper_id, answer, error from recorded answers (paper_id, answer)."""
    joined = asked.select("paper_id").join(recorded.select("paper_id", "answer"), "paper_id", "left")
    return joined.select("paper_id", "answer", F.when(F.col("answer").isNull(), "no recorded answer").alias("error"))


def chunks(answers: DataFrame, caps: dict[str, int] | None = None) -> DataFrame:
    """Normalised chunks of answers that are objects with a list of them."""
    parsed = F.from_json(json_object(F.col("answer")), "struct<chunks:array<string>>")
    rows = answers.select("paper_id", F.posexplode(parsed["chunks"]).alias("ord", "c"))
    said = lambda k: F.get_json_object("c", f"$.{k}")
    raw = F.try_variant_get(F.try_parse_json("c"), "$.supporting_quote", "variant")
    quote = F.when(F.schema_of_variant(raw) == "STRING", json_text(F.try_variant_get(raw, "$", "string"))).otherwise(F.to_json(raw))
    return normalise_chunks(rows.select("paper_id", "ord", said("chunk_type").alias("chunk_type"), said("text").alias("text"), quote.alias("supporting_quote"), said("section_hint").alias("section_hint")), caps)


def metadata(answers: DataFrame) -> DataFrame:
    """paper_id, title, abstract, keywords, authors; what an answer lacks is empty."""
    m = F.from_json(json_object(F.col("answer")), f"struct<{_struct(METADATA)}>")
    text = lambda c: F.coalesce(strip(m[c]), F.lit(""))
    listed = lambda c, kind: F.coalesce(m[c], F.array().cast(kind))
    return answers.select("paper_id", text("title").alias("title"), text("abstract").alias("abstract"), listed("keywords", "array<string>").alias("keywords"), listed("authors", "array<struct<author:string,affiliation:string,email:string,orcid:string,is_corresponding:boolean>>").alias("authors"))


def _struct(ddl: str) -> str:
    from ..sources.files import _fields

    return _fields(ddl)


def allowed_entities(rows: DataFrame, categories: DataFrame, category: str = "category", kind: str = "class") -> DataFrame:
    """Rows whose class the category of their region may yield. categories: category, class (a table of the schema)."""
    allowed = categories.select(F.col("category").alias(category), F.col("class").alias(kind)).distinct()
    return rows.join(F.broadcast(allowed), [category, kind], "left_semi")  # some hundred rows of configuration


def markdown_path(base: Column | str, paper_id: Column) -> Column:
    base = F.lit(base) if isinstance(base, str) else base
    return F.concat(base, F.lit("/"), paper_id, F.lit("/markdown/"), paper_id, F.lit("_md.md"))


def read_papers(spark: SparkSession, base: str, limit: int = 0) -> DataFrame:
    """paper_id, text of the papers below base that have a markdown file. limit: the first so many by id (numbers by value, then
    the rest by text); 0 for all."""
    rows = spark.read.option("pathGlobFilter", "*_md.md").option("recursiveFileLookup", "true").text(base, wholetext=True)
    papers = rows.select(F.regexp_extract("_metadata.file_name", r"\A(.*)_md\.md\z", 1).alias("paper_id"), F.col("value").alias("text"))
    return first_papers(papers, limit)


def first_papers(papers: DataFrame, limit: int) -> DataFrame:
    """The first papers by id; all if limit is 0."""
    return papers.orderBy(numeric_first(F.col("paper_id"))).limit(limit) if limit else papers
