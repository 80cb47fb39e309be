"""A training-data pipeline of five stages: toxicity, near-duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's docs. All but the last return the columns of documents:

toxicity  drops documents predicted toxic; the model is trained on labels (see graphloom.llm.toxicity)
simhash   keeps one document of each group of near-duplicates, the one with the least doc_id
secrets   replaces live-looking credentials in the texts; copied examples stay
mixing    repeats, cuts or drops documents so that sources come to their target weights
packing   returns the pieces of token sequences of 1024 (see graphloom.llm.packing)

Defined results: null and empty texts are documents without words: they stay until mixing, which takes none of them; very long
texts are treated whole; repeated rows are near-duplicates of each other, as are all documents without words; of ties the
least doc_id stays, then the least hash of the text; null ids stay null; columns beside doc_id, text, source and n_chars pass
through, whatever their names; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import mixing, packing, secrets, simhash, toxicity
from graphloom.llm.common import remove_folder, shared_folder, ship, table

#: The stages train a model, find components and read a tokenizer's file: SQL cannot express them.
ORACLE_SQL = None


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return simhash.deduplicated(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents. The tables between stages lie in the shared checkpoint folder, each until the next is
    written; the last stage materialises its rows there."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = shared_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove_folder(spark, before)
        docs, before = spark.read.parquet(path), path
    out = STAGES[-1][1](spark, docs, sf_dir)
    remove_folder(spark, before)
    return out
