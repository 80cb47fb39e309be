"""Resumable runs: what is done is known by its keys; what is left is an anti-join or the rest of a file stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def pending(given: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not done yet."""
    return given.join(done.select(key).distinct(), key, "left_anti")


def run_pending(spark: SparkSession, given: DataFrame, key: str, step: Callable[[DataFrame], DataFrame], target: str) -> int:
    """Applies step to the rows whose keys are not in the Parquet folder target, and appends the result; rows written.

    The step's rows carry the key also where it failed for a row, so such rows are not tried forever. A target that
    cannot be read counts as empty, and is written anew."""
    try:
        done = spark.read.parquet(target)
        left = pending(given, done, key)
        mode = "append"
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        left, mode = given, "overwrite"
    before = 0 if mode == "overwrite" else done.count()
    step(left).write.mode(mode).parquet(target)
    return spark.read.parquet(target).count() - before


def stream_files(spark: SparkSession, folder: str, schema: str, step: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, file_format: str = "parquet") -> None:
    """Runs step once over the files of a folder that no earlier run has read; the stream's checkpoint knows them."""
    rows = spark.readStream.schema(schema).format(file_format).load(folder)
    query = step(rows).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(target)
    query.awaitTermination()
