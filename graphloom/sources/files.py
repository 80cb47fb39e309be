"""Readers for text files, JSON documents, id lists and archives. Whole files are rows; nothing is read on the driver."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import unix_lines
from ..session import map_arrow


def tolerant_text(content: Column) -> Column:
    """Bytes as text: UTF-8 where valid, else Latin-1; without byte order mark, with line feeds only."""
    raw = content.cast("string")
    text = F.when(F.is_valid_utf8(raw), raw).otherwise(F.decode(content, "ISO-8859-1"))
    return unix_lines(F.regexp_replace(text, "\\A\ufeff", ""))


def files(spark: SparkSession, folder: str, pattern: str | None = None) -> DataFrame:
    """path (relative to folder), name, content of all files below a folder."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    rows = reader.load(folder)
    base = folder.rstrip("/")
    tail = F.expr(f"substring(path, instr(path, '{base.split(':')[-1]}/') + {len(base.split(':')[-1]) + 1})")
    return rows.select(tail.alias("path"), F.element_at(F.split("path", "/"), -1).alias("name"), "content", F.col("length").alias("size_bytes"))


def texts(spark: SparkSession, folder: str, pattern: str | None = None) -> DataFrame:
    """path, name, text of all files below a folder."""
    return files(spark, folder, pattern).select("path", "name", tolerant_text(F.col("content")).alias("text"))


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a JSON file that holds a list of them, or an object whose values are records (key: its name, else null)."""
    text = spark.read.text(path, wholetext=True)
    listed = F.from_json("value", f"array<struct<{_fields(schema)}>>")
    named = F.from_json("value", f"map<string,struct<{_fields(schema)}>>")
    is_list = F.startswith(F.ltrim(F.regexp_replace("value", r"\A\s+", "")), F.lit("["))
    rows = text.filter(is_list).select(F.explode(listed).alias("record"))
    others = text.filter(~is_list).select(F.explode(F.map_values(named)).alias("record"))
    return rows.union(others).select("record.*")


def _fields(schema: str) -> str:
    """DDL columns as fields of a struct."""
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema).simpleString()[len("struct<") : -1]


def json_or_default(rows: DataFrame, column: str, schema: str, default: Column | None = None) -> DataFrame:
    """Adds value (parsed by schema; the default, else null, where text is missing or broken) and issue (invalid_json where it is
    broken)."""
    value = F.from_json(column, schema, {"mode": "PERMISSIVE"})
    broken = F.col(column).isNotNull() & F.try_parse_json(column).isNull()
    value = F.when(~broken, value)
    if default is not None:
        value = F.when(F.col(column).isNull() | broken, default).otherwise(value)
    return rows.withColumn("value", value).withColumn("issue", F.when(broken, "invalid_json"))


def _listed_ids(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", "\\A\ufeff", ""), "\r?\n")).alias("ord", "line"))
    return lines.select(F.lower(F.trim(F.split("line", ",")[0])).alias("id"), "ord")


def id_list(spark: SparkSession, path: str, length: int = 32) -> DataFrame:
    """id, ord: the first of each id of a file with one a line (any case, first field counts); for others see odd_ids."""
    return _listed_ids(spark, path).filter(F.length("id") == length).groupBy("id").agg(F.min("ord").alias("ord"))


def odd_ids(spark: SparkSession, path: str, length: int = 32) -> DataFrame:
    """id, ord, warning of the lines that id_list leaves out; empty lines are no warning."""
    odd = _listed_ids(spark, path).filter((F.length("id") != length) & (F.col("id") != ""))
    return odd.withColumn("warning", F.concat(F.lit("anomalous id skipped: "), "id"))


def numeric_first(x: Column) -> Column:
    """Sort key: numbers by value, then the rest by text. The text stands last in the struct, as id."""
    number = F.try_to_number(F.when(x.rlike(r"\A\d{1,18}\z"), x), F.lit("9" * 18)).cast("bigint")
    return F.struct(number.isNull().alias("is_text"), number.alias("number"), x.alias("id"))


def zip_members(rows: DataFrame, key: str, content: str = "content") -> DataFrame:
    """key, path, name, size_bytes, content: files of zip archives, without the folder that holds all of them.

    An archive is opened where its row is, and gives its members one by one."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for k, raw in zip(batch.column(0), batch.column(1), strict=True):
                with zipfile.ZipFile(io.BytesIO(raw.as_py())) as archive:
                    for info in archive.infolist():
                        path = info.filename.partition("/")[2]
                        if info.is_dir() or not path:
                            continue
                        data = archive.read(info)
                        columns = [pa.array([k.as_py()], batch.column(0).type), pa.array([path]), pa.array([path.rpartition("/")[2]]), pa.array([len(data)], pa.int64()), pa.array([data], pa.binary())]
                        yield pa.RecordBatch.from_arrays(columns, names=["key", "path", "name", "size_bytes", "content"])

    found = map_arrow(rows.select(F.col(key), F.col(content)), run, f"key {kind}, path string, name string, size_bytes bigint, content binary")
    return found.withColumnRenamed("key", key)
