"""Writers: ordered JSON, Markdown tables and labelled snapshots."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class StoreFile:
    """A new file in any store that Spark can write to, by path or URI. Text goes out in UTF-8, a buffer at a time."""

    BUFFER = 1 << 20

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(str(path))
        self.out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
        self.held = bytearray()

    def write(self, text: str | bytes) -> None:
        self.held += text.encode() if isinstance(text, str) else text
        if len(self.held) >= self.BUFFER:
            self.flush()

    def flush(self) -> None:
        self.out.write(self.held)
        self.held = bytearray()

    def __enter__(self) -> StoreFile:
        return self

    def __exit__(self, *error) -> None:
        self.flush()
        self.out.close()


def write_files(spark: SparkSession, folder: str, contents: dict[str, str | bytes]) -> None:
    """Small files below a folder, by their relative paths."""
    for path, content in contents.items():
        with StoreFile(spark, f"{folder.rstrip('/')}/{path}") as out:
            out.write(content)


def write_json_records(df: DataFrame, path: str, order: list[str], name: str | None = None, sort_keys: bool = True) -> int:
    """One JSON document with the rows of df in order, the same bytes for the same rows: indented, sorted keys (or the
    columns' order), a line feed at the end. Rows come to the driver one by one, not all at once; for large tables write
    Parquet instead. Rows written."""
    count = 0
    rows = df.withColumn("_json", F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).orderBy(*order).select("_json")
    with StoreFile(df.sparkSession, path) as out:
        out.write(f"{{\n  {json.dumps(name)}: [" if name else "[")
        for row in rows.toLocalIterator():
            text = json.dumps(json.loads(row["_json"]), ensure_ascii=False, indent=2, sort_keys=sort_keys)
            pad = "    " if name else "  "
            out.write(("," if count else "") + "\n" + pad + text.replace("\n", "\n" + pad))
            count += 1
        out.write(("\n  ]\n}" if name else "\n]") + "\n" if count else ("]\n}\n" if name else "]\n"))
    return count


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """{edges: [...], nodes: [...]} sorted by id. Fields that are null are left out of edges."""
    with StoreFile(nodes.sparkSession, path) as out:
        out.write("{")
        for k, (name, df) in enumerate((("edges", edges), ("nodes", nodes))):
            out.write(("," if k else "") + f'\n  "{name}": [')
            options = {"ignoreNullFields": "true" if name == "edges" else "false"}
            count = 0
            for row in df.withColumn("_json", F.to_json(F.struct(*df.columns), options)).orderBy("id").select("_json").toLocalIterator():
                text = json.dumps(json.loads(row["_json"]), ensure_ascii=False, indent=2, sort_keys=True)
                out.write(("," if count else "") + "\n    " + text.replace("\n", "\n    "))
                count += 1
            out.write("\n  ]" if count else "]")
        out.write("\n}\n")


LABEL = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*")


def valid_label(label: str) -> str:
    """A label names a file, so it holds letters, digits, dots, dashes and underscores only."""
    if not LABEL.fullmatch(label):
        raise ValueError(f"not a label: {label!r}")
    return label


def write_snapshot(record: dict, folder: str) -> Path:
    """Writes or replaces the metric snapshot of its label."""
    path = Path(folder) / f"{valid_label(record['label'])}.json"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(record, ensure_ascii=False, indent=2, sort_keys=True) + "\n", encoding="utf-8")
    return path


def read_snapshots(folder: str) -> list[dict]:
    """All snapshots of a folder, by their order (those without one last), then label."""
    records = [json.loads(p.read_text(encoding="utf-8")) for p in sorted(Path(folder).glob("*.json"))]
    for r in records:
        if not r.get("label"):
            raise ValueError("a snapshot has no label")
    return sorted(records, key=lambda r: (r.get("trajectoryOrder") if r.get("trajectoryOrder") is not None else 1_000_000, r["label"]))


def markdown_cell(value) -> str:
    return str(value).replace("|", "\\|").replace("\n", " ")


def markdown_table(columns: list[str], rows: Iterable[Iterable]) -> str:
    """A table; floats with six places."""
    shown = lambda v: f"{v:.6f}" if isinstance(v, float) else markdown_cell(v)
    lines = ["| " + " | ".join(map(markdown_cell, columns)) + " |", "|" + " --- |" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(map(shown, r)) + " |" for r in rows]) + "\n"


def trajectory_table(folder: str) -> str:
    """One line a snapshot, in order."""
    rows = []
    for r in read_snapshots(folder):
        m = r["metrics"]
        density, richness, merged = m["informationDensity"], m["relationalRichness"], m["consolidation"]["global"]
        rows.append((r.get("displayName") or r["label"], r["counts"]["nodes"], r["counts"]["edges"], density["combinedAveragePerNode"], richness["averageDistinctRelationTypesPerNode"], merged["ratio"]))
    return markdown_table(["Snapshot", "Nodes", "Edges", "Information density", "Relational richness", "Consolidation"], rows)


def portable_path(path: str, root: str) -> str:
    """The path below root, else its name alone."""
    p = Path(path).resolve()
    return p.relative_to(Path(root).resolve()).as_posix() if p.is_relative_to(Path(root).resolve()) else p.name


def append_csv(df: DataFrame, folder: str) -> None:
    """Adds rows to a folder of CSV files that each carry their header."""
    df.write.mode("append").option("header", "true").csv(folder)


def file_digests(files: DataFrame) -> DataFrame:
    """path, sha256 of files (see sources.files)."""
    return files.select("path", F.sha2("content", 256).alias("sha256"))
