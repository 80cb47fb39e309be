"""Paged services as tables: a Python data source over a transport that can be replaced, and archives pinned by commit.

The transport maps (path, page) to JSON text. The one over HTTP asks page after page until one is empty; the one over files reads
folder/path/page.json, for tests and for machines without a network."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PER_PAGE = 100


def paced(call: Callable, pause: float) -> Callable:
    """call, at least pause seconds after the time before. Counted in each task, so a service sees as many callers as tasks."""
    if pause <= 0:
        return call
    last = [float("-inf")]

    def wait_and_call(*args, **options):
        time.sleep(max(0.0, last[0] + pause - time.monotonic()))
        try:
            return call(*args, **options)
        finally:
            last[0] = time.monotonic()

    return wait_and_call


def from_files(folder: str) -> Callable[[str, int], str]:
    def get(path: str, page: int) -> str:
        name = os.path.join(folder, path.strip("/"), f"{page}.json")
        if not os.path.exists(name):
            return "[]"
        with open(name, encoding="utf-8") as f:
            return f.read()

    return get


def from_http(base: str, token: str | None = None, accept: str = "application/json") -> Callable[[str, int], str]:
    def get(path: str, page: int) -> str:
        from urllib.error import HTTPError
        from urllib.request import Request, urlopen

        headers = {"Accept": accept} | ({"Authorization": f"Bearer {token}"} if token else {})
        try:
            with urlopen(Request(f"{base.rstrip('/')}/{path.strip('/')}?per_page={PER_PAGE}&page={page}", headers=headers), timeout=60) as answer:
                return answer.read().decode()
        except HTTPError as error:
            if error.code == 409:  # an empty repository
                return "[]"
            raise

    return get


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options["paths"].split(",") if p]
        self.folder, self.base, self.token = options.get("folder"), options.get("base"), options.get("token")
        self.pause = float(options.get("pause", 0))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        get = paced(from_files(self.folder) if self.folder else from_http(self.base, self.token), self.pause)
        page = 1
        while True:
            items = json.loads(get(partition.value, page))
            items = items if isinstance(items, list) else [items] if page == 1 and items else []
            if not items:
                return
            for k, item in enumerate(items):
                yield partition.value, page, k, json.dumps(item, ensure_ascii=False, sort_keys=True)
            page += 1


class PagedService(DataSource):
    """Rows path, page, place, json. Options: paths (comma separated), folder or base with token, and pause (seconds between
    calls)."""

    @classmethod
    def name(cls) -> str:
        return "paged_service"

    def schema(self) -> str:
        return "path string, page int, place int, json string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def paged(spark: SparkSession, paths: list[str], **options: str) -> DataFrame:
    """Items of some listings; each listing is read by one task, page by page."""
    spark.dataSource.register(PagedService)
    return spark.read.format("paged_service").option("paths", ",".join(paths)).options(**options).load()


REPOSITORY = "id bigint, name string, full_name string, html_url string, description string, homepage string, default_branch string, created_at string, updated_at string, pushed_at string, language string, topics array<string>, fork boolean, archived boolean, disabled boolean, visibility string, size bigint, stargazers_count bigint, watchers_count bigint, forks_count bigint, open_issues_count bigint, license struct<key:string,name:string,spdx_id:string,url:string>"


def repositories(items: DataFrame, excluded: tuple[str, ...] = ()) -> DataFrame:
    """Listed repositories as metadata records, without those excluded by name."""
    parsed = items.select(F.from_json("json", REPOSITORY).alias("r")).select("r.*").withColumnRenamed("size", "size_kb")
    return parsed.filter(~F.lower("name").isin(*[e.lower() for e in excluded])) if excluded else parsed


def commit_path(full_name: str, branch: str) -> str:
    return f"repos/{full_name}/commits/{branch}"


def head_commits(spark: SparkSession, heads: DataFrame, **options: str) -> DataFrame:
    """full_name, branch, sha: the commit at the head of a branch; null for an empty repository. heads: full_name, branch."""
    pairs = [(r["full_name"], r["branch"]) for r in heads.select("full_name", "branch").distinct().collect()]  # what to ask for, one call each
    named = spark.createDataFrame([(n, b, commit_path(n, b)) for n, b in pairs], "full_name string, branch string, path string")
    if not pairs:
        return named.select("full_name", "branch", F.lit(None).cast("string").alias("sha"))
    told = paged(spark, [commit_path(n, b) for n, b in pairs], **options).select("path", F.get_json_object("json", "$.sha").alias("sha"))
    return named.join(told, "path", "left").select("full_name", "branch", "sha")


def bytes_from_files(folder: str) -> Callable[..., bytes]:
    """Bytes of folder/part/part/...; a missing file is an error."""

    def get(*parts: str) -> bytes:
        with open(os.path.join(folder, *parts), "rb") as f:
            return f.read()

    return get


def bytes_from_http(address: Callable[..., str], headers: dict[str, str] | None = None) -> Callable[..., bytes]:
    """Bytes at the address that the parts make."""

    def get(*parts: str) -> bytes:
        from urllib.request import Request, urlopen

        with urlopen(Request(address(*parts), headers=headers or {}), timeout=300) as answer:
            return answer.read()

    return get


def fetched(asked: DataFrame, get: Callable[..., bytes], pause: float = 0.0) -> DataFrame:
    """asked (string columns, the parts of a place) with content and error: a part that fails gives its error, the others
    stay. One call a row, on the executors."""
    columns = asked.columns
    get = paced(get, pause)

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):  # a row at a time, since contents are large
                content = error = None
                try:
                    content = get(*[batch.column(c)[k].as_py() for c in range(len(columns))])
                except Exception as e:
                    error = f"{type(e).__name__}: {e}"
                row = batch.slice(k, 1)
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([content], pa.binary()), pa.array([error], pa.string())], names=[*columns, "content", "error"])

    from ..session import map_arrow

    return map_arrow(asked, run, ", ".join([*[f"`{c}` string" for c in columns], "content binary, error string"]))


def archives(commits: DataFrame, get: Callable[..., bytes], pause: float = 0.0) -> DataFrame:
    """full_name, sha, content (a ZIP snapshot at that commit), status, error. Repositories without a commit are skipped.
    commits: full_name, sha. get: from name and commit."""
    asked = commits.filter("sha is not null").select("full_name", "sha")
    got = fetched(asked, get, pause).withColumn("status", F.when(F.col("error").isNull(), "success").otherwise("failed"))
    none = commits.filter("sha is null").select("full_name", "sha", F.lit(None).cast("binary").alias("content"), F.lit(None).cast("string").alias("error"), F.lit("skipped").alias("status"))
    return got.unionByName(none)


#: Parts of a dataset resource; its README files follow, by the inventory.
DATASET_PARTS = ("meta_dump.json", "sys_meta_dump.json", "raw_metadata.xml", "file_inventory.json")


def dataset_parts(ids: DataFrame, get: Callable[..., bytes], pause: float = 0.0) -> DataFrame:
    """resource_id, name, text, error: the parts of each resource. A part that fails does not stop the others; without an
    inventory there is an empty one and no README. ids: resource_id. get: from id and name."""
    from .files import tolerant_text

    text = lambda df: df.select("resource_id", "name", tolerant_text(F.col("content")).alias("text"), "error")
    asked = ids.select("resource_id", F.explode(F.array(*[F.lit(p) for p in DATASET_PARTS])).alias("name"))
    parts = text(fetched(asked, get, pause))
    inventory = F.col("name") == "file_inventory.json"
    listed = parts.filter(inventory).select("resource_id", F.explode(F.from_json("text", "array<struct<file_name:string,extension:string>>")).alias("f"))
    wanted = F.startswith(F.lower("f.file_name"), F.lit("readme")) & F.lower("f.extension").isin(".md", ".txt")
    readmes = text(fetched(listed.filter(wanted).select("resource_id", F.col("f.file_name").alias("name")), get, pause))
    return parts.withColumn("text", F.when(inventory, F.coalesce("text", F.lit("[]"))).otherwise(F.col("text"))).unionByName(readmes)


def download_report(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Counts by status (with those that did not occur), and the names that failed or were skipped, with their errors. rows:
    the name column, status, error."""
    statuses = rows.sparkSession.createDataFrame([("success",), ("failed",), ("skipped",)], "status string")
    counts = statuses.join(rows.groupBy("status").agg(F.count(F.lit(1)).alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))
    return counts, rows.filter("status <> 'success'").select(name, "status", "error")


def contributors_summary(people: DataFrame, k: int = 10) -> DataFrame:
    """path, contributors_count, top_contributors: the first k in the order listed."""
    parsed = people.select("path", "page", "place", F.from_json("json", "id bigint, login string, html_url string, type string, contributions bigint").alias("c"))
    listed = parsed.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("page", "place", "c"))).alias("all"))
    return listed.select("path", F.size("all").cast("bigint").alias("contributors_count"), F.transform(F.slice("all", 1, k), lambda x: x["c"]).alias("top_contributors"))


def downloaded_paths(manifests: DataFrame) -> DataFrame:
    """repo, path of files marked as downloaded. manifests: repo, text (JSON lists of files)."""
    files = manifests.select("repo", F.explode(F.from_json("text", "array<struct<path:string,downloaded:boolean>>")).alias("f"))
    return files.filter("f.downloaded").select("repo", "f.path").distinct()
