"""WARC archives written and read as a chunked record table.

Payloads travel as rows of record identifier and chunk number, cut where the table is scanned, so no later step holds a whole
record, and no shuffle moves one. The writer turns a stream of chunk rows into gzip members, one a record, in archives of bounded size; the reader
streams archives back into chunk rows that carry the digest of the payload so far, and checks it at the last chunk.

Records whose payloads are equal and of some size are written once: the one with the largest page_id as a response, the others
as revisits that refer to it. Equality is by SHA-256 and length.

Archives lie in a folder that all executors and the driver share (pyarrow opens it, by path or URI). An attempt of a task names
its own files, and only files listed by the attempt that succeeded are read: a lost executor leaves files that nobody reads.

Defined results: null html is an empty payload; a null url becomes about:blank; a null page_id is written without one, and never
is what revisits refer to unless no other id is there: then all are responses; rows that share the largest page_id of a group
are all responses; very long payloads are written and read chunk by chunk; other columns are not read; an empty table gives no
archive and an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, map_arrow, remove_folder, shared_folder

CHUNK = 1 << 16
#: Rows that go to Python at a time hold this much at most: CHUNK times the batch size must stay small.
ARCHIVE_BYTES = 32 << 20
LEAST_REVISIT = 1000
#: Payloads that several records share (40 bytes each) that are broadcast at most.
MOST_BROADCAST = 500_000
#: Bytes of archives that a task reads, about.
READ_BYTES = 256 << 20
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
CHUNK_SCHEMA = "page_id bigint, record_type string, refers_to bigint, payload_bytes bigint, chunk int, last boolean, data binary, digest string"


def _groups(rows: DataFrame, least_revisit: int) -> DataFrame:
    """group_key, keep: payloads that several records share, and the largest page_id of them. Only keys and ids are
    shuffled, and those of one payload are compared where they lie first."""
    large = rows.filter(F.col("payload_bytes") >= least_revisit)
    groups = large.groupBy("key").agg(F.max("page_id").alias("keep"), F.count(F.lit(1)).alias("n"))
    return groups.filter("n > 1 AND keep IS NOT NULL").select(F.col("key").alias("group_key"), "keep")


def chunk_table(pages: DataFrame, chunk: int = CHUNK, least_revisit: int = LEAST_REVISIT, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, sha1, chunk, chunks, data: chunks of a record stand together.

    Records are cut into chunks where they are read. What payloads repeat is told by a table of keys: where that is small
    enough to broadcast, no payload is shuffled; beyond, chunk rows meet their keys in a shuffle, chunk by chunk."""
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("bigint")).withColumn("key", F.unhex(F.sha2("payload", 256)))
    groups = cut(_groups(rows, least_revisit))
    large = F.col("payload_bytes") >= least_revisit
    revisit = F.coalesce(large & F.col("keep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep")), F.lit(False))
    pieces = F.greatest(F.lit(1), F.ceil(F.col("payload_bytes") / chunk)).cast("int")
    part = F.call_function("substring", F.col("payload"), F.col("chunk") * chunk + 1, F.lit(chunk))
    columns = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "sha1", "chunk", "chunks", "data"]
    if groups.count() <= most_broadcast:
        joined = rows.join(F.broadcast(groups), rows["key"] == groups["group_key"], "left").withColumn("revisit", revisit)
        each = joined.withColumn("sha1", F.sha1("payload")).withColumn("chunks", F.when(F.col("revisit"), F.lit(1)).otherwise(pieces)).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        marked = each.withColumn("data", F.when(F.col("revisit"), F.lit(b"")).otherwise(part))
    else:
        cut_rows = rows.withColumn("record", F.monotonically_increasing_id()).withColumn("sha1", F.sha1("payload")).withColumn("chunks", pieces).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        cut_rows = cut_rows.withColumn("data", part).drop("payload")
        marked = cut_rows.join(groups, F.col("key") == F.col("group_key"), "left").withColumn("revisit", revisit).filter(~F.col("revisit") | (F.col("chunk") == 0))
        marked = marked.withColumn("data", F.when(F.col("revisit"), F.lit(b"")).otherwise(F.col("data"))).withColumn("chunks", F.when(F.col("revisit"), F.lit(1)).otherwise(F.col("chunks")))
        marked = marked.repartition("record").sortWithinPartitions("record", "chunk")
    kind = F.when(F.col("revisit"), "revisit").otherwise("response")
    return marked.withColumn("record_type", kind).withColumn("refers_to", F.when(F.col("revisit"), F.col("keep"))).select(*columns)


def _record_id(page_id) -> str:
    return f"<urn:graphloom:page:{'none' if page_id is None else page_id}>"


def _page_of(record_id: str | None):
    found = re.fullmatch(r"<urn:graphloom:page:(-?\d+)>", record_id or "")
    return int(found[1]) if found else None


def _uri(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f<>]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")


def _base32(sha1: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1)).decode()


def _head(fields: list[tuple[str, object]]) -> bytes:
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n"


def record_head(row: dict, date: str = DATE) -> bytes:
    """WARC header of a page's record, and the HTTP header that opens its block."""
    http = HTTP % row["payload_bytes"]
    size = len(http) + (0 if row["record_type"] == "revisit" else row["payload_bytes"])
    fields = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", _record_id(row["page_id"])), ("WARC-Target-URI", _uri(row["url"])), ("WARC-Date", date), ("WARC-Payload-Digest", f"sha1:{_base32(row['sha1'])}")]
    if row["record_type"] == "revisit":
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(row["refers_to"]))]
    return _head([*fields, ("Content-Type", "application/http;msgtype=response"), ("Content-Length", size)]) + http


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


class _Archives:
    """Writes records one after the other into archives of bounded size."""

    def __init__(self, folder: str, limit: int, date: str):
        self.files, self.path = _open(folder)
        self.folder, self.limit, self.date = folder, limit, date
        self.files.create_dir(self.path, recursive=True)
        self.attempt, self.number = uuid.uuid4().hex, 0
        self.out = self.member = None
        self.records = 0
        self.done: list[tuple[str, int]] = []

    def begin(self, head: bytes) -> None:
        if self.out is not None and self.out.tell() >= self.limit:
            self.finish()
        if self.out is None:
            self.name = f"{self.attempt}-{self.number:05d}.warc.gz"
            self.number += 1
            self.out = self.files.open_output_stream(f"{self.path}/{self.name}", compression=None)
            info = b"software: graphloom\r\nformat: WARC File Format 1.1\r\n"
            self._member()
            self.member.write(_head([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", self.date), ("Content-Type", "application/warc-fields"), ("Content-Length", len(info))]) + info)
            self.end()
        self._member()
        self.member.write(head)

    def _member(self) -> None:
        self.member = gzip.GzipFile(filename="", fileobj=self.out, mode="wb", compresslevel=1, mtime=0)

    def end(self) -> None:
        self.member.write(b"\r\n\r\n")
        self.member.close()
        self.records += 1

    def finish(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((f"{self.folder}/{self.name}", self.records - 1))
            self.out, self.records = None, 0


def write(pages: DataFrame, folder: str, chunk: int = CHUNK, archive_bytes: int = ARCHIVE_BYTES, date: str = DATE, least_revisit: int = LEAST_REVISIT, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """Writes archives of pages (page_id, url, html) into folder; the manifest: archive, records."""

    def run(batches):
        archives = _Archives(folder, archive_bytes, date)
        for batch in batches:
            meta = batch.select(["page_id", "url", "record_type", "refers_to", "payload_bytes", "sha1", "chunk", "chunks"]).to_pylist()
            data = batch.column("data")
            for k, row in enumerate(meta):
                if row["chunk"] == 0:
                    archives.begin(record_head(row, date))
                archives.member.write(data[k].as_buffer())
                if row["chunk"] == row["chunks"] - 1:
                    archives.end()
        archives.finish()
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in archives.done], pa.string()), pa.array([n for _, n in archives.done], pa.int64())], names=["archive", "records"])

    return cut(map_arrow(chunk_table(pages, chunk, least_revisit, most_broadcast), run, "archive string, records bigint"))


def _headers(stream) -> dict[str, str] | None:
    """Header fields of the next record, in lower case; None at the end."""
    first = stream.readline()
    while first in (b"\r\n", b"\n"):
        first = stream.readline()
    if not first:
        return None
    if not first.startswith(b"WARC/1."):
        raise ValueError(f"no WARC record starts here: {first[:40]!r}")
    fields = {}
    while (line := stream.readline()) not in (b"\r\n", b""):
        name, _, value = line.decode().partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields


def records(stream, chunk: int = CHUNK):
    """Chunk rows of an archive's page records, as tuples of CHUNK_SCHEMA. Reads a chunk at a time."""
    while (fields := _headers(stream)) is not None:
        left = int(fields["content-length"])
        kind = fields["warc-type"]
        if kind not in ("response", "revisit"):
            while left:
                left -= len(stream.read(min(left, chunk)))
            continue
        length = 0
        while True:  # the HTTP header
            line = stream.readline()
            left -= len(line)
            if line.lower().startswith(b"content-length:"):
                length = int(line.split(b":")[1])
            if line in (b"\r\n", b""):
                break
        told = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
        page, refers = _page_of(fields["warc-record-id"]), _page_of(fields.get("warc-refers-to"))
        if kind == "revisit":
            yield page, kind, refers, length, 0, True, b"", told
            continue
        digest, number = hashlib.sha1(), 0
        while True:
            data = stream.read(min(left, chunk))
            if left and not data:
                raise ValueError("the archive ends within a record")
            digest.update(data)
            left -= len(data)
            so_far = digest.hexdigest()
            if not left and so_far != told:
                raise ValueError(f"digest of {fields['warc-record-id']} does not match")
            yield page, kind, None, length, number, not left, data, so_far
            number += 1
            if not left:
                break


def _read_tasks(archives: int, cores: int, archive_bytes: int = ARCHIVE_BYTES) -> int:
    """One archive a task while there are cores, then several of READ_BYTES together."""
    return max(1, min(archives, max(4 * cores, -(-archives * archive_bytes // READ_BYTES))))


def read_chunks(manifest: DataFrame, chunk: int = CHUNK, with_data: bool = True) -> DataFrame:
    """Chunk rows (CHUNK_SCHEMA) of all archives of a manifest; with_data False leaves data empty."""

    def run(batches):
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                files, path = _open(archive)
                rows: list = []
                held = 0
                with files.open_input_stream(path, compression=None, buffer_size=1 << 20) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for row in records(stream, chunk):
                        rows.append(row if with_data else (*row[:6], None, row[7]))
                        held += len(row[6]) + 200
                        if held > 8 << 20:
                            yield _rows(rows)
                            rows, held = [], 0
                yield _rows(rows)

    tasks = _read_tasks(manifest.count(), manifest.sparkSession.sparkContext.defaultParallelism)
    spread = manifest.select("archive").repartition(tasks, "archive")
    return map_arrow(spread, run, CHUNK_SCHEMA)


def _rows(rows: list) -> pa.RecordBatch:
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.string()]
    names = [c.split()[0] for c in CHUNK_SCHEMA.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes pages, reads the archives back and returns a row a page: page_id, payload_bytes, payload_digest,
    record_type, refers_to. The archives are removed afterwards."""
    folder = shared_folder(spark, "warc")
    manifest = write(pages, folder)
    last = read_chunks(manifest, with_data=False).filter("last")
    out = cut(last.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to"))
    remove_folder(spark, folder)
    return out
