import gzip
import hashlib
from collections import defaultdict

import pytest

from graphloom.llm import queries, warc
from graphloom.llm.common import shared_folder

SCHEMA = "page_id bigint, url string, html string, payload string, chunk int"


def brute(pages):
    groups = defaultdict(list)
    for p, _, html in pages:
        groups[html or ""].append(p)
    out = []
    for p, _, html in pages:
        data = (html or "").encode()
        keep = max((x for x in groups[html or ""] if x is not None), default=None)
        revisit = len(data) >= 1000 and keep is not None and p != keep
        out.append((p, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", keep if revisit else None))
    return sorted(out, key=repr)


def got(df):
    return sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()], key=repr)


BIG = "é<p>long</p>\r\n\r\nWARC/1.1\r\n" * 20_000
PAGES = [(1, "http://a/", BIG), (2, "http://b/ x\r\ny", BIG), (3, None, None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "u", "x" * 999), (8, "u", "x" * 999), (9, "u", "y" * 1000), (10, "u", "y" * 1000), (10, "u", "y" * 1000), (None, "u", "y" * 1000), (None, "u", "z" * 2000), (None, "u", "z" * 2000), (11, "u", "é" * 500), (12, "u", "é" * 500)]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "p", 3) for r in rows], SCHEMA)


def test_whole_table(spark, sf_dir):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    assert got(queries.queries()["op8_warc"](spark, sf_dir)) == brute(rows)


def test_awkward_rows(spark):
    assert got(warc.round_trip(spark, pages(spark))) == brute(PAGES)
    assert warc.round_trip(spark, pages(spark, [])).collect() == []


def test_keys_beyond_the_broadcast_bound(spark):
    """Chunk rows meet their keys in a shuffle; records that are equal in all columns stay apart."""
    folder = shared_folder(spark, "test")
    rows = PAGES * 2
    manifest = warc.write(pages(spark, rows).repartition(3), folder, chunk=700, most_broadcast=0)
    last = warc.read_chunks(manifest, with_data=False).filter("last").withColumnRenamed("digest", "payload_digest")
    assert got(last) == brute(rows)


def test_read_tasks():
    assert warc._read_tasks(0, 8) == 1 and warc._read_tasks(20, 8) == 20 and warc._read_tasks(100, 8) == 32
    assert warc._read_tasks(1_000_000, 100) == 125_000


def test_no_payload_is_shuffled(spark, sf_dir):
    table = warc.chunk_table(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    assert "hashpartitioning" not in table._jdf.queryExecution().executedPlan().toString()


def test_archives_and_chunks(spark):
    folder = shared_folder(spark, "test")
    manifest = warc.write(pages(spark).coalesce(1), folder, chunk=1000, archive_bytes=2000)
    listed = manifest.collect()
    assert len(listed) > 1 and sum(r.records for r in listed) == len(PAGES)
    for r in listed:
        raw = gzip.open(r.archive).read()
        assert raw.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and raw.endswith(b"\r\n\r\n")
    rows = warc.read_chunks(manifest, chunk=777).collect()
    whole = defaultdict(bytes)
    for r in sorted(rows, key=lambda r: (r.page_id or 0, r.chunk)):
        assert len(r.data) <= 777
        if r.record_type == "response" and r.page_id not in (None, 10):
            whole[r.page_id] += r.data
            assert hashlib.sha1(whole[r.page_id]).hexdigest() == r.digest
    assert whole[2] == BIG.encode() and 1 not in whole and whole[12] == ("é" * 500).encode()


def test_damage_is_noticed(spark):
    folder = shared_folder(spark, "test")
    archive = warc.write(pages(spark, [(1, "u", "payload")]).coalesce(1), folder).collect()[0].archive
    raw = gzip.open(archive).read()
    import io

    assert len(list(warc.records(io.BytesIO(raw)))) == 1
    with pytest.raises(ValueError, match="digest"):
        list(warc.records(io.BytesIO(raw.replace(b"\r\n\r\npayload", b"\r\n\r\npaYload"))))
    with pytest.raises(ValueError, match="ends within"):
        list(warc.records(io.BytesIO(raw[: raw.index(b"payload\r\n") + 3])))
