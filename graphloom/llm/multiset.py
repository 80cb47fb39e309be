"""Document fingerprints by a homomorphic multiset hash.

Each paragraph is hashed to a wide vector, and a document's fingerprint is the sum of its paragraphs' vectors modulo
powers of two, lane by lane. So the order of paragraphs does not matter, and a paragraph is put in or taken out by adding or
subtracting its vector alone. A vector has two parts:

- EXACT lanes of 32 bits, uniform and keyed by the whole paragraph: equality of multisets of paragraphs;
- SKETCH lanes of 32 bits: each run of three words of the paragraph adds +1 or -1 to a lane of its hash. The sum is a count
  sketch of the document's runs, so the cosine of two fingerprints estimates how much text they share.

Paragraphs are the lines of a text, as they are; the line ends are not part of them. An empty text has no paragraph. Texts
that differ only in the order of lines have equal fingerprints.

Defined results: null is the empty text; likeness of two texts without words is 1, of one with and one without 0; repeated
rows stand next to each other in the order of ids (by a hash of the text); a null doc_id comes last; very long texts are hashed
whole; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, map_arrow
from .wordhash import blocks, mix, ngram_hashes

EXACT, SKETCH = 16, 256
RUN = 3
#: Documents of a range of the order of ids, about.
RANGE_ROWS = 8192
#: Ranges at most; beyond, ranges are longer, and are still streamed.
MOST_RANGES = 1 << 16
#: Keys of repeated rows that are broadcast at most.
MOST_BROADCAST = 200_000
_SALT = np.uint64(0xA0761D6478BD642F)


def _exact(parts: list[list[bytes]]) -> np.ndarray:
    """Exact lanes of texts given as lists of paragraphs."""
    out = np.zeros((len(parts), EXACT), np.uint32)
    digest = hashlib.blake2b
    raw = b"".join([digest(x, digest_size=4 * EXACT, person=b"paragraph").digest() for p in parts for x in p])
    if raw:
        lanes = np.frombuffer(raw, "<u4").reshape(-1, EXACT)
        sizes = np.array([len(p) for p in parts])
        full = np.flatnonzero(sizes)
        out[full] = np.add.reduceat(lanes, (np.cumsum(sizes) - sizes)[full], axis=0, dtype=np.uint32)
    return out


def paragraphs(text: bytes) -> list[bytes]:
    return text.split(b"\n") if text else []


def vectors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Exact and sketch lanes of each text."""
    parts = [paragraphs(t) for t in texts]
    exact = _exact(parts)
    owner = np.repeat(np.arange(len(texts)), np.array([len(p) for p in parts], np.int64))
    sketch = np.zeros((len(texts), SKETCH), np.int64)
    lines = pa.array([x for p in parts for x in p], pa.binary())
    for a, _, words in blocks(lines):
        line = np.repeat(np.arange(len(words)), np.diff(words.first))
        n = len(words.hashes) - RUN + 1
        hashes = [words.hashes[:0]]
        of = [line[:0]]
        if n > 0:
            inside = line[:n] == line[RUN - 1 :]
            hashes.append(ngram_hashes(words.hashes, RUN)[inside])
            of.append(line[:n][inside])
        # lines of fewer words: the words one by one
        short = np.diff(words.first)[line] < RUN
        hashes.append(mix(words.hashes[short] + _SALT))
        of.append(line[short])
        h, row = np.concatenate(hashes), owner[a + np.concatenate(of)]
        if len(h):
            sign = np.where(h >> np.uint64(63), 1.0, -1.0)
            base = row.min()
            slot = (row - base) * SKETCH + (h & np.uint64(SKETCH - 1)).astype(np.int64)
            some = np.bincount(slot, sign).astype(np.int64)
            sketch.reshape(-1)[base * SKETCH : base * SKETCH + len(some)] += some
    return exact, sketch.astype(np.int32)


def add(a: str, b: str, sign: int = 1) -> str:
    """Fingerprint of the union (sign 1) of two multisets of paragraphs, or of the difference (-1)."""
    (ea, sa), (eb, sb) = decoded(a), decoded(b)
    return encoded((ea + eb) if sign == 1 else (ea - eb), (sa + sb) if sign == 1 else (sa - sb))


def encoded(exact: np.ndarray, sketch: np.ndarray) -> str:
    return base64.b64encode(exact.astype("<u4").tobytes() + sketch.astype("<i4").tobytes()).decode()


def decoded(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    raw = base64.b64decode(fingerprint)
    return np.frombuffer(raw, "<u4", EXACT).copy(), np.frombuffer(raw, "<i4", SKETCH, EXACT * 4).copy()


def fingerprint(text: str) -> str:
    exact, sketch = vectors([text.encode()])
    return encoded(exact[0], sketch[0])


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Row by row, 0 to 1: 1 for equal fingerprints, else the cosine of the sketches, 0 if negative."""
    x, y = a[1].astype(np.float64), b[1].astype(np.float64)
    size = np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
    cosine = np.divide((x * y).sum(axis=1), size, out=np.zeros(len(x)), where=size > 0)
    both_bare = ~x.any(axis=1) & ~y.any(axis=1)
    same = (a[0] == b[0]).all(axis=1) & (a[1] == b[1]).all(axis=1)
    return np.where(same | both_bare, 1.0, np.clip(cosine, 0, 1))


def _pairs(batches) -> Iterator[tuple]:
    """(doc_id, text, next text, times) along sorted rows; a row that only looks ahead ends its range. Equal rows come as one
    with their number: each but the last has its own text as the next."""
    before = None
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(4)] + [batch.column(4).cast(pa.binary()).to_pylist()]
        for part, ahead, ident, count, text in zip(*columns, strict=True):
            if before is not None and before[0] == part:
                yield before[1], before[2], text, 1
                before = None
            if ahead:
                continue
            if count > 1:
                yield ident, text, text, count - 1
            before = part, ident, text


def _edited(text: str, following: str) -> str:
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _run(batches):
    group: list = []
    size = 0
    for pair in _pairs(batches):
        group.append(pair)
        size += len(pair[1]) + len(pair[2])
        if size > 1 << 21:
            yield _batch(group)
            group, size = [], 0
    if group:
        yield _batch(group)


def _batch(group: list) -> pa.RecordBatch:
    ids, texts, following, times = zip(*group, strict=True)
    strings = [t.decode() for t in texts]
    edited = [_edited(t, f.decode()).encode() for t, f in zip(strings, following, strict=True)]
    n = len(group)
    exact, sketch = vectors([*texts, *edited, *following[-1:]])
    own, other = (exact[:n], sketch[:n]), (exact[n : 2 * n], sketch[n : 2 * n])
    # the next document of a row is the next row but at the end of a range
    nxt = [k + 1 if k + 1 < n and following[k] == texts[k + 1] else -1 for k in range(n)]
    loose = [k for k in range(n - 1) if nxt[k] < 0]
    beside_exact, beside_sketch = vectors([following[k] for k in loose])
    pick = lambda rows, extra, last: np.stack([rows[nxt[k]] if nxt[k] >= 0 else last if k == n - 1 else extra[loose.index(k)] for k in range(n)])
    after = (pick(exact, beside_exact, exact[2 * n]), pick(sketch, beside_sketch, sketch[2 * n]))
    columns = {
        "doc_id": pa.array(ids, pa.int64()),
        "n_chars": pa.array([len(t) for t in strings], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in edited]),
        "fingerprint": pa.array([encoded(exact[k], sketch[k]) for k in range(n)]),
        "edited_fingerprint": pa.array([encoded(exact[n + k], sketch[n + k]) for k in range(n)]),
        "near_edited": pa.array(likeness(own, other)),
        "near_next": pa.array(likeness(own, after)),
        "times": pa.array(times, pa.int64()),
    }
    return pa.RecordBatch.from_pydict(columns)


SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _key(docs: DataFrame) -> Column:
    """Sorts as the descending order of ids, null last, then by a hash of the text."""
    ident = docs["doc_id"].cast("bigint")
    return F.struct(ident.isNull().alias("nameless"), F.bitwise_not(F.coalesce(ident, F.lit(0).cast("bigint"))).alias("rid"), F.xxhash64(_text(docs)).alias("mark"))


def _text(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def _ranges(spark: SparkSession, firsts: list) -> tuple[DataFrame, Column, Column]:
    """For the sorted first keys of ranges: a table wide, fine (the keys in runs of about their square root), a column wide
    (the run of column key), and a column range once both are joined."""
    step = math.isqrt(max(len(firsts) - 1, 0)) + 1
    runs = [firsts[k : k + step] for k in range(0, len(firsts), step)]
    literal = lambda r: F.struct(F.lit(r["nameless"]).alias("nameless"), F.lit(r["rid"]).cast("bigint").alias("rid"), F.lit(r["mark"]).cast("bigint").alias("mark"))
    passed = lambda keys: F.size(F.filter(keys, lambda k: k <= F.col("key"))) - 1
    table = spark.createDataFrame([(k, [tuple(r) for r in run]) for k, run in enumerate(runs)], "wide int, fine array<struct<nameless:boolean,rid:bigint,mark:bigint>>")
    return table, passed(F.array(*[literal(r[0]) for r in runs])), F.col("wide") * step + passed(F.col("fine"))


def _once(rows: DataFrame, several: DataFrame) -> DataFrame:
    """rows (key, text) with times; those of keys in several (key, times) once."""
    found = several.count()
    if not found:
        return rows.withColumn("times", F.lit(1).cast("bigint"))
    held = several.select(F.col("key").alias("_key"), F.col("times"))
    marked = rows.join(F.broadcast(held) if found <= MOST_BROADCAST else held, F.col("key") == F.col("_key"), "left").drop("_key")
    once = marked.filter("times is not null").groupBy("key").agg(F.first("text").alias("text"), F.first("times").alias("times"))
    return marked.filter("times is null").withColumn("times", F.lit(1).cast("bigint")).unionByName(once)


def _with_neighbours(docs: DataFrame) -> DataFrame:
    """part, ahead, doc_id, times, text, sorted: ranges of the order of keys, each followed by the first row of the next.

    Keys alone are read first, counted and dealt to ranges by a range shuffle, which gives the first key of each range; so
    texts are shuffled once, and equal rows not at all."""
    spark = docs.sparkSession
    counted = docs.select(_key(docs).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("times"))
    parts = min(MOST_RANGES, max(1, -(-docs.select(F.lit(1)).count() // RANGE_ROWS)))
    dealt = cut(counted.repartitionByRange(parts, "key").withColumn("part", F.spark_partition_id()))
    firsts = [r["key"] for r in dealt.groupBy("part").agg(F.min("key").alias("key")).orderBy("key").collect()]
    if not firsts:
        return spark.createDataFrame([], "part int, ahead boolean, doc_id bigint, times bigint, text string")
    table, wide, place = _ranges(spark, firsts)
    rows = _once(docs.select(_key(docs).alias("key"), _text(docs).alias("text")), dealt.filter("times > 1").select("key", "times"))
    placed = rows.withColumn("wide", wide).join(F.broadcast(table), "wide").withColumn("part", place)
    own = F.struct(F.col("part").alias("part"), F.lit(False).alias("ahead"))
    # the first row of a range also ends the range before; that of the first range ends the last
    before = F.struct(((F.col("part") + len(firsts) - 1) % len(firsts)).alias("part"), F.lit(True).alias("ahead"))
    places = F.when(F.exists("fine", lambda k: k == F.col("key")), F.array(own, before)).otherwise(F.array(own))
    each = placed.select("key", "times", "text", F.explode(places).alias("p")).select("p.part", "p.ahead", "key", "times", "text")
    order = each.repartitionById(len(firsts), F.col("part").cast("int")).sortWithinPartitions("part", "ahead", "key")
    return order.select("part", "ahead", F.when(~F.col("key.nameless"), F.bitwise_not("key.rid")).alias("doc_id"), "times", "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row a document, with its fingerprint and that of its edited text (see SCHEMA)."""
    found = map_arrow(_with_neighbours(docs), _run, f"{SCHEMA}, times bigint")
    return found.withColumn("times", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times")))).drop("times")
