"""SimHash near-duplicates: 64-bit fingerprints, pigeonhole blocks, join on blocks, exact Hamming check, components.

Fingerprints that differ in at most 3 bits agree on at least two of five blocks, so each of the ten pairs of
blocks is a key of about 25 bits and every close pair meets under one of them. Keys shared by many different
fingerprints are refined: of four groups of the bits outside the key at least one agrees as well, so such rows
meet under key and group instead, which loses no pair. Equal fingerprints are collapsed before any join.

No pairs within a group are listed: first every fingerprint is compared with the least one of each of its keys, and what
is close is grouped; then only fingerprints that share a key but not yet a group are compared, and give links of groups.

Defined results: null and wordless texts have fingerprint zero and link like any other; very long texts are hashed whole;
repeated rows share a fingerprint, and deduplicated() keeps one row a component, of ties the least hash of the text; a null
doc_id never is a component's name unless no other id is there; other columns, whatever their names, pass through
deduplicated() and are not read; empty tables give empty results.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow
from .components import components

DISTANCE = 3
SHINGLE = 3
SEED = 42
_EDGES = (0, 12, 25, 38, 51, 64)
#: Keys with more different fingerprints than this are refined.
HOT_KEY = 128


def fingerprint(text: bytes) -> int:
    """Bit is 1 if set in over half the shingles' hashes; as a signed 64-bit number."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = np.ascontiguousarray(hashes[at : at + (1 << 15)])
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def _fingerprints(batches):
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        found = [fingerprint(t.as_py() or b"") for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64()), *batch.columns[2:]], names=["doc_id", "fp", *batch.schema.names[2:]])


def fingerprints(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """doc_id, fp (signed 64 bits), one row a document."""
    rows = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, _fingerprints, "doc_id bigint, fp bigint")


def _mask(ranges) -> int:
    m = 0
    for a, b in ranges:
        m |= ((1 << (b - a)) - 1) << a
    return m - (1 << 64) if m >> 63 else m


def _tables() -> list[tuple[int, list[int]]]:
    """Masks of the ten keys, and of four groups of the bits outside each."""
    blocks = list(zip(_EDGES, _EDGES[1:], strict=False))
    out = []
    for pair in combinations(blocks, 2):
        outside = [b for r in blocks if r not in pair for b in range(*r)]
        groups = [_mask((b, b + 1) for b in outside[k::4]) for k in range(4)]
        out.append((_mask(pair), groups))
    return out


def keys(distinct: DataFrame) -> DataFrame:
    """key, fp: keys (64-bit hashes of what is shared) under which close fingerprints meet. Keys that collide only make
    more comparisons."""
    tables = _tables()
    both = lambda m: F.col("fp").bitwiseAND(F.lit(m).cast("bigint"))
    keyed = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(t).alias("part"), both(m).alias("key")) for t, (m, _) in enumerate(tables)])).alias("k")).select("k.part", "k.key", "fp")
    hot = keyed.groupBy("part", "key").count().filter(F.col("count") > HOT_KEY).select(F.col("part").alias("hot_part"), F.col("key").alias("hot_key"))
    marked = keyed.join(hot, (keyed["part"] == hot["hot_part"]) & (keyed["key"] == hot["hot_key"]), "left")
    groups = F.element_at(F.array(*[F.array(*[F.lit(g).cast("bigint") for g in gs]) for _, gs in tables]), F.col("part") + 1)
    plain = F.array(F.struct(F.lit(-1).alias("group"), F.lit(0).cast("bigint").alias("rest")))
    finer: Column = F.transform(groups, lambda g, i: F.struct(i.alias("group"), g.bitwiseAND(F.col("fp")).alias("rest")))
    each = marked.select("part", "key", "fp", F.explode(F.when(F.col("hot_part").isNull(), plain).otherwise(finer)).alias("g"))
    return each.select(F.xxhash64("part", "key", "g.group", "g.rest").alias("key"), "fp")


def _close(a: str, b: str, distance: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance


def _rooted(rows: DataFrame, column: str, links: DataFrame, left: str, right: str) -> DataFrame:
    """rows with root: what the column's value is linked to, itself at least."""
    roots = components(links, left, right)
    return rows.join(roots, F.col(column) == F.col("node"), "left").withColumn("root", F.coalesce("root", column)).drop("node")


def groups(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """fp, root: fingerprints and the name of their group. distinct: fp, each once."""
    if distance > DISTANCE:
        raise ValueError("five blocks in pairs find up to 3 differing bits")
    keyed = cut(keys(distinct))
    heads = keyed.groupBy("key").agg(F.min("fp").alias("head"))
    stars = keyed.join(heads, "key").filter((F.col("fp") > F.col("head")) & _close("fp", "head", distance)).select("fp", "head").distinct()
    first = cut(_rooted(distinct.select("fp"), "fp", stars, "fp", "head"))
    # keys under which groups still meet
    named = keyed.join(first, "fp")
    mixed = named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("key")
    apart = named.join(mixed, "key", "left_semi")
    other = apart.select(F.col("key").alias("_key"), F.col("fp").alias("right"), F.col("root").alias("right_root"))
    meet = (F.col("key") == F.col("_key")) & (F.col("root") < F.col("right_root")) & _close("fp", "right", distance)
    links = apart.join(other, meet).select("root", "right_root").distinct()
    return _rooted(first.withColumnRenamed("root", "near"), "near", links, "root", "right_root").select("fp", "root")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", distance: int = DISTANCE) -> DataFrame:
    """doc_id, fp, component_id: the least doc_id among all documents reachable over links."""
    prints = cut(fingerprints(docs, id_column))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    rooted = distinct.join(groups(distinct.select("fp"), distance), "fp")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(rooted.join(named, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def deduplicated(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """docs with one document a component: that of the least doc_id (null last), of several the least hash of the text."""
    text, ident = docs["text"].cast("string"), docs["doc_id"].cast("bigint")
    mark = F.xxhash64(F.coalesce(text, F.lit("")))
    prints = map_arrow(docs.select(ident.alias("doc_id"), text.alias("text"), mark.alias("mark")), _fingerprints, "doc_id bigint, fp bigint, mark bigint")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "mark"))
    distinct = cut(prints.groupBy("fp").agg(first.alias("first")))
    rooted = distinct.join(groups(distinct.select("fp"), distance), "fp")
    keep = rooted.groupBy("root").agg(F.min("first").alias("first"))
    # rows of one id and text are one already before the shuffle; equal texts are of one component
    name = lambda i, m: F.struct(i.isNull().alias("nameless"), F.coalesce(i, F.lit(0).cast("bigint")).alias("id"), m.alias("mark"))
    once = docs.select(name(ident, mark).alias("name"), F.struct(*[docs[c] for c in docs.columns]).alias("row")).groupBy("name").agg(F.first("row").alias("row"))
    return once.join(keep.select(name(F.col("first.doc_id"), F.col("first.mark")).alias("name")), "name", "left_semi").select("row.*")
