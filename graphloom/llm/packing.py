"""Packing by lexical retrieval: a sharded BM25 inverted index gives unused neighbours that fill a seed's window.

Of each document whole windows are cut first; what remains (its rest) is an item of the index, with its token ids as
terms. Numbers of documents by term are counted over the whole corpus. Items are dealt to shards by their rarest shared
terms: they are put in the order of those terms over the whole corpus (a range shuffle), and a shard is a bounded run of
that order, so related documents meet wherever they stand in the input. The first unused item is the seed of a window;
its heaviest terms query the index, then all its terms, then those of the other items of the window, and the best scored
unused items follow; only when no unused item of the shard scores above 0 the next item in order is taken. An item that
does not fit is cut there, and its second piece is the seed of the next window. The last open window of a shard is carried
into the next; that of a partition is split into sequences of powers of two, which need no padding.

A seed queries its own shard: items that share none but terms that are not among their rarest may lie in others.

Defined results: null and empty texts are one end token; repeated rows are packed each; a null doc_id is carried;
very long texts are packed whole; other columns are not read; an empty table gives an empty result. Strings of special tokens
in a text become their ids, as tokenizers does unless told otherwise.
"""

from __future__ import annotations

import base64
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow, remove_folder, shared_folder, small_batches, stored

WINDOW = 1024
END = 0
#: Bounds of a shard: documents and tokens.
SHARD_DOCS, SHARD_TOKENS = 2048, 1 << 22
QUERY_TERMS = 8
#: Rarest shared terms that put an item in order.
ROUTE_TERMS = 4
K1, B = 1.2, 0.75
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
#: Code points over which both tokenizer libraries split alike (checked by a test); other texts take the slower one.
ALIKE = r"\x00-\u023f\u2010-\u2027\u2030-\u205e\u20ac"


class Encoder:
    """Token ids of the byte-level BPE in file json, as tokenizers gives them (special strings in a text become special ids).
    Computed by tiktoken, some three times faster, where both are known to agree: no special string, no code point outside
    ALIKE."""

    def __init__(self, json: str | None = None, ranks: str | None = None):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self._slow = Tokenizer.from_file(json or public_tokenizers.path("byte_bpe_50k.json"))
        table = {}
        with open(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            for line in f:
                token, rank = line.split()
                table[base64.b64decode(token)] = int(rank)
        self.fast = tiktoken.Encoding("fast", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.special = [t.content for t in self._slow.get_added_tokens_decoder().values()]
        self.other = re.compile(f"[^{ALIKE}]").search

    def slow(self, text: str) -> np.ndarray:
        return np.array(self._slow.encode(text, add_special_tokens=False).ids, np.uint32)

    def __call__(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special) or not text.isascii() and self.other(text):
            return self.slow(text)
        return self.fast.encode_to_numpy(text, disallowed_special=())


_encoders: dict = {}


def encoder(json: str | None, ranks: str | None) -> Encoder:
    if (json, ranks) not in _encoders:
        _encoders[json, ranks] = Encoder(json, ranks)
    return _encoders[json, ranks]


class Corpus:
    """What is counted over all items: their number, mean size, and number by term."""

    def __init__(self, items: int, tokens: int, terms: np.ndarray, df: np.ndarray):
        self.items, self.mean = items, tokens / max(items, 1)
        self.df = np.zeros(int(terms.max()) + 1 if len(terms) else 1, np.int64)
        self.df[terms] = df

    def route(self, ids: np.ndarray) -> bytes:
        """The rarest terms that another item shares; sorts as bytes."""
        terms = np.unique(ids)
        df = self.df[terms]
        terms, df = terms[df > 1], df[df > 1]
        return terms[np.lexsort((terms, df))[:ROUTE_TERMS]].astype(">u4").tobytes()


class Index:
    """BM25 inverted index over the items of one shard, weighed by the counts of the corpus (else of the shard)."""

    def __init__(self, items: list[np.ndarray], corpus: Corpus | None = None):
        n = len(items)
        sizes = np.array([len(x) for x in items], np.int64)
        owner = np.repeat(np.arange(n), sizes)
        terms = np.concatenate(items).astype(np.int64) if n else np.zeros(0, np.int64)
        keys, tf = np.unique(terms * max(n, 1) + owner, return_counts=True)
        term, self.item = keys // max(n, 1), keys % max(n, 1)
        self.terms, self.at, df = np.unique(term, return_index=True, return_counts=True)
        self.until = self.at + df
        count, mean, wide = (corpus.items, corpus.mean, corpus.df[self.terms]) if corpus else (n, sizes.mean() if n else 1, df)
        idf = np.log1p((count - wide + 0.5) / (wide + 0.5))
        norm = K1 * (1 - B + B * sizes / max(mean, 1e-9))
        slot = np.repeat(np.arange(len(self.terms)), df)
        self.weight = (idf[slot] * tf * (K1 + 1) / (tf + norm[self.item])).astype(np.float32)
        self.scores = np.zeros(n, np.float32)
        # each item's terms that another item shares, heaviest first
        shared = df[slot] > 1
        order = np.lexsort((slot[shared], -self.weight[shared], self.item[shared]))
        self.query, self.query_at = slot[shared][order], np.searchsorted(self.item[shared][order], np.arange(n + 1))

    def ranked(self, seed: int, unused: np.ndarray, terms: int | None = QUERY_TERMS) -> np.ndarray:
        """All unused items that share one of the seed's heaviest terms (None: any term), best first."""
        scores = self.scores
        scores[:] = 0
        query = self.query[self.query_at[seed] : self.query_at[seed + 1]][:terms]
        for a, b in zip(self.at[query].tolist(), self.until[query].tolist(), strict=True):
            scores[self.item[a:b]] += self.weight[a:b]
        found = np.flatnonzero((scores > 0) & unused)
        return found[np.argsort(-scores[found], kind="stable")]


class Packer:
    def __init__(self, window: int, first_sequence: int):
        self.window, self.sequence = window, first_sequence
        self.open: list[tuple] = []  # pieces of the open window: doc_id, start, ids, doc_tokens
        self.filled = 0
        self.rows: list[tuple] = []

    def place(self, doc_id, start: int, ids: np.ndarray, total: int) -> int:
        """Puts as much of ids into the open window as fits; the number put."""
        n = min(len(ids), self.window - self.filled)
        self.open.append((doc_id, start, ids[:n], total))
        self.filled += n
        if self.filled == self.window:
            self._write(self.open)
            self.open, self.filled = [], 0
        return n

    def _write(self, pieces) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1

    def shard(self, docs: list[tuple]) -> None:
        """docs: doc_id, ids (with the end token)."""
        items = []
        for doc_id, ids in docs:
            whole = len(ids) // self.window * self.window
            for at in range(0, whole, self.window):
                self._write([(doc_id, at, ids[at : at + self.window], len(ids))])
            if whole < len(ids):
                items.append((doc_id, whole, ids[whole:], len(ids)))
        self.fill(items)

    def fill(self, items: list[tuple], corpus: Corpus | None = None) -> None:
        """items: doc_id, start, ids of the rest, doc_tokens."""
        index, unused = Index([x[2] for x in items], corpus), np.ones(len(items), bool)
        following = 0
        queries: list[tuple] = []  # of the items of the open window; each first by its heaviest terms, then by all
        queue = iter(())
        while True:
            nxt = next((j for j in queue if unused[j]), None)
            while nxt is None and queries:
                queue = iter(index.ranked(*queries.pop(0)).tolist())
                nxt = next(queue, None)
            if nxt is None:
                while following < len(items) and not unused[following]:
                    following += 1
                if following == len(items):
                    return
                nxt = following
            unused[nxt] = False
            own = [(nxt, unused, QUERY_TERMS), (nxt, unused, None)]
            doc_id, start, ids, total = items[nxt]
            put = self.place(doc_id, start, ids, total)
            if put < len(ids):  # the second piece opens the next window and is its seed
                self.place(doc_id, start + put, ids[put:], total)
                queries, queue = own, iter(())
            elif not self.filled:
                queries, queue = [], iter(())
            else:
                queries += own

    def close(self) -> None:
        """Splits the open window into sequences of powers of two."""
        pieces, self.open, left = self.open, [], self.filled
        self.filled = 0
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            now = []
            while room:
                doc_id, start, ids, total = pieces.pop(0)
                n = min(room, len(ids))
                now.append((doc_id, start, ids[:n], total))
                room -= n
                if n < len(ids):
                    pieces.insert(0, (doc_id, start + n, ids[n:], total))
            self._write(now)

    def taken(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def _cutter(window: int, encode_with: tuple):
    """Rows doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of whole windows, and doc_id, start,
    doc_tokens, rest of what remains (rest: ids of 32 bits)."""

    def run(batches):
        encode = encoder(*encode_with)
        packer = Packer(window, TaskContext.get().partitionId() << 40)
        for given in batches:
            rows = []
            for doc_id, text in zip(given.column(0).to_pylist(), given.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(END))
                whole = len(ids) // window * window
                for at in range(0, whole, window):
                    packer._write([(doc_id, at, ids[at : at + window], len(ids))])
                if whole < len(ids):
                    rows.append((doc_id, whole, None, None, len(ids), None, None, ids[whole:].astype("<u4").tobytes()))
            yield _batch([(*r, None) for r in packer.taken()] + rows, [*TYPES, "binary"], [*NAMES, "rest"])

    return run


NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
TYPES = ["int64"] * 7


def _batch(rows: list[tuple], types=TYPES, names=NAMES) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _ids(rest) -> np.ndarray:
    return np.frombuffer(rest, "<u4")


def _counted(batches):
    """term, items, tokens: items by term; under term -1 all items and their tokens."""
    df, items, tokens = np.zeros(0, np.int64), 0, 0
    for batch in batches:
        for rest in batch.column(0).to_pylist():
            terms = np.unique(_ids(rest))
            if terms[-1] >= len(df):
                df = np.append(df, np.zeros(max(int(terms[-1]) + 1 - len(df), len(df)), np.int64))
            df[terms] += 1
            items, tokens = items + 1, tokens + len(rest) // 4
    held = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(held, -1)), pa.array(np.append(df[held], items)), pa.array(np.append(np.zeros(len(held), np.int64), tokens))],
        names=["term", "items", "tokens"],
    )


def _corpus(rests: DataFrame) -> Corpus:
    """Counts of the corpus: one row a term of the vocabulary at most."""
    parts = map_arrow(rests.select("rest"), _counted, "term bigint, items bigint, tokens bigint")
    with small_batches(rests.sparkSession):
        got = parts.groupBy("term").agg(F.sum("items").alias("items"), F.sum("tokens").alias("tokens")).toArrow()
    term, items, tokens = (got[c].to_numpy() for c in ("term", "items", "tokens"))
    real = term >= 0
    return Corpus(int(items[~real].sum()), int(tokens.sum()), term[real], items[real])


def pack(docs: DataFrame, window: int = WINDOW, tokenizer_json: str | None = None, tokenizer_ranks: str | None = None, id_column: str = "doc_id") -> DataFrame:
    """One row a piece; sequence_id is the partition's number times 2**40 plus a running number, for windows with
    rests 2**62 more. Tokens lie in the shared checkpoint folder between the passes; the pieces, some rows a document, are
    materialised there, and the tokens then removed."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    folder = shared_folder(spark, "tokens")
    schema = f"{SCHEMA}, rest binary"
    stored(map_arrow(rows, _cutter(window, (tokenizer_json, tokenizer_ranks)), schema), folder)
    cut_rows = spark.read.schema(schema).parquet(folder)
    rests = cut_rows.filter("rest is not null").select("doc_id", "start", "doc_tokens", "rest")
    corpus = _corpus(rests)

    def routed(batches):
        for batch in batches:
            routes = [corpus.route(_ids(x)) for x in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(routes, pa.binary())], names=["doc_id", "start", "doc_tokens", "rest", "route"])

    def run(batches):
        packer = Packer(window, (1 << 62) + (TaskContext.get().partitionId() << 40))
        shard, tokens = [], 0
        for given in batches:
            for doc_id, start, total, rest in zip(*(given.column(k).to_pylist() for k in range(4)), strict=True):
                shard.append((doc_id, start, _ids(rest), total))
                tokens += len(rest) // 4
                if len(shard) >= SHARD_DOCS or tokens >= SHARD_TOKENS:
                    packer.fill(shard, corpus)
                    shard, tokens = [], 0
                    yield _batch(packer.taken())
        packer.fill(shard, corpus)
        packer.close()
        yield _batch(packer.taken())

    keyed = map_arrow(rests, routed, "doc_id bigint, start bigint, doc_tokens bigint, rest binary, route binary")
    keyed = keyed.withColumn("draw", F.xxhash64("doc_id", "rest"))  # equal routes: spread by a hash
    ordered = keyed.repartitionByRange("route", "draw").sortWithinPartitions("route", "draw")
    out = cut(cut_rows.filter("rest is null").drop("rest").unionByName(map_arrow(ordered.select("doc_id", "start", "doc_tokens", "rest"), run, SCHEMA)))
    remove_folder(spark, folder)
    return out
