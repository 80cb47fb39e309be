import math
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from graphloom.llm import packing, queries

from .rows import LONG, TEXTS, documents, empty


def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check(rows, texts, window=1024):
    """Every id lies in one piece, sequences are gapless and hold their window or a power of two."""
    t = tokenizer()
    want = sorted([(d, np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")) for d, x in texts], key=lambda p: repr((p[0], p[1].tolist())))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= window and (at == window or at & (at - 1) == 0)
    copies = defaultdict(list)
    for d, ids in want:
        copies[d].append(ids)
    assert set(copies) == set(by_doc)
    for d, several in copies.items():
        assert sum(p.length for p in by_doc[d]) == sum(map(len, several))
        for p in by_doc[d]:
            assert any(len(ids) == p.doc_tokens and zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for ids in several)
        if len(several) == 1:
            at = 0
            for p in sorted(by_doc[d], key=lambda p: p.start):
                assert p.start == at
                at += p.length
            assert at == len(several[0])


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    check(queries.queries()["op3_packing"](spark, sf_dir).collect(), docs)


def test_awkward_rows(spark):
    check(packing.pack(documents(spark).coalesce(1)).collect(), TEXTS)
    check(packing.pack(documents(spark).repartition(5), window=64).collect(), TEXTS, 64)
    assert packing.pack(empty(spark)).collect() == []


def test_small_shards(spark, monkeypatch):
    packer = packing.Packer(16, 0)
    rng = np.random.default_rng(1)
    total = 0
    for k in range(8):
        shard = [(k * 10 + i, rng.integers(1, 9, rng.integers(1, 40)).astype(np.uint32)) for i in range(10)]
        total += sum(len(x) for _, x in shard)
        packer.shard(shard)
    packer.close()
    rows = packer.taken()
    assert sum(r[2] for r in rows) == total and packer.filled == 0


def test_neighbours_share_a_window():
    """A seed's window is filled with the lexically closest item, not the next one."""
    packer = packing.Packer(64, 0)
    topic = np.arange(100, 120, dtype=np.uint32)
    other = np.arange(500, 520, dtype=np.uint32)
    packer.shard([(1, topic), (2, other), (3, other + 40), (4, topic + 2), (5, other + 1), (6, other + 300)])
    packer.close()
    window = {r[0] for r in packer.taken() if r[5] == 0}
    assert {1, 4} <= window


def test_related_items_fill_the_window():
    """All unused items that score above 0 come before the next one in order, however many there are."""
    items = [(2 * i + k, np.array([100 + k, 1000 + 2 * i + k], np.uint32)) for i in range(40) for k in (0, 1)]
    packer = packing.Packer(80, 0)
    packer.shard(items)
    packer.close()
    first = [r[0] for r in packer.taken() if r[5] == 0]
    assert sorted(first) == list(range(0, 80, 2))


def test_common_terms_are_queried():
    """A term that most items share still retrieves them."""
    packer = packing.Packer(6, 0)
    packer.shard([(1, np.array([7, 11], np.uint32)), (2, np.array([12, 13], np.uint32)), (3, np.array([7, 14], np.uint32)), (4, np.array([7, 15], np.uint32))])
    assert {r[0] for r in packer.taken() if r[5] == 0} == {1, 3, 4}


def test_related_documents_meet_across_partitions(spark):
    """Each document's partner stands in another input partition."""
    word = lambda k, i: "".join(chr(97 + (k * 7919 + i * 104729) // 26**p % 26) for p in range(5))
    texts = [(half * 100 + k, " ".join(word(k, i) for i in range(8))) for half in (0, 1) for k in range(20)]
    docs = documents(spark, texts).repartitionByRange(2, "doc_id")
    rows = packing.pack(docs, window=64).collect()
    check(rows, texts, 64)
    where = defaultdict(set)
    for r in rows:
        where[r.doc_id].add(r.sequence_id)
    assert sum(bool(where[k] & where[100 + k]) for k in range(20)) >= 18


def test_encoders_agree():
    """Over the code points taken as alike the fast encoder gives the same ids; else the slow one is used."""
    encode = packing.Encoder()
    points = [*range(0x240), *range(0x2010, 0x2028), *range(0x2030, 0x205F), 0x20AC]
    text = "".join(f"a{chr(p)}b {chr(p)}{chr(p)} 1{chr(p)}2 '{chr(p)} \n{chr(p)}" for p in points)
    assert encode.other(text) is None
    for part in [text, *(f"x{chr(p)}y {chr(p)}'s  {chr(p)}7{chr(p)}\t{chr(p)}" for p in points), LONG]:
        assert encode(part).tolist() == encode.slow(part).tolist()


def test_special_strings():
    encode, plain = packing.Encoder(), tokenizer()
    for text in ("漢字 <|endoftext|>", "hi <|endoftext|> there", "<|endoftext|>", "a<|endoftext|><|endoftext|>b", "<|endoftext|", "<|endoftext |>", "é <|endoftext|>\n"):
        assert encode(text).tolist() == plain.encode(text, add_special_tokens=False).ids
    assert encode("hi <|endoftext|> there").tolist().count(50256) == 1


def test_encoders_agree_on_a_whole_table(spark):
    encode, plain = packing.Encoder(), tokenizer()
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect():
        assert encode(r.text or "").tolist() == plain.encode(r.text or "", add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_encoders_agree_on_any_text(text):
    assert ENCODER(text).tolist() == ENCODER.slow(text).tolist() == PLAIN.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=[chr(p) for p in (*range(0x240), *range(0x2010, 0x2028), *range(0x2030, 0x205F), 0x20AC)], max_size=80))
def test_encoders_agree_over_alike_points(text):
    assert ENCODER(text).tolist() == ENCODER.slow(text).tolist()


def brute_bm25(items, query, unused):
    """Scores by the formula, from counts over all items; all terms of the query."""
    n, mean = len(items), sum(map(len, items)) / len(items)
    scores = {}
    for j in unused:
        total = 0.0
        for term in set(items[query]):
            tf = items[j].count(term)
            df = sum(term in x for x in items)
            if tf and df > 1:
                total += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(items[j]) / mean))
        if total > 0:
            scores[j] = total
    return scores


def test_ranking_equals_the_formula():
    rng = np.random.default_rng(4)
    items = [rng.zipf(1.4, rng.integers(3, 30)).clip(max=60).astype(np.uint32) for _ in range(80)]
    index, lists = packing.Index(items), [x.tolist() for x in items]
    unused = rng.random(80) < 0.7
    for q in range(80):
        want = brute_bm25(lists, q, [j for j in np.flatnonzero(unused).tolist()])
        got = index.ranked(q, unused, None).tolist()
        assert set(got) == set(want)
        assert all(want[a] >= want[b] - 1e-4 for a, b in zip(got, got[1:], strict=False))


def test_windows_follow_the_ranking():
    """Each item after a window's seed is the best unused one for the seed's heaviest terms, then for all its terms."""
    rng = np.random.default_rng(6)
    items = [rng.choice(np.arange(k % 6 * 40, k % 6 * 40 + 60), 5, replace=False).astype(np.uint32) for k in range(60)]
    packer = packing.Packer(10**6, 0)
    packer.shard([(k, x) for k, x in enumerate(items)])
    packer.close()
    order = [r[0] for r in sorted(packer.taken(), key=lambda r: (r[5], r[6])) if r[1] == 0]
    lists, unused = [x.tolist() for x in items], set(range(1, 60))
    for k in range(1, 10):
        want = brute_bm25(lists, 0, unused)  # five terms: all are among the heaviest
        if not want:
            break
        assert want[order[k]] >= max(want.values()) - 1e-4
        unused.discard(order[k])
    assert sorted(set(order)) == list(range(60))


def test_nothing_stays_in_the_shared_folder(spark, sf_dir):
    import os

    from graphloom.llm.common import checkpoint_dir

    held = lambda: {f for f in os.listdir(checkpoint_dir(spark).removeprefix("file:")) if f.startswith("graphloom-")}
    before = held()
    packing.pack(documents(spark)).count()
    assert held() == before


ENCODER, PLAIN = packing.Encoder(), tokenizer()
