from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import components, queries, simhash

from .rows import TEXTS, documents, empty


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def brute_components(prints):
    """prints: list of (doc_id, fingerprint). Component of each by comparing all pairs."""
    different = sorted({f for _, f in prints})
    root = {f: f for f in different}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(different):
        for b in different[:i]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    least = defaultdict(list)
    for d, f in prints:
        if d is not None:
            least[find(f)].append(d)
    return sorted([(d, f, min(least[find(f)], default=None)) for d, f in prints], key=repr)


def as_rows(df):
    return sorted([(r.doc_id, r.fp % (1 << 64), r.component_id) for r in df.collect()], key=repr)


def test_whole_table_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute_components([(r.doc_id, brute_print(r.text)) for r in docs.collect()])
    assert as_rows(simhash.near_duplicates(docs)) == want
    got = queries.queries()["op2_simhash"](spark, sf_dir).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == [(d, f"{f:016x}", c) for d, f, c in sorted(want)]


def test_awkward_rows(spark):
    assert as_rows(simhash.near_duplicates(documents(spark))) == brute_components([(d, brute_print(t)) for d, t in TEXTS])
    assert simhash.near_duplicates(empty(spark)).collect() == []
    kept = simhash.deduplicated(documents(spark))
    assert kept.columns == documents(spark).columns
    ids = sorted(r.doc_id or -1 for r in kept.collect())
    assert ids == sorted({c if c is not None else -1 for *_, c in brute_components([(d, brute_print(t)) for d, t in TEXTS])})


def test_one_document_of_each_component_stays(spark):
    """Unlike documents stay though they share an id or have none; of like ones the least id stays."""
    unlike = [" ".join(f"{w}{i}" for i in range(40)) for w in "abcdefg"]
    texts = [(None, unlike[0]), (None, unlike[1]), (None, unlike[1]), (5, unlike[2]), (5, unlike[3]), (5, unlike[3]), (None, unlike[4]), (8, unlike[4]), (7, unlike[4]), (7, unlike[5]), (3, unlike[5])]
    kept = sorted([(r.doc_id, r.text) for r in simhash.deduplicated(documents(spark, texts)).collect()], key=repr)
    want = [(None, unlike[0]), (None, unlike[1]), (5, unlike[2]), (5, unlike[3]), (7, unlike[4]), (3, unlike[5])]
    assert kept == sorted(want, key=repr)


@pytest.mark.parametrize("most_local", [0, 200_000])
def test_components(spark, monkeypatch, most_local):
    """Chains, cycles, stars and repeated links, in one task and by rounds."""
    monkeypatch.setattr(components, "MOST_LOCAL", most_local)
    rng = np.random.default_rng(7)
    links = [(i, i + 1) for i in range(-40, 0)] + [(100, k) for k in range(101, 130)] + [(200, 201), (201, 202), (202, 200), (202, 200), (300, 300)] + [tuple(map(int, rng.integers(1000, 1200, 2))) for _ in range(90)]
    above = {x: x for link in links for x in link}

    def find(x):
        while above[x] != x:
            x = above[x]
        return x

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        above[high] = low
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a bigint, b bigint").repartition(3), "a", "b").collect()}
    assert got == {x: find(x) for x in above if find(x) != x}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").collect() == []


@pytest.mark.parametrize("hot,most_local", [(4, 0), (128, 0), (128, 200_000)])
def test_dense_groups(spark, monkeypatch, hot, most_local):
    """Groups in which many fingerprints are close to many; keys over the limit are refined and lose no link."""
    monkeypatch.setattr(simhash, "HOT_KEY", hot)
    monkeypatch.setattr(components, "MOST_LOCAL", most_local)
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(-(1 << 62), 1 << 62, 20)]
    base += [b ^ 0b111 << int(rng.integers(0, 58)) ^ 0b11 << int(rng.integers(0, 58)) for b in base]
    prints = {b ^ sum(1 << int(k) for k in rng.choice(62, rng.integers(0, 5), replace=False)) for b in base for _ in range(30)}
    rows = simhash.groups(spark.createDataFrame([(p,) for p in prints], "fp bigint")).collect()
    assert len(rows) == len(prints)
    got = defaultdict(set)
    for r in rows:
        got[r.root].add(r.fp % (1 << 64))
    want = defaultdict(set)
    for _, f, c in brute_components([(k, p % (1 << 64)) for k, p in enumerate(sorted(prints))]):
        want[c].add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert 20 < len(want) < len(prints) / 2


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB é\t\n\x1c\x0b", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) % (1 << 64) == brute_print(text)
