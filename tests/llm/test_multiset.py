import base64
import hashlib
import math
import random
import struct
from collections import Counter

import numpy as np
import xxhash

from graphloom.llm import multiset, queries

from .rows import LONG, TEXTS, documents, empty

# An independent model of a fingerprint, in plain integers.
TOP, BASE = 1 << 64, 0x9E3779B97F4A7C15


def mixed(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 % TOP
    x ^= x >> 27
    x = x * 0x94D049BB133111EB % TOP
    return x ^ x >> 31


def word_hash(word):
    return mixed((sum((b + 1) * pow(BASE, i, TOP) for i, b in enumerate(word)) + len(word)) % TOP)


def runs(text):
    """Hashes of the runs of three words of each line; of shorter lines those of the words."""
    out = []
    for line in text.encode().split(b"\n") if text else []:
        words = [word_hash(w) for w in line.split()]
        if len(words) < 3:
            out += [mixed((w + 0xA0761D6478BD642F) % TOP) for w in words]
        else:
            out += [mixed((a * BASE * BASE + b * BASE + c) % TOP) for a, b, c in zip(words, words[1:], words[2:], strict=False)]
    return out


def fingerprint(text):
    exact = [0] * 16
    for line in text.encode().split(b"\n") if text else []:
        lanes = struct.unpack("<16I", hashlib.blake2b(line, digest_size=64, person=b"paragraph").digest())
        exact = [(a + b) % (1 << 32) for a, b in zip(exact, lanes, strict=True)]
    sketch = [0] * 256
    for h in runs(text):
        sketch[h % 256] += 1 if h >> 63 else -1
    return exact, sketch


def like(a, b):
    if a == b or not any(a[1]) and not any(b[1]):
        return 1.0
    size = math.sqrt(sum(x * x for x in a[1]) * sum(y * y for y in b[1]))
    return max(0.0, min(1.0, sum(x * y for x, y in zip(a[1], b[1], strict=True)) / size)) if size else 0.0


def written(print_):
    return base64.b64encode(struct.pack("<16I", *print_[0]) + struct.pack("<256i", *print_[1])).decode()


def brute(texts):
    """(doc_id, text) -> doc_id, n_chars, sha of edited, fingerprint, edited fingerprint, likenesses, by the definition."""
    signed = lambda t: (xxhash.xxh64_intdigest(t.encode(), 42) + (1 << 63)) % TOP
    rows = sorted([(d is None, -(d or 0), signed(t or ""), t or "", d) for d, t in texts], key=lambda r: r[:3])
    known, out = {}, []
    for k, (*_, text, d) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][3]
        n = len(text) // 3
        edited = text[: len(text) - n] + following[:n]
        for x in (text, edited, following):
            if x not in known:
                known[x] = fingerprint(x)
        own, other, after = known[text], known[edited], known[following]
        out.append((d, len(text), hashlib.sha256(edited.encode()).hexdigest(), written(own), written(other), round(like(own, other), 9), round(like(own, after), 9)))
    return sorted(out, key=repr)


def got(df):
    return sorted([(*tuple(r)[:5], round(r.near_edited, 9), round(r.near_next, 9)) for r in df.collect()], key=repr)


def test_whole_table(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = queries.queries()["op6_fingerprints"](spark, sf_dir)
    assert got(rows) == brute(docs)
    kept = [r for r in rows.collect() if r.n_chars > 200]
    # likeness estimates the cosine of the multisets of runs themselves
    texts, error = dict(docs), []
    order = sorted(texts, reverse=True)
    for r in kept[:60]:
        a, b = (Counter(runs(texts[d] or "")) for d in (r.doc_id, order[(order.index(r.doc_id) + 1) % len(order)]))
        true = sum(n * b[h] for h, n in a.items()) / math.sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values()) or 1)
        error.append(abs(r.near_next - true))
    assert np.mean(error) < 0.08 and max(error) < 0.35
    assert np.mean([r.near_edited > r.near_next + 0.2 for r in kept]) > 0.95


def test_ranges(spark, monkeypatch):
    rng = random.Random(2)
    texts = [(rng.randrange(10**9) - 5 * 10**8, " ".join(rng.choice("abc") for _ in range(rng.randrange(60)))) for _ in range(150)] + TEXTS
    monkeypatch.setattr(multiset, "RANGE_ROWS", 7)
    assert got(multiset.fingerprints(documents(spark, texts).repartition(5))) == brute(texts)


def test_repeated_rows_and_least_ids(spark, monkeypatch):
    """Rows that share id and text stand once in the order, whatever their number; null and the least id stay apart."""
    texts = [(4, "a b c d")] * 9 + [(None, "x y z")] * 8 + [(None, None), (-(2**63), "least one here"), (2**63 - 1, "largest"), (4, "other text"), (0, "zero")]
    monkeypatch.setattr(multiset, "RANGE_ROWS", 2)
    assert got(multiset.fingerprints(documents(spark, texts).repartition(4))) == brute(texts)
    monkeypatch.setattr(multiset, "MOST_BROADCAST", 0)
    assert got(multiset.fingerprints(documents(spark, texts))) == brute(texts)
    same = [(1, "all the same")] * 5
    assert got(multiset.fingerprints(documents(spark, same))) == brute(same)


def test_awkward_rows(spark):
    assert got(multiset.fingerprints(documents(spark))) == brute(TEXTS)
    assert multiset.fingerprints(empty(spark)).collect() == []
    assert got(multiset.fingerprints(documents(spark, [(5, "alone here")]))) == brute([(5, "alone here")])


def test_homomorphism():
    lines = [f"line {i} of some words {i * i}" for i in range(40)] + ["same", "same"]
    whole = multiset.fingerprint("\n".join(lines))
    random.Random(1).shuffle(lines)
    assert multiset.fingerprint("\n".join(lines)) == whole
    one, rest = "\n".join(lines[:7]), "\n".join(lines[7:])
    assert multiset.add(multiset.fingerprint(one), multiset.fingerprint(rest)) == whole
    assert multiset.add(whole, multiset.fingerprint(rest), -1) == multiset.fingerprint(one)
    assert multiset.fingerprint("\n".join(lines[:-1])) != whole
    assert len({multiset.fingerprint(x) for x in ("", " ", "\n", "a", "a ", "b", LONG)}) == 7


def test_long_repetitive_texts_stay_alike():
    """A run that occurs 40000 times does not wrap its lane."""
    a, b = ([multiset.decoded(multiset.fingerprint("a b c " * n))] for n in (20_000, 40_000))
    pair = [tuple(v[None] for v in x[0]) for x in (a, b)]
    assert multiset.likeness(*pair)[0] > 0.99
