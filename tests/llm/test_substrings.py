import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import queries, substrings
from graphloom.llm.automaton import SuffixAutomaton

from .rows import LONG, TEXTS, documents, empty


def brute(texts, window=20):
    """texts: (doc_id, text), doc_ids different."""
    seen, out = set(), []
    for doc_id, text in sorted(texts, key=lambda t: (t[0] is None, t[0])):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((doc_id, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_whole_table_equals_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert got(queries.queries()["op5_substrings"](spark, sf_dir)) == brute(docs)


def passages(n=120, seed=4):
    """Texts with shared passages of many lengths, periodic runs and copies."""
    rng = random.Random(seed)
    shared = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(rng.choice((19, 20, 21, 25, 60)))) for _ in range(6)]
    texts = []
    for i in range(n):
        own = lambda k: " ".join(f"u{rng.randrange(10**6)}" for _ in range(k))
        kind = rng.randrange(5)
        body = f"{own(rng.randrange(30))} {rng.choice(shared)}\n\t{own(rng.randrange(30))}  {rng.choice(shared)}"
        texts.append((i, {0: body, 1: "for " * rng.randrange(70), 2: "x y z " * 15 + body, 3: texts[-1][1] if texts else "", 4: f"{own(5)} {shared[0]} {own(5)}"}[kind]))
    return texts


def test_passages(spark, monkeypatch):
    texts = passages()
    want = brute(texts)
    docs = documents(spark, texts)
    assert sum(r[2] for r in want) > 1000
    assert got(substrings.deduplicated(docs.repartition(3), digest=True)) == want
    monkeypatch.setattr(substrings, "HOT_ANCHOR", 3)
    monkeypatch.setattr(substrings, "SHARD_WORDS", 50)
    assert got(substrings.deduplicated(docs.repartition(7), digest=True)) == want


def test_awkward_rows(spark):
    texts = [t for t in TEXTS if t[0] != 9] + [(30, LONG), (31, "\x1c".join("abcdefghijklmnopqrstuvwxyz")), (32, "é " * 50)]
    assert got(substrings.deduplicated(documents(spark, texts), digest=True)) == brute(texts)
    twice = [(9, "only once here"), (9, "only once here"), (9, LONG), (9, LONG), (40, LONG)]
    rows = got(substrings.deduplicated(documents(spark, twice), digest=True))
    assert [r[1] - r[2] for r in rows if r[0] == 40] == [0] and len(rows) == 5
    assert len({r[3] for r in rows if r[0] == 9}) == 2
    assert substrings.deduplicated(empty(spark)).collect() == []


def test_repeated_rows_keep_their_text(spark, monkeypatch):
    """Equal rows of one doc_id count as one: each copy keeps what the one would keep."""
    part = " ".join(f"p{i}" for i in range(30))
    twice = [(9, LONG), (9, LONG), (3, part), (3, part), (50, part)]
    want = sorted([*brute([(3, part), (9, LONG), (50, part)]), *brute([(9, LONG)]), *brute([(3, part)])], key=repr)
    docs = documents(spark, twice).repartition(2)
    assert got(substrings.deduplicated(docs, digest=True)) == want
    texts = {(r.doc_id, hashlib.sha256(r.kept.encode()).hexdigest()) for r in substrings.deduplicated(docs).collect()}
    assert texts == {(r[0], r[3]) for r in want}


def test_largest_and_least_ids(spark):
    """The largest id stands before a null one and comes back as it is; so do zero and the least."""
    part = " ".join(f"p{i}" for i in range(30))
    ids = [2**63 - 1, None, 0, -(2**63), -1]
    texts = [(i, f"{part} tail{k}") for k, i in enumerate(ids)]
    rows = {r.doc_id: r.n_removed for r in substrings.deduplicated(documents(spark, texts), digest=True).collect()}
    assert rows == {-(2**63): 0, -1: 30, 0: 30, 2**63 - 1: 30, None: 30}
    only = [(2**63 - 1, part), (None, part)]
    assert {r.doc_id: r.n_removed for r in substrings.deduplicated(documents(spark, only), digest=True).collect()} == {2**63 - 1: 0, None: 30}


def test_most_hot_anchors(spark, monkeypatch):
    """Where too many anchors are hot, only the hottest are split; the result stays."""
    texts = passages()
    monkeypatch.setattr(substrings, "HOT_ANCHOR", 1)
    monkeypatch.setattr(substrings, "MOST_HOT", 3)
    assert got(substrings.deduplicated(documents(spark, texts).repartition(5), digest=True)) == brute(texts)


def test_texts_are_shuffled_once(spark, tmp_path):
    """Places must be joined with texts, and spans with texts: both by one shuffle of the texts."""
    docs = documents(spark, [(i, f"{i} {LONG[: 400 * (i % 50)]}") for i in range(2000)])
    docs.write.parquet(str(tmp_path / "d"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = substrings.deduplicated(spark.read.parquet(str(tmp_path / "d")))
        out.write.mode("overwrite").format("noop").save()
        rows = out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(rows) == 2000 and "ReusedExchange" in plan


def test_broadcast_reference(spark):
    """Spans of documents that stand in a bounded reference, whatever its shards; a larger reference is refused."""
    texts = passages()
    reference = [(i, t) for i, t in texts if i % 7 == 0] + [(900, None), (901, ""), (902, "short")]
    held = {tuple(w[i : i + 20]) for _, t in reference for w in [(t or "").split()] for i in range(len(w) - 19)}
    want = {}
    for i, t in texts:
        words = t.split()
        gone = set()
        for k in range(len(words) - 19):
            if tuple(words[k : k + 20]) in held:
                gone |= set(range(k, k + 20))
        want[i] = gone
    for shard_words in (30, 10_000):
        got_ = {i: set() for i, _ in texts}
        for r in substrings.matched(documents(spark, texts), documents(spark, reference), shard_words=shard_words).collect():
            got_[r.doc_id] |= set(range(r.start, r.start + r.length))
        assert got_ == want
    import pytest

    with pytest.raises(ValueError, match="broadcast at most"):
        substrings.matched(documents(spark, texts), documents(spark, texts), most_words=10)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abc", max_size=25), max_size=6))
def test_matching_statistics(sequences):
    automaton, before = SuffixAutomaton(), []
    for s in sequences:
        stats = automaton.feed(s)
        for k in range(len(s)):
            texts = [*before, s[:k]]
            assert stats[k] == max(n for n in range(k + 2) if any(s[k + 1 - n : k + 1] in t for t in texts))
        before.append(s)
