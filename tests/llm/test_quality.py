import math
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import features, quality, queries, rules

from .rows import LONG, TEXTS, documents, empty


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, again = set(), 0
    for x in lines:
        again += x in seen
        seen.add(x)
    at = {}
    for i in range(len(words) - 2):
        at.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab #|é😀\n\t", max_size=60), max_size=4))
def test_counts(texts):
    import pyarrow as pa

    found = features.table_of(pa.array(texts, pa.string()))
    for k, t in enumerate(texts):
        assert tuple(int(found[c][k]) for c in features.COUNTS[:5]) == brute(t)


def failed(n_words, n_repeat):
    return n_words < 50 or 100 * n_repeat > 50 * n_words


def test_rules_whole_table(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.queries()["op7_rules"](spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = brute(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == failed(want[0], want[4]) and not (r.base_failed and r.kept)


def test_rules_awkward_rows(spark):
    docs = documents(spark, [*TEXTS, (60, "w " * 60), (61, " ".join(f"w{i}" for i in range(60)))])
    labels = spark.createDataFrame([(1, 1, None, "x"), (None, 1, 1, "x"), (1, 0, 1, "y")], "doc_id bigint, quality int, toxic int, n_words string")
    rows = rules.judged(docs, labels).collect()
    assert len(rows) == len(TEXTS) + 2
    assert {r.doc_id: r.kept for r in rows if r.doc_id in (60, 61, 7)} == {60: False, 61: True, 7: False}
    assert rules.judged(empty(spark), labels).collect() == []


def test_thresholds_hold_their_risk(spark):
    """Bad rows are symbol-laden; good rows have few symbols. The cutoff rejects the first and spares the second."""
    rng = np.random.default_rng(0)
    texts, known = [], []
    for i in range(3000):
        bad = i % 3 == 0
        texts.append((i, " ".join(f"w{rng.integers(10**6)}{'###' if bad and k % 2 else ''}" for k in range(60)) + (" #" if i % 2 else "")))
        known.append((i, int(not bad), 0))
    docs = documents(spark, texts)
    rows = rules.judged(docs, spark.createDataFrame(known, "doc_id bigint, quality int, toxic int"), stratum="target").collect()
    kept = {r.doc_id: r.kept for r in rows}
    assert sum(not kept[i] for i in range(3000) if i % 3) <= 0.06 * 2000
    assert sum(kept[i] for i in range(0, 3000, 3)) == 0
    few = rules.judged(docs, spark.createDataFrame(known[:90], "doc_id bigint, quality int, toxic int"), stratum="target").collect()
    assert all(r.kept for r in few)


@pytest.mark.parametrize("n,k,p", [(10, 0, 0.1), (50, 7, 0.2), (200, 3, 0.01), (5, 5, 0.3), (8, 2, 0.0), (8, 2, 1.0)])
def test_binomial_tail(n, k, p):
    want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    assert abs(rules.binomial_tail(k, n, p) - want) < 1e-12


def ratios(text):
    """The rules' ratios by the definition."""
    text = text or ""
    n_words, chars, symbols, again, covered = brute(text)
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    plain = lambda w: any(c.isascii() and c.isalnum() or ord(c) >= 128 for c in w)
    raw = text.encode()
    upper = sum(65 <= b <= 90 for b in raw)
    letters = upper + sum(97 <= b <= 122 or b >= 0xC0 for b in raw)
    over = lambda a, b: a / max(b, 1)
    return {"symbols": over(symbols, chars), "dup_lines": over(again, len(lines)), "repeats": over(covered, n_words), "bare_words": over(sum(not plain(w) for w in words), n_words), "upper_case": over(upper, letters), "marks": over(raw.count(b"!"), n_words)}


def brute_kept(rows, quality_of, risk=0.01, error=0.05):
    """rows: (id, stratum, text). kept by the definition: exact binomial tails, loosest cutoff first, Bonferroni."""
    from fractions import Fraction

    passed = {}
    for i, stratum, text in rows:
        n_words, _, _, _, covered = brute(text)
        passed[i] = not failed(n_words, covered)
    good = {}
    for i, stratum, text in rows:
        if passed[i] and quality_of.get(i) == 1:
            good.setdefault(stratum, []).append(ratios(text))
    share = Fraction(str(error)) / (len(features.RATIOS) * max(1, len(good)))
    p = Fraction(str(risk))

    def cutoff(values):
        best, n = None, len(values)
        for c in rules.GRID:
            k = sum(v > c for v in values)
            tail = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
            if Fraction(k, n) > p or tail > share:
                break
            best = c
        return best

    cuts = {s: {r: cutoff([v[r] for v in of]) for r in features.RATIOS} for s, of in good.items()}
    return {i: passed[i] and not any(c is not None and v > c for r, v in ratios(text).items() for c in [cuts.get(stratum, {}).get(r)]) for i, stratum, text in rows}


def test_kept_equals_brute_force(spark):
    """Thresholds and verdicts of every stratum, over rows some of which the method rejects."""
    rng = np.random.default_rng(3)
    rows, known = [], {}
    for i in range(2600):
        bad = rng.random() < 0.3
        words = [f"w{rng.integers(10**6)}" + ("##" if bad and rng.random() < 0.4 else "") + ("!" if rng.random() < 0.02 else "") for _ in range(rng.integers(45, 80))]
        if bad and rng.random() < 0.3:
            words = [w.upper() for w in words]
        rows.append((i, ("x", "y", None)[i % 7 % 3], "\n".join(" ".join(words[k : k + 9]) for k in range(0, len(words), 9))))
        known[i] = int(not bad)
    docs = spark.createDataFrame(rows, "doc_id bigint, lang string, text string")
    labels = spark.createDataFrame(list(known.items()), "doc_id bigint, quality int")
    got = {r.doc_id: r.kept for r in rules.judged(docs, labels).collect()}
    want = brute_kept(rows, known)
    assert got == want
    base = sum(failed(brute(t)[0], brute(t)[4]) for *_, t in rows)
    assert sum(not v for v in want.values()) > base + 200


def test_kept_on_a_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.lang, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    known = {}
    for r in spark.read.parquet(f"{sf}/labels.parquet").collect():
        if r.quality is not None:
            known[r.doc_id] = min(known.get(r.doc_id, 1), r.quality)
    assert {r.doc_id: r.kept for r in queries.queries()["op7_rules"](spark, sf).collect()} == brute_kept(rows, known)


def test_quality_held_out(spark):
    """Accuracy over labels that were never read."""
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in queries.queries()["op1_quality"](spark, sf).collect()}
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in rows.items())
    known = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if rows[r.doc_id].held_out]
    assert len(known) > 80
    right = np.mean([rows[r.doc_id].kept == bool(r.quality) for r in known])
    spared = np.mean([rows[r.doc_id].kept for r in known if r.quality == 1])
    assert right > 0.95 and spared > 0.97


def test_labels_of_held_out_rows_change_nothing(spark):
    docs = documents(spark, [(i, f"{'junk trash' if i % 3 == 0 else 'fine prose'} words here {i}") for i in range(150)])
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    given = [(i, int(i % 3 > 0), 0) for i in range(150)]
    turned = [(i, 1 - q if held(i) else q, 0) for i, q, _ in given]
    schema = "doc_id bigint, quality int, toxic int"
    a, b = (quality.classified(docs, spark.createDataFrame(g, schema)).orderBy("doc_id").collect() for g in (given, turned))
    assert a == b and np.mean([r.kept == (r.doc_id % 3 > 0) for r in a if r.held_out]) > 0.95


def test_words_are_evidence(spark):
    """Texts that differ in nothing but their words, and unlike texts of one id in any order."""
    texts = [(i, " ".join(f"{'abc' if i % 2 else 'xyz'}{k}" for k in range(20))) for i in range(300)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(300)], "doc_id bigint, quality int, toxic int")
    rows = quality.classified(documents(spark, texts), labels).collect()
    assert all(r.kept == (r.doc_id % 2 == 1) for r in rows)
    several = [*texts, *((i, f"other text of {i}") for i in range(0, 300, 7))]
    order = lambda t: quality.classified(documents(spark, t, lambda i: "s").repartition(3), labels).orderBy("doc_id", "score").select("doc_id", "score").collect()
    assert order(several) == order(several[::-1])


def test_what_the_hierarchy_adds(spark):
    """Where words tell little and hosts differ, the posterior of the site betters the evidence alone."""
    rng = np.random.default_rng(9)
    rows, known = [], []
    for i in range(4000):
        host = int(rng.integers(0, 40))
        good = rng.random() < (0.95 if host % 2 else 0.2)
        words = [("plus" if rng.random() < (0.6 if good else 0.4) else "minus") + str(rng.integers(3)) for _ in range(12)]
        rows.append((i, " ".join(words), "p", f"h{host}"))
        known.append((i, int(good), 0))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = quality.classified(docs, spark.createDataFrame(known, "doc_id bigint, quality int, toxic int")).collect()
    held = [(r, known[r.doc_id][1]) for r in got if r.held_out]
    loss = lambda f: -np.mean([np.log(max(1e-9, f(r) if y else 1 - f(r))) for r, y in held])
    assert loss(lambda r: r.score) < loss(lambda r: r.evidence) - 0.02


def test_posteriors_shrink(spark):
    """A site with few rows stays near the global mean, one with many near its own; paths lean on their host."""
    given = [("big", "p", 0.95)] * 400 + [("bad", "p", 0.1)] * 400 + [("tiny", "p", 0.1)] + [("big", "q", 0.1)]
    rows = quality.posteriors(spark.createDataFrame(given, "host string, path string, p double")).collect()
    for r in rows:
        host = (r.host_sum + r.host_worth * r.mean) / (r.host_rows + r.host_worth)
        path = (r.path_sum + r.path_worth * host) / (r.path_rows + r.path_worth)
        if r.site_host == "tiny":
            assert abs(path - 0.1) > abs(path - r.mean) / 2
        elif (r.site_host, r.site_path) == ("big", "q"):
            assert path > 0.4
        else:
            assert abs(path - r.path_sum / r.path_rows) < 0.02


def test_quality_awkward_rows(spark):
    docs = documents(spark, [*TEXTS, (70, LONG)])
    none = quality.classified(docs, spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).collect()
    assert len(none) == len(TEXTS) + 1 and all(abs(r.score - 0.5) < 1e-6 for r in none)
    some = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (4, 1, 0), (None, 0, 0), (7, None, 0), (7, 1, 1)], "doc_id bigint, quality int, toxic int")
    rows = quality.classified(docs, some).collect()
    assert len(rows) == len(TEXTS) + 1 and all(0 <= r.score <= 1 for r in rows)
    assert quality.classified(empty(spark), some).collect() == []
