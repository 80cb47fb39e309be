"""Column functions against small Python models, over many made-up strings at a time."""

import hashlib
import json
import random
import re
from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

from graphloom.functions import ids, paths, text, values
from graphloom.operators import graph, metrics

PIECES = ["a", "B", "ü", "İ", " ", "  ", "\t", "\n", "\r\n", "\r", "\xa0", " ", "­", "​", "﻿", "\x1c", "-", "_", ".", "..", "/", "https://x.org/a", "http://", "HTTPS://Y.org", ")", "'", '"', "10.1234/ab", "doi:10.99999/Q.", "0000-0001-2345-678x", "ror.org/0ABCDEFGH", "{", "}", "[", "]", '"k": 1', "```json", "1", "😀", "漢", ",", "&", "<"]


def strings(n=1500, seed=1):
    rng = random.Random(seed)
    return ["", *{"".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 9))) for _ in range(n)}]


def rows(spark, column, given=None):
    given = strings() if given is None else given
    df = spark.createDataFrame([(i, s) for i, s in enumerate(given)], "i int, s string")
    return [r[1] for r in df.select("i", column.alias("out")).orderBy("i").collect()], given


def first(pattern, v, change):
    m = re.search(pattern, v, re.I | re.A)
    return change(m[1]) if m else None


@pytest.mark.parametrize(
    "column,model",
    [
        (lambda: text.strip(F.col("s")), str.strip),
        (lambda: text.short_hash(F.col("s"), 20), lambda v: hashlib.sha256(v.encode()).hexdigest()[:20]),
        (lambda: text.limit_words(F.col("s"), 2), lambda v: v.strip() if len(v.split()) <= 2 else " ".join(v.split()[:2])),
        (lambda: ids.orcid(F.col("s")), lambda v: first(r"(\d{4}-\d{4}-\d{4}-\d{3}[\dX])", v, str.upper)),
        (lambda: ids.ror(F.col("s")), lambda v: first(r"ror\.org/([a-z0-9]{9})", v, str.lower)),
        (lambda: ids.doi(F.col("s")), lambda v: first(r"(?:doi\.org/|doi:)?(10\.\d{4,9}/[^\s,;\"'<>]+)", v, lambda d: d.rstrip(".").lower())),
        (lambda: paths.extension(F.element_at(F.split("s", "/"), -1)), lambda v: PurePosixPath("x/" + v.split("/")[-1]).suffix if "\n" not in v and "\r" not in v and "\x1c" not in v else ...),
    ],
)
def test_scalar(spark, column, model):
    got, given = rows(spark, column())
    for g, v in zip(got, given, strict=True):
        want = model(v)
        if want is ...:
            continue
        assert g == want, repr(v)


def test_json_text(spark):
    got, given = rows(spark, values.json_text(F.col("s")))
    assert [json.loads(g) for g in got] == given


def test_extract_urls(spark):
    """What is found stands in the text, each once, in order, and ends in no closing mark; literal cases beside."""
    got, given = rows(spark, text.extract_urls(F.col("s")))
    for found, v in zip(got, given, strict=True):
        assert all(u in v and u[-1] not in ".,;:)]}>\"'" and u.startswith(("http://", "https://")) for u in found)
        assert len(set(found)) == len(found) and [v.index(u) for u in found] == sorted(v.index(u) for u in found)
    cases = {"see https://x.org/a), http://y.org; and https://x.org/a": ["https://x.org/a", "http://y.org"], "(https://x.org/a_(b).)": ["https://x.org/a_(b"], "HTTP://x.org ftp://y": [], 'a "https://q.org/?x=1&y=2"': ["https://q.org/?x=1&y=2"], "": [], "http://": []}
    got, given = rows(spark, text.extract_urls(F.col("s")), list(cases))
    assert {v: list(g) for v, g in zip(given, got, strict=True)} == cases


def test_slugify(spark):
    """Lower-case words joined by single dashes, the same again when applied again; literal cases beside."""
    got, given = rows(spark, text.slugify(F.col("s")))
    again, _ = rows(spark, text.slugify(text.slugify(F.col("s"))))
    assert got == again and all(re.fullmatch(r"[a-z0-9]+(-[a-z0-9]+)*", g) for g in got)
    cases = {"": "unknown", " --- ": "unknown", "Ada  Lovelace": "ada-lovelace", "https://X.org/a_b": "x-org-a-b", "Ü1": "1", "a--b": "a-b", "see http://y": "see-y"}
    got, given = rows(spark, text.slugify(F.col("s")), list(cases))
    assert dict(zip(given, got, strict=True)) == cases


def test_clean_text(spark):
    """No hidden characters, no runs of blanks, one empty line at most, nothing at the ends; all else stays."""
    got, given = rows(spark, text.clean_text(F.col("s")))
    for g, v in zip(got, given, strict=True):
        assert g is None or g and g == g.strip() and not re.search("[\xad\u200b\u200c\u200d\ufeff\r\t]|  |\n\n\n", g), repr(v)
        bare = lambda x: re.sub("[\\s\xad\u200b\u200c\u200d\ufeff\x1c-\x1f]", "", x or "")
        assert bare(g) == bare(v)
    cases = {" a \t b ": "a b", "a\r\nb\rc": "a\nb\nc", "a\n\n\n\nb": "a\n\nb", "so\u00adft": "soft", " \n ": None, "a \n b": "a \n b"}
    got, given = rows(spark, text.clean_text(F.col("s")), list(cases))
    assert dict(zip(given, got, strict=True)) == cases


@pytest.mark.parametrize("head,tail", [(5, 3), (5, 0)])
def test_compress_text(spark, head, tail):
    """Short texts stay; of long ones the first head and last tail characters (all, if tail is 0) stand between marks."""
    got, given = rows(spark, text.compress_text(F.repeat("s", 60), head, tail))
    for g, v in zip(got, given, strict=True):
        whole = v * 60
        if len(whole) <= head + tail + 200:
            assert g == whole
        else:
            begin, _, end = g.partition("\n\n...\n\n")
            assert begin == f"PAPER_CONTENT_HEAD_START\n{whole[:head]}\nPAPER_CONTENT_HEAD_END"
            assert end == f"PAPER_CONTENT_TAIL_START\n{whole[len(whole) - tail :] if tail else whole}\nPAPER_CONTENT_TAIL_END\n"


def test_json_object(spark):
    def model(v):
        bare = re.sub(r"\s*```\s*$", "", re.sub(r"^\s*```(?:json)?\s*", "", v.strip(), flags=re.I)).strip()
        for part in (bare, bare[bare.find("{") : bare.rfind("}") + 1] if "{" in bare and bare.rfind("}") > bare.find("{") else ""):
            try:
                value = json.loads(part)
            except ValueError:
                continue
            return value if isinstance(value, dict) else None
        return None

    cases = ['{"a": 1}', ' ```json\n{"a": [1, {"b": "}"}]}\n``` ', 'so: {"a": 1} ok', "[1]", '[{"a": 1}]', "", "{", '{"a": 1} {"b": 2}', '{"a": 1}, null', "null", "3", '"{}"', "```\n{}\n```", 'x {"k": "v"} y } z', '{"a":\n1}']
    got, given = rows(spark, text.json_object(F.col("s")), cases)
    assert [None if g is None else json.loads(g) for g in got] == [model(v) for v in given]


def test_quotes(spark):
    cases = ['"  q "', '["a", " ", 3, null, "b "]', "null", "{}", "5", "broken", "[]"]
    got, _ = rows(spark, text.supporting_quotes(F.col("s")), cases)
    assert [list(g) for g in got] == [["q"], ["a", "b"], [], [], [], [], []]


def test_informative(spark):
    cases = {'""': False, '" "': False, '"\\t\\u00a0"': False, '"a"': True, "0": True, "false": True, "[]": False, "{}": False, "null": False, '[""]': True}
    got, given = rows(spark, values.is_informative(F.col("s")), list(cases))
    assert dict(zip(given, got, strict=True)) == cases


def test_merge_is_order_free(spark):
    """Distinct non-empty values by JSON text: one stays, several become a sorted list; the first mention gives the rest."""
    rng = random.Random(3)
    mentions, model = [], {}
    for i in range(600):
        key, attributes = f"n{rng.randrange(40)}", {k: rng.choice(['"x"', '"y"', "1", '""', "[]", "true"]) for k in rng.sample("abc", rng.randrange(0, 4))}
        status = rng.choice(["curated", "referenced"])
        mentions.append((key, f"C{i}", f"I{i}", attributes, (f"e{i}", "s", "m", "a"), status, i))
        m = model.setdefault(key, {"class": f"C{i}", "status": "referenced", "values": {}})
        m["status"] = "curated" if "curated" in (m["status"], status) else "referenced"
        for k, v in attributes.items():
            if v not in ('""', "[]"):
                m["values"].setdefault(k, set()).add(v)
    schema = f"id string, class string, inventory_id string, attributes map<string,string>, evidence {graph.EVIDENCE}, curation_status string, ord bigint"
    rng.shuffle(mentions)
    got = {r.id: r for r in graph.merge_nodes(spark.createDataFrame(mentions, schema).repartition(7)).collect()}
    assert set(got) == set(model)
    for k, m in model.items():
        want = {a: next(iter(v)) if len(v) == 1 else "[" + ",".join(sorted(v)) + "]" for a, v in m["values"].items()}
        assert (got[k]["class"], got[k].curation_status, got[k].attributes) == (m["class"], m["status"], want)


def test_published_ratios(spark):
    """Totals of a published snapshot give its ratios: 1288 nodes, 2419 attributes, 3226 ends, 1734 relation types."""
    row = spark.createDataFrame([(1288, 2419, 3226, 1734)], "n bigint, a bigint, e bigint, r bigint")
    avg = lambda c: metrics.average(F.col(c), F.col("n"))
    out = row.select(avg("a").alias("a"), avg("e").alias("e"), metrics.rounded(avg("a") + avg("e")).alias("d"), avg("r").alias("r")).first()
    assert tuple(out) == (1.878106, 2.504658, 4.382764, 1.346273)


def test_mention_counts(spark):
    nodes = spark.createDataFrame([("A", {"mentionCount": "3"}), ("A", {}), ("B", {"mentionCount": "1"})], "class string, attributes map<string,string>")
    got = {r["class"]: (r.entities, r.mentions, r.ratio) for r in metrics.consolidation(nodes).collect()}
    assert got == {"A": (2, 4, 0.5), "B": (1, 1, 1.0), None: (3, 5, 0.6)}
    for bad in ("0", "true", "-1", "1.5", '"2"'):
        with pytest.raises(Exception, match="mentionCount must be"):
            metrics.consolidation(spark.createDataFrame([("A", {"mentionCount": bad})], "class string, attributes map<string,string>")).collect()


def test_self_loop_counts_once(spark):
    nodes = spark.createDataFrame([("a", "X"), ("b", "X"), ("c", "Y")], "id string, class string")
    edges = spark.createDataFrame([("r", "a", "a"), ("r", "a", "b"), ("s", "b", "a")], "relation string, source string, target string")
    got = {r.id: (r.incident, r.relation_types) for r in metrics.incidence(nodes, edges).collect()}
    assert got == {"a": (3, 2), "b": (2, 2), "c": (0, 0)}
