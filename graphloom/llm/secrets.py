"""Secret scan with corpus-wide ownership frequency, in DataFrame operations only.

Candidates are credential assignments, access keys and long hex runs (base kinds), and long opaque tokens that mix letters
and digits (kind token). Each candidate value is hashed and counted over the whole corpus by distinct owners and distinct
repositories. A value that many owners share, or that stands in many repositories of few owners, is a widely copied
example; any other looks live. Opaque tokens become spans when they look live and do not lie within a base span.

Matches become rows with the lengths of what lies before them; running sums by text and kind give their places, so the work is
linear in matches. Values with very many matches meet their counts by a broadcast of bounded size, all others in a
shuffle in which no value has more than HOT_VALUE rows.

Defined results: null text is empty, a very long one is scanned whole; a null owner counts as one owner, and null ids as one
repository; repeated rows are rows of their own but one repository; other columns pass through redacted() and are not read
by scan(); an empty table gives an empty result. Spans are code points, end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, text_of

# Kinds in their order, patterns, least lengths.
KINDS = ("assign", "access", "hex", "token")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # a run that fails holds no other start that could pass
HEX = r"[0-9a-f]{16,}"  # the same runs as [0-9a-f]+ of 16 characters or more
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
LEAST_VALUE = 12
#: A value that more owners, or more repositories, than these hold is a copied example.
MOST_OWNERS, MOST_REPOSITORIES = 2, 20
#: Values with more matches are hot; so many (50 bytes each) are broadcast at most, beyond that only the hottest.
HOT_VALUE, MOST_HOT = 10_000, 500_000
#: Texts with live spans, and their spans, that are broadcast at most.
MOST_CHANGED, MOST_PIECES = 200_000, 2_000_000
MARK = "[SECRET]"
_BLOCK = 64


def _matches(text: Column, pattern: str, rank: int, value) -> Column:
    """For each match: rank, its number, lengths of what lies before it and of itself, and the hash of its value (null: fails)."""
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("before"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))
    found = F.transform(
        F.filter(pairs, lambda x: x["match"].isNotNull()),
        lambda x, i: F.struct(F.lit(rank).alias("rank"), i.alias("number"), F.length(x["before"]).alias("gap"), F.length(x["match"]).alias("size"), F.sha2(value(x["match"]), 256).alias("value")),
    )
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<rank:int,number:int,gap:int,size:int,value:string>>"))


def candidates(text: Column) -> Column:
    """Matches of all kinds in a text."""

    def assigned(match: Column) -> Column:
        found = F.regexp_extract(match, rf"\A{ASSIGN}", 2)
        return F.when(F.length(found) >= LEAST_VALUE, found)

    whole = lambda m: m
    mixed = lambda m: F.when(m.rlike("[0-9]") & m.rlike("[A-Za-z]"), m)
    return F.concat(_matches(text, ASSIGN, 0, assigned), _matches(text, ACCESS, 1, whole), _matches(text, HEX, 2, whole), _matches(text, TOKEN, 3, mixed))


def _scanned(docs: DataFrame, owner: str, id_column: str) -> DataFrame:
    """row (an own number), doc_id, owner, mark and chars (hash and length of the text), matches. Materialised: texts are
    read once."""
    text = text_of(docs)
    return cut(docs.select(F.monotonically_increasing_id().alias("row"), docs[id_column].alias("doc_id"), docs[owner].cast("string").alias("owner"), F.xxhash64(text).alias("mark"), F.length(text).alias("chars"), candidates(text).alias("matches")))


def _spans(scanned: DataFrame) -> DataFrame:
    """row, doc_id, owner, rank, start, end, value. Materialised."""
    each = scanned.filter(F.size("matches") > 0).select("row", "doc_id", "owner", F.explode("matches").alias("m")).select("row", "doc_id", "owner", "m.*")
    before = Window.partitionBy("row", "rank").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("size")).over(before).cast("int")
    return cut(each.withColumn("end", end).filter("value is not null").select("row", "doc_id", "owner", "rank", (F.col("end") - F.col("size")).alias("start"), "end", "value"))


def ownership(spans: DataFrame) -> DataFrame:
    """value, owners, repositories (both distinct), matches: over all rows, each step summed before the next shuffle."""
    by_repository = spans.groupBy("value", "owner", "doc_id").agg(F.count(F.lit(1)).alias("matches"))
    by_owner = by_repository.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("repositories"), F.sum("matches").alias("matches"))
    return by_owner.groupBy("value").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"), F.sum("matches").alias("matches"))


def _counted(spans: DataFrame) -> DataFrame:
    """spans with owners and repositories of their values."""
    known = ownership(spans)
    hot = cut(known.filter(F.col("matches") > HOT_VALUE))
    bound = HOT_VALUE
    while hot.filter(F.col("matches") > bound).count() > MOST_HOT:
        bound *= 2
    known = known.drop("matches")
    marked = spans.join(F.broadcast(hot.filter(F.col("matches") > bound).drop("matches")), "value", "left")
    rest = marked.filter("owners is null").drop("owners", "repositories").join(known, "value")
    return marked.filter("owners is not null").unionByName(rest)


def _judged(spans: DataFrame, most_owners: int, most_repositories: int) -> DataFrame:
    """row, rank, start, end, owners, repositories, live; opaque tokens only if live and not within a base span."""
    live = (F.col("owners") <= most_owners) & (F.col("repositories") <= most_repositories)
    judged = _counted(spans).withColumn("live", live).filter("rank < 3 or live")
    ahead = Window.partitionBy("row").orderBy("start", F.col("rank") == 3).rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max(F.when(F.col("rank") < 3, F.col("end"))).over(ahead)
    return judged.withColumn("reach", reach).filter("rank < 3 or reach is null or reach < end").select("row", "rank", "start", "end", "owners", "repositories", "live")


def _said(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, owner: str = "source", id_column: str = "doc_id", most_owners: int = MOST_OWNERS, most_repositories: int = MOST_REPOSITORIES) -> DataFrame:
    """One row a document: counts by kind, base spans, all spans, how many look live or copied, and the most owners and
    repositories that share one of its values."""
    scanned = _scanned(docs, owner, id_column)
    judged = _judged(_spans(scanned), most_owners, most_repositories)
    by_row = judged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end", "live"))).alias("all"), F.max("owners").alias("owners"), F.max("repositories").alias("repositories"))
    joined = scanned.select("row", "doc_id").join(by_row, "row", "left").withColumn("all", F.coalesce("all", F.array().cast(by_row.schema["all"].dataType)))
    base = F.filter("all", lambda s: s["rank"] < 3)
    count = lambda test: F.size(F.filter("all", test)).cast("bigint")
    of = lambda rank: count(lambda s: s["rank"] == rank)
    return joined.select(
        "doc_id",
        of(0).alias("n_assign"),
        of(1).alias("n_access"),
        of(2).alias("n_hex"),
        F.sha2(_said(base), 256).alias("base_sha256"),
        _said(F.col("all")).alias("spans"),
        count(lambda s: s["live"]).alias("n_live"),
        count(lambda s: ~s["live"]).alias("n_copied"),
        F.coalesce("owners", F.lit(0)).alias("owners"),
        F.coalesce("repositories", F.lit(0)).alias("repositories"),
    )


def _cut_out(text: Column, gaps: Column, tail: Column) -> Column:
    """What lies in the gaps (structs to, since; sorted) and after tail, joined by the mark. Gaps are read off blocks of the
    text, since a place in a long text is found by walking there."""
    part = lambda t, since, to: F.call_function("substring", t, since + 1, to - since)
    numbers = F.sequence(F.lit(0), F.floor((F.size(gaps) - 1) / _BLOCK).cast("int"))
    own = F.transform(numbers, lambda b: F.slice(gaps, b * _BLOCK + 1, F.lit(_BLOCK)))
    blocks = F.transform(own, lambda g: F.struct(g.alias("gaps"), g[0]["since"].alias("base"), part(text, g[0]["since"], F.element_at(g, -1)["to"]).alias("text")))
    kept = F.transform(blocks, lambda b: F.array_join(F.transform(b["gaps"], lambda g: part(b["text"], g["since"] - b["base"], g["to"] - b["base"])), MARK))
    return F.concat(F.array_join(kept, MARK), F.lit(MARK), F.call_function("substring", text, tail + 1, F.lit(2**31 - 1)))


def redacted(docs: DataFrame, owner: str = "source", most_owners: int = MOST_OWNERS, most_repositories: int = MOST_REPOSITORIES, id_column: str = "doc_id") -> DataFrame:
    """docs with live-looking credentials replaced by a mark; copied examples stay. n_chars follows the text. Patterns are
    sought once; texts with live spans are found again by id, hash and length of the text."""
    scanned = _scanned(docs, owner, id_column)
    live = _judged(_spans(scanned), most_owners, most_repositories).filter("live")
    ahead = Window.partitionBy("row").orderBy("start", "end", "rank").rowsBetween(Window.unboundedPreceding, -1)
    since = F.coalesce(F.max("end").over(ahead), F.lit(0))
    gaps = live.withColumn("since", since).groupBy("row").agg(F.array_sort(F.collect_list(F.when(F.col("start") >= F.col("since"), F.struct(F.col("start").alias("to"), "since")))).alias("gaps"), F.max("end").alias("tail"))
    names = scanned.select("row", F.col("doc_id").alias("_secret_id"), F.col("mark").alias("_secret_mark"), F.col("chars").alias("_secret_chars"))
    changed = cut(names.join(gaps, "row").drop("row").dropDuplicates(["_secret_id", "_secret_mark", "_secret_chars"]))
    size = changed.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.size("gaps")), F.lit(0)).alias("pieces")).first()
    if size["rows"] <= MOST_CHANGED and size["pieces"] <= MOST_PIECES:
        changed = F.broadcast(changed)
    text = text_of(docs)
    same = docs[id_column].eqNullSafe(F.col("_secret_id")) & (F.xxhash64(text) == F.col("_secret_mark")) & (F.length(text) == F.col("_secret_chars"))
    joined = docs.join(changed, same, "left")
    columns = {c: docs[c] for c in docs.columns} | {"text": F.when(F.col("gaps").isNotNull(), _cut_out(text, F.col("gaps"), F.col("tail"))).otherwise(docs["text"])}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("gaps").isNotNull(), F.length(columns["text"])).otherwise(docs["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return joined.select(*[x.alias(c) for c, x in columns.items()])
