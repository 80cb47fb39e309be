"""Substring deduplication with suffix automata of reference shards.

A word is removed if a window of 20 words that covers it also starts earlier in the corpus.

Two forms:

- matched(): documents against a bounded reference table (a benchmark, a block list). The reference is cut into shards, which
  are broadcast, one suffix automaton each, built once a Python worker; documents stream through all of them, and maximal
  spans whose matching statistic reaches the window are told.
- deduplicated(): the corpus against itself. Such a reference grows without bound: its automata could not be broadcast, and
  every document would meet every shard. So passages are routed to the one shard whose automaton could match them:

  1. Each window of a text has an anchor, the least hash of its runs of eight words (the leftmost, if equal). Equal
     windows have equal anchors. Only windows whose anchor occurs more than once can repeat.
  2. Windows next to each other that share an anchor make a passage. Passages are routed by anchor, so equal windows
     meet in one shard. Anchors with very many occurrences are split further: there each window is routed by its own hash.
  3. A shard streams its passages in corpus order through one suffix automaton; the matching statistic at each word tells
     whether the window that ends there stood in the text before. Maximal spans of such windows are removed.

  Anchors and passages that repeat within a batch are collapsed before they are shuffled: of equal passages the first goes
  on, and what is known of the others travels as merged spans. Texts are shuffled once, by a hash that names the row; the
  last join reuses that shuffle.

Defined results: null text has no words. Very long texts are read in blocks, whole. Rows that share a doc_id are told apart
by their text, in the order of its hash; equal rows of one doc_id count as one and get the same result. A null doc_id comes
after all others. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .automaton import SuffixAutomaton
from .common import cut, map_arrow, remove_folder, shared_folder, stored
from .wordhash import blocks, mix, ngram_hashes

#: Words a window; words an anchor.
WINDOW, ANCHOR = 20, 8
#: Words after which a shard starts a new automaton.
SHARD_WORDS = 30_000
#: Anchors with more occurrences are routed by window; so many anchors (8 bytes each) are broadcast at most, beyond that only
#: those with the most occurrences.
HOT_ANCHOR, MOST_HOT = 4096, 4_000_000
#: Documents looked at together.
BATCH_ROWS, BATCH_BYTES = 10_000, 64 << 20
#: Words of a reference that matched() broadcasts at most.
MOST_REFERENCE = 200_000


def _runs(words, window: int):
    """Runs of windows that share an anchor position: text, first and last window, anchor position and hash."""
    spread = window - ANCHOR + 1
    grams = ngram_hashes(words.hashes, ANCHOR)
    n = len(words.hashes) - window + 1
    if n <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    text = np.repeat(np.arange(len(words)), np.diff(words.first))
    valid = np.flatnonzero(text[:n] == text[window - 1 :])
    at = np.empty(len(valid), np.int64)
    view = np.lib.stride_tricks.sliding_window_view(grams, spread)
    for i in range(0, len(valid), 1 << 17):
        part = valid[i : i + (1 << 17)]
        at[i : i + len(part)] = part + view[part].argmin(axis=1)
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (valid[1:] != valid[:-1] + 1)])) if len(valid) else np.zeros(0, np.int64)
    last = np.append(new[1:], len(valid)) - 1 if len(new) else new
    return text[valid[new]], valid[new], valid[last], at[new], grams[at[new]]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _identified(docs: DataFrame) -> DataFrame:
    """nameless (no id), id, row (hash of id and text: names the row), text."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    ident = docs["doc_id"].cast("bigint")
    nameless = F.coalesce(ident.isNull(), F.lit(True))
    return docs.select(nameless.alias("nameless"), F.coalesce(ident, F.lit(0).cast("bigint")).alias("id"), F.xxhash64(nameless, F.coalesce(ident, F.lit(0)), text).alias("row"), text.alias("text"))


def _gathered(batches):
    """Batches of at least BATCH_ROWS rows or BATCH_BYTES, so that repeats meet before they are shuffled."""
    kept, rows, size = [], 0, 0
    for batch in batches:
        kept.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= BATCH_ROWS or size >= BATCH_BYTES:
            yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
            kept, rows, size = [], 0, 0
    if rows:
        yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]


def _anchors(window: int):
    """Rows route, row, at, n, ats. A place whose anchor stands once in its batch: route is the anchor, at its word, n 1. An
    anchor that stands several times in its batch: at null, n the times. Places of such anchors, known to repeat: one
    row a text, ats their words, n 0, routed anywhere."""

    def run(batches):
        for batch in _gathered(batches):
            name = batch.column(0).to_numpy(zero_copy_only=False)
            rows, places, anchors = [], [], []
            for a, _, words in blocks(batch.column(1)):
                text, _, _, at, anchor = _runs(words, window)
                rows.append(a + text)
                places.append(at - words.first[text])
                anchors.append(anchor)
            if not rows:
                continue
            row, place, anchor = np.concatenate(rows), np.concatenate(places), np.concatenate(anchors)
            if not len(row):
                continue
            values, which, count = np.unique(anchor, return_inverse=True, return_counts=True)
            several = count[which] > 1
            single = ~several
            told = count > 1
            # places stand in the order of texts
            known, size = np.unique(row[several], return_counts=True)
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(size)]).astype(np.int32), pa.array(place[several].astype(np.int32)))
            n_single, n_told, n_known = int(single.sum()), int(told.sum()), len(known)
            nothing = lambda n, kind: pa.nulls(n, kind)
            yield pa.RecordBatch.from_arrays(
                [
                    _signed(np.concatenate([anchor[single], values[told], mix(name[known].view(np.uint64))])),
                    pa.concat_arrays([pa.array(name[row[single]]), nothing(n_told, pa.int64()), pa.array(name[known])]),
                    pa.concat_arrays([pa.array(place[single].astype(np.int32)), nothing(n_told + n_known, pa.int32())]),
                    pa.array(np.concatenate([np.ones(n_single, np.int32), count[told].astype(np.int32), np.zeros(n_known, np.int32)])),
                    pa.concat_arrays([nothing(n_single + n_told, lists.type), lists]),
                ],
                names=["route", "row", "at", "n", "ats"],
            )

    return run


def _places(identified: DataFrame, window: int, hot_anchor: int) -> DataFrame:
    """route, row, ats, times: words of each text at which anchors stand that occur more than once; and, with row null,
    anchors that occur more than hot_anchor times."""
    found = map_arrow(identified.select("row", "text"), _anchors(window), "route bigint, row bigint, at int, n int, ats array<int>")
    times = F.sum("n").over(Window.partitionBy("route"))
    counted = found.withColumn("times", times).filter(F.col("ats").isNotNull() | (F.col("times") > F.when(F.col("at").isNotNull(), 1).otherwise(hot_anchor)))
    hot = F.when(F.col("ats").isNull() & (F.col("times") > hot_anchor), F.col("times"))
    return counted.select(F.when(hot.isNotNull(), F.col("route")).alias("hot"), F.coalesce(hot, F.lit(0)).alias("times"), "row", F.when(F.col("at").isNotNull(), F.array("at")).otherwise(F.col("ats")).alias("ats"))


def _hot(places: DataFrame) -> np.ndarray:
    """Sorted hot anchors, MOST_HOT at most: beyond, the bound of occurrences is doubled until they fit."""
    found = places.filter("hot is not null").groupBy("hot").agg(F.max("times").alias("times"))
    bound = 0
    while found.filter(F.col("times") > bound).count() > MOST_HOT:
        bound = max(2 * bound, 2 * HOT_ANCHOR)
    return np.sort(found.filter(F.col("times") > bound).select("hot").toArrow()["hot"].to_numpy().view(np.uint64))


def _merged(text: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of texts, sorted, with those that touch made one."""
    order = np.lexsort((start, text))
    text, start, stop = text[order], start[order], stop[order]
    if not len(text):
        return text, start, stop
    shift = text.astype(np.int64) << 32
    reach = np.maximum.accumulate(shift + stop)
    new = np.concatenate([[True], (text[1:] != text[:-1]) | (shift[1:] + start[1:] > reach[:-1])])
    first = np.flatnonzero(new)
    return text[first], start[first], np.maximum.reduceat(stop, first)


def _passages(window: int, hot: np.ndarray):
    """Rows route, nameless, id, row, start, windows, body of passages; without body: words start to start + windows are
    known to repeat."""

    def run(batches):
        for batch in _gathered(batches):
            nameless, ids, names = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            places = batch.column(4)
            routes, who, starts, counts, bodies = [], [], [], [], []
            for a, b, words in blocks(batch.column(3)):
                text, first, last, at, anchor = _runs(words, window)
                # the repeated anchors of these texts, as word numbers of the block
                known = np.unique(np.concatenate([np.asarray(places[r].values) + words.first[r - a] for r in range(a, b)]))
                hit = np.isin(at, known)
                text, first, last, anchor = text[hit], first[hit], last[hit], anchor[hit]
                burning = np.zeros(len(anchor), bool)
                if len(hot):
                    burning = hot[np.minimum(np.searchsorted(hot, anchor), len(hot) - 1)] == anchor
                # hot anchors: each window for itself
                size = np.where(burning, last - first + 1, 1)
                which = np.repeat(np.arange(len(text)), size)
                step = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
                begin = first[which] + np.where(burning[which], step, 0)
                windows = np.where(burning[which], 1, (last - first + 1)[which])
                route = anchor[which]
                if burning.any():
                    whole = ngram_hashes(words.hashes, window)
                    route = np.where(burning[which], mix(whole[np.minimum(begin, len(whole) - 1)] + np.uint64(1)), route)
                raw = words.data.tobytes()
                bodies += [raw[s:e] for s, e in zip(words.starts[begin].tolist(), words.ends[begin + windows + window - 2].tolist(), strict=True)]
                routes.append(route)
                who.append(a + text[which])
                starts.append(begin - words.first[text[which]])
                counts.append(windows)
            if not bodies:
                continue
            route, owner, start, count = (np.concatenate(x) for x in (routes, who, starts, counts))
            # equal passages of the batch: the earliest goes on, the others are decided; a row that stands twice is one
            order = np.lexsort((start, names[owner], ids[owner], nameless[owner]))
            seen: dict = {}
            goes, decided = [], []
            for k in order.tolist():
                earlier = seen.setdefault(bodies[k], k)
                if earlier == k:
                    goes.append(k)
                elif start[earlier] != start[k] or names[owner[earlier]] != names[owner[k]]:
                    decided.append(k)
            go, done = np.array(goes, np.int64), np.array(decided, np.int64)
            text, begin, end = _merged(owner[done], start[done], start[done] + count[done] + window - 1)
            rows = np.concatenate([owner[go], text])
            yield pa.RecordBatch.from_arrays(
                [
                    _signed(np.concatenate([route[go], mix(names[text].view(np.uint64) + begin.astype(np.uint64))])),
                    pa.array(nameless[rows]),
                    pa.array(ids[rows]),
                    pa.array(names[rows]),
                    pa.array(np.concatenate([start[go], begin]).astype(np.int32)),
                    pa.array(np.concatenate([count[go], end - begin]).astype(np.int32)),
                    pa.array([bodies[k] for k in goes] + [None] * len(text), pa.binary()),
                ],
                names=["route", "nameless", "id", "row", "start", "windows", "body"],
            )

    return run


def _spans(stats: list[int], window: int) -> list[tuple[int, int]]:
    """Maximal runs (first word, words) covered by windows that end where the matching statistic reaches the window."""
    found, open_at = [], None
    for i, n in enumerate([*stats[window - 1 :], 0]):
        if n >= window:
            open_at = i if open_at is None else open_at
        elif open_at is not None:
            found.append((open_at, i - open_at + window - 1))
            open_at = None
    return found


def _shards(window: int):
    """Rows row, nameless, id, start, length (words): spans to remove. Input: sorted by route, nameless, id, row, start."""

    def run(batches):
        automaton, route_before, place_before = SuffixAutomaton(), None, None
        seen: set = set()
        for batch in batches:
            routes, names, starts, counts, bodies = (batch.column(k).to_pylist() for k in (0, 3, 4, 5, 6))
            hits, begins, lengths = [], [], []
            for k, (route, name, start, count, body) in enumerate(zip(routes, names, starts, counts, bodies, strict=True)):
                found: list[tuple[int, int]] = []
                if body is None:
                    found = [(0, count)]
                elif (route, name, start) != place_before:  # else the same row once more
                    place_before = route, name, start
                    if route != route_before:
                        route_before, seen = route, set()
                        if automaton.words > SHARD_WORDS:
                            automaton = SuffixAutomaton()
                    if body in seen:  # stood before as a whole
                        found = [(0, count + window - 1)]
                    else:
                        seen.add(body)
                        found = _spans(automaton.feed(body.split()), window)
                for at, length in found:
                    hits.append(k)
                    begins.append(start + at)
                    lengths.append(length)
            if hits:
                take = pa.array(hits)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in (3, 1, 2)), pa.array(begins, pa.int32()), pa.array(lengths, pa.int32())], names=["row", "nameless", "id", "start", "length"])

    return run


def _spans_of(texts: DataFrame, places: DataFrame, hot: np.ndarray, window: int) -> DataFrame:
    """span_row, spans: structs nameless, id, start, length."""
    by_text = places.filter("row is not null").groupBy(F.col("row").alias("place_row")).agg(F.flatten(F.collect_list("ats")).alias("ats"))
    joined = texts.join(by_text, F.col("row") == F.col("place_row")).select("nameless", "id", "row", "text", "ats")
    passages = map_arrow(joined, _passages(window, hot), "route bigint, nameless boolean, id bigint, row bigint, start int, windows int, body binary")
    routed = passages.repartition("route").sortWithinPartitions("route", "nameless", "id", "row", "start")
    spans = map_arrow(routed, _shards(window), "row bigint, nameless boolean, id bigint, start int, length int")
    return spans.groupBy(F.col("row").alias("span_row")).agg(F.array_sort(F.collect_set(F.struct("nameless", "id", "start", "length"))).alias("spans"))


def _apply(batches):
    """doc_id, n_words, n_removed, kept (words joined by one space)."""
    for batch in batches:
        texts, spans = batch.column(1).cast(pa.binary()), batch.column(2)
        n_words, n_removed, kept = [], [], []
        for text, own in zip(texts, spans, strict=True):
            words = text.as_py().split()
            n_words.append(len(words))
            left, at = [], 0
            for s in own.as_py() or ():
                if s["start"] > at:
                    left += words[at : s["start"]]
                at = max(at, s["start"] + s["length"])
            left += words[at:]
            n_removed.append(len(words) - len(left))
            kept.append(b" ".join(left))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])


def _digested(batches):
    for batch in _apply(batches):
        digests = [hashlib.sha256(t).hexdigest() for t in batch.column(3).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(digests, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def deduplicated(docs: DataFrame, window: int = WINDOW, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept: the text left of each document. digest: kept_sha256 instead; that result is
    materialised. Without it, a table of the places of repeated anchors stays in the shared checkpoint folder."""
    spark = docs.sparkSession
    texts = _identified(docs)
    folder = shared_folder(spark, "anchors")
    stored(_places(texts, window, HOT_ANCHOR), folder)
    places = spark.read.schema("hot bigint, times bigint, row bigint, ats array<int>").parquet(folder)
    spans = _spans_of(texts, places, _hot(places), window)
    joined = texts.join(spans, F.col("row") == F.col("span_row"), "left")
    own = F.filter("spans", lambda s: (s["nameless"] == F.col("nameless")) & (s["id"] == F.col("id")))
    given = joined.select(F.when(~F.col("nameless"), F.col("id")).alias("doc_id"), "text", F.transform(own, lambda s: F.struct(s["start"], s["length"])).alias("spans"))
    if not digest:
        return map_arrow(given, _apply, "doc_id bigint, n_words bigint, n_removed bigint, kept string")
    out = cut(map_arrow(given, _digested, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"))
    remove_folder(spark, folder)
    return out


def _automaton(texts) -> SuffixAutomaton:
    out = SuffixAutomaton()
    for words in texts:
        out.feed(words)
    return out


_built: dict[str, list[SuffixAutomaton]] = {}


def matched(docs: DataFrame, reference: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, most_words: int = MOST_REFERENCE) -> DataFrame:
    """doc_id, start, length: maximal spans of words of documents covered by windows that stand in a text of reference
    (column text). The reference's shards are broadcast, so it may hold most_words words at most; a larger one is an error.
    Passages that lie across two shards of one text are found, since shards overlap by a window."""
    n = reference.agg(F.sum(F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")))).first()[0] or 0
    if n > most_words:
        raise ValueError(f"the reference has {n} words; automata of {most_words} are broadcast at most")
    texts = sorted(t.encode() for t in reference.select(F.col("text").cast("string").alias("text")).dropna().distinct().toArrow()["text"].to_pylist())
    pieces: list[list[list[bytes]]] = [[]]
    filled = 0
    for words in (t.split() for t in texts):
        for at in range(0, max(1, len(words) - window + 1), shard_words):
            pieces[-1].append(words[at : at + shard_words + window - 1])
            filled += len(pieces[-1][-1])
            if filled >= shard_words:
                pieces.append([])
                filled = 0

    name = uuid.uuid4().hex

    def run(batches):
        if name not in _built:
            _built.clear()
            _built[name] = [_automaton(shard) for shard in pieces]
        automata = _built[name]
        for batch in batches:
            ids, starts, lengths = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                words = text.split()
                best = [0] * len(words)
                for automaton in automata:
                    best = list(map(max, best, automaton.statistics(words)))
                for at, length in _spans(best, window):
                    ids.append(doc_id)
                    starts.append(at)
                    lengths.append(length)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64())], names=["doc_id", "start", "length"])

    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return map_arrow(given, run, "doc_id bigint, start bigint, length bigint")
