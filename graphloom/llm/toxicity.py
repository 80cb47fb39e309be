"""Toxicity by a convolutional text classifier, trained in numpy: hashed word embeddings, several filter widths, max
pooling, and thresholds by language.

A word's vector is the sum of embeddings of the hashed word and of its hashed leading bytes. Filters of widths 1 to
3 slide over whole texts; the maximum of each filter over a text feeds a logistic unit. Embeddings start from
smoothed log odds of their bucket in the training texts. Thresholds are fitted on all labelled rows kept out of
training, weighted to the classes' sizes among all labelled rows, by the language that a few function words in the text show (never by a column), and scores are mapped so
that each language's threshold lies at 0.7.

Training reads a bounded sample: at most max_rows labelled rows of each class, in the order of a hash of their id,
and max_bytes of text; texts that do not fit are skipped. It runs in one executor task; the driver sees the model's bytes
and counts. Everything else covers all rows; thresholds are read off counts of labelled rows by language, step of evidence
and label.

Defined results: null, empty and wordless texts get the score of no evidence; very long texts are read whole, in runs of
words; without labels of both classes all scores are 0; several labels of one id: toxic if any is; repeated rows are scored
alike, and of unlike texts of one id one is learned from; other columns pass through accepted() and are not read by score();
an empty table gives an empty result.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow, ship, small_batches
from .wordhash import PUNCTUATION, Words, blocks

CUT = 0.7
WIDTHS = (1, 2, 3)
FILTERS = 12
SIZE = 8
#: Buckets of words, and of leading bytes by their number.
BUCKETS = (1 << 17, 1 << 16, 1 << 16, 1 << 16)
PREFIXES = (4, 6, 8)
MAX_ROWS, MAX_BYTES = 4000, 32 << 20
EPOCHS, BATCH = 10, 16
#: Steps of evidence (log odds) a unit, in which labelled rows are counted for thresholds.
BINS = 64
#: Labels that are broadcast at most.
MOST_BROADCAST = 500_000

# Function words that show a language.
FUNCTION_WORDS = {
    "en": ("the", "of", "and", "to", "is", "that", "with", "this", "was", "for"),
    "de": ("der", "die", "und", "das", "mit", "nicht", "ein", "den", "von", "ist", "auf"),
    "fr": ("le", "les", "et", "des", "du", "un", "une", "est", "pour", "avec", "par", "pas"),
    "es": ("el", "los", "y", "del", "por", "con", "para", "una", "su", "las"),
}


def _hash_of(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(Words(data, np.array([0, len(data)])).hashes[0])


class Features:
    """Bucket numbers of the words of some texts, by channel; first: index of each text's first word, and the end."""

    def __init__(self, words: Words):
        self.first = words.first
        self.channels = [(h & np.uint64(n - 1)).astype(np.uint16 if n <= 1 << 16 else np.int32) for h, n in zip([words.hashes, *words.prefixes], BUCKETS, strict=True)]
        self.hashes = words.hashes


def features(texts):
    """(row start, row stop, Features) of runs of texts."""
    return ((a, b, Features(w)) for a, b, w in blocks(texts, limit=1 << 20, lower=True, apart=PUNCTUATION, prefixes=PREFIXES))


def languages(f: Features) -> np.ndarray:
    """Number of the language whose function words are the most frequent, else the number of languages."""
    n = len(f.first) - 1
    counts = np.zeros((n, len(FUNCTION_WORDS)), np.int64)
    for k, words in enumerate(FUNCTION_WORDS.values()):
        hit = np.isin(f.hashes, np.array([_hash_of(w) for w in words], np.uint64))
        sums = np.concatenate([[0], np.cumsum(hit)])
        counts[:, k] = sums[f.first[1:]] - sums[f.first[:-1]]
    return np.where(counts.max(axis=1) > 0, counts.argmax(axis=1), len(FUNCTION_WORDS))


class Model:
    NAMES = ("bias", "weights", "shift", "cuts", "learned")

    def __init__(self, embeddings, filters, bias, weights, shift, cuts, learned=()):
        #: filters: by width, array (width, SIZE, FILTERS); cuts: raw probability by language that maps to CUT
        self.embeddings, self.filters, self.bias, self.weights, self.shift, self.cuts, self.learned = embeddings, filters, bias, weights, shift, cuts, learned

    def packed(self) -> bytes:
        """The model as bytes; the embeddings in half precision."""
        out = io.BytesIO()
        lists = {f"e{k}": e.astype(np.float16) for k, e in enumerate(self.embeddings)} | {f"f{k}": w for k, w in enumerate(self.filters)}
        np.savez_compressed(out, **lists, **{n: np.asarray(getattr(self, n)) for n in self.NAMES})
        return out.getvalue()

    @staticmethod
    def unpacked(raw: bytes) -> Model:
        with np.load(io.BytesIO(raw)) as z:
            own = {n: z[n] for n in Model.NAMES}
            return Model([z[f"e{k}"] for k in range(len(BUCKETS))], [z[f"f{k}"] for k in range(len(WIDTHS))], **own)

    def vectors(self, f: Features, a: int, b: int) -> np.ndarray:
        x = self.embeddings[0][f.channels[0][a:b]].astype(np.float32)
        for e, c in zip(self.embeddings[1:], f.channels[1:], strict=True):
            x += e[c[a:b]]
        return x

    def responses(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Filter values at each word, all widths side by side; a window ends with its text."""
        n = len(x)
        flat = np.concatenate([w.transpose(1, 0, 2).reshape(SIZE, -1) for w in self.filters], axis=1)
        z = x @ flat
        out = np.empty((n, len(WIDTHS) * FILTERS), np.float32)
        last = np.zeros(n, bool)
        ends = first[1:][first[1:] > first[:-1]]
        last[ends - 1] = True
        at = 0
        for k, width in enumerate(WIDTHS):
            here = z[:, at : at + FILTERS].copy()
            inside = np.ones(n, bool)
            for d in range(1, width):
                inside[: n - d + 1] &= ~last[d - 1 :]
                inside[max(0, n - d) :] = False
                here[: n - d] += z[d:, at + d * FILTERS : at + (d + 1) * FILTERS] * inside[: n - d, None]
            out[:, k * FILTERS : (k + 1) * FILTERS] = here
            at += width * FILTERS
        return out

    def pooled(self, f: Features) -> np.ndarray:
        """Maximum of each filter over each text, 0 for texts without words."""
        n = len(f.first) - 1
        out = np.zeros((n, len(WIDTHS) * FILTERS), np.float32)
        full = np.flatnonzero(f.first[1:] > f.first[:-1])
        step, i = 1 << 16, 0
        while i < len(full):  # runs of texts; a long text alone, in runs of words
            j = i + 1
            while j < len(full) and f.first[full[j] + 1] - f.first[full[i]] <= step:
                j += 1
            a, b = f.first[full[i]], f.first[full[j - 1] + 1]
            if j == i + 1 and b - a > step:
                for c in range(a, b, step):
                    d = min(b, c + step + max(WIDTHS) - 1)
                    r = self.responses(self.vectors(f, c, d), np.array([0, d - c]))
                    whole = r if d == b else r[:step]  # windows that a run's end cuts belong to the next run
                    out[full[i]] = np.maximum(out[full[i]], whole.max(axis=0) + self.bias)
            else:
                starts = f.first[full[i:j]] - a
                r = self.responses(self.vectors(f, a, b), np.append(starts, b - a))
                out[full[i:j]] = np.maximum(0, np.maximum.reduceat(r, starts, axis=0) + self.bias)
            i = j
        return out

    def evidence(self, f: Features) -> np.ndarray:
        return np.clip(self.pooled(f).astype(np.float64) @ self.weights + self.shift, -30, 30)

    def probabilities(self, f: Features) -> np.ndarray:
        return 1 / (1 + np.exp(-self.evidence(f)))

    def scores(self, texts) -> np.ndarray:
        out = np.zeros(len(texts))
        for a, b, f in features(texts):
            out[a:b] = self.mapped(self.probabilities(f), languages(f))
        return out

    def mapped(self, p: np.ndarray, language: np.ndarray) -> np.ndarray:
        cut = self.cuts[language]
        return np.where(p >= cut, CUT + (1 - CUT) * (p - cut) / (1 - cut), np.minimum(CUT * p / cut, np.nextafter(CUT, 0)))


class Sample:
    """Bucket numbers of the training texts, and what is known of each text. Hashed a block at a time."""

    def __init__(self, texts):
        channels, sizes, languages_ = [[] for _ in BUCKETS], [], []
        for _, _, f in features(texts):
            for kept, c in zip(channels, f.channels, strict=True):
                kept.append(c)
            sizes.append(np.diff(f.first))
            languages_.append(languages(f))
        self.channels = [np.concatenate(c) for c in channels]
        self.first = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        self.languages = np.concatenate(languages_)

    def part(self, rows: np.ndarray) -> Features:
        """Features of some of the texts, in the order given."""
        out = object.__new__(Features)
        sizes = np.diff(self.first)[rows]
        out.first = np.concatenate([[0], np.cumsum(sizes)])
        index = np.arange(out.first[-1]) + np.repeat(self.first[rows] - out.first[:-1], sizes)
        out.channels = [c[index] for c in self.channels]
        return out


def _log_odds(sample: Sample, rows: np.ndarray, toxic: np.ndarray) -> list[np.ndarray]:
    """Shrunken log odds of each bucket, by the texts among rows that hold it."""
    used = np.zeros(len(toxic), bool)
    used[rows] = True
    bad = toxic[rows].sum()
    out = []
    for c, n in zip(sample.channels, BUCKETS, strict=True):
        ones, all_ = np.zeros(n), np.zeros(n)
        for r in np.flatnonzero(used):
            held = np.unique(c[sample.first[r] : sample.first[r + 1]])
            all_[held] += 1
            if toxic[r]:
                ones[held] += 1
        odds = np.log((ones + 0.5) / (bad + 1)) - np.log((all_ - ones + 0.5) / (len(rows) - bad + 1))
        out.append((odds * all_ / (all_ + 3)).astype(np.float32))
    return out


def train(texts, toxic: np.ndarray, seed: int = 11) -> Model | None:
    """A model from an Arrow array of texts (or a Sample) and their 0/1 labels; None without both classes."""
    if toxic.sum() in (0, len(toxic)):
        return None
    sample = texts if isinstance(texts, Sample) else Sample(texts)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(toxic))
    aside = np.zeros(len(toxic), bool)
    for label in (0, 1):
        own = order[toxic[order] == label]
        aside[own[: len(own) // 4]] = True
    fit_rows, held = np.flatnonzero(~aside), np.flatnonzero(aside)
    embeddings = [rng.normal(0, 0.02, (n, SIZE)).astype(np.float32) for n in BUCKETS]
    for e, odds in zip(embeddings, _log_odds(sample, fit_rows, toxic), strict=True):
        e[:, 0] = 0.3 * odds
    filters = [rng.normal(0, 0.2, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
    for w in filters:
        w[:, 0, :] = np.abs(w[:, 0, :]) + 0.5
    width = len(WIDTHS) * FILTERS
    model = Model(embeddings, filters, np.zeros(width, np.float32), rng.normal(0, 0.1, width) + 0.05, -1.0, None)
    _descend(model, sample, fit_rows, toxic, rng)
    for e, c in zip(model.embeddings, sample.channels, strict=True):
        e[np.bincount(c, minlength=len(e)) == 0] = 0  # what no text holds says nothing, and takes no room
    probabilities = np.concatenate([model.probabilities(sample.part(held[k : k + 256])) for k in range(0, len(held), 256)] or [np.zeros(0)])
    model.cuts = _cuts(probabilities, toxic[held], sample.languages[held])
    model.learned = fit_rows
    return Model.unpacked(model.packed())


def _descend(model: Model, sample: Sample, fit_rows: np.ndarray, toxic: np.ndarray, rng, rate: float = 0.05) -> None:
    """Adagrad over minibatches of some of the texts; gradients flow through the maxima only."""
    share = toxic[fit_rows].mean()
    weight = np.where(toxic == 1, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6))
    seen = [np.full(e.shape, 1e-3, np.float32) for e in model.embeddings]
    seen_filters = [np.full(w.shape, 1e-2, np.float32) for w in model.filters]
    seen_bias, seen_weights, seen_shift = np.full(model.bias.shape, 1e-2, np.float32), np.full(model.weights.shape, 1e-2), 1e-2
    sizes = np.diff(sample.first)
    for _ in range(EPOCHS):
        order = rng.permutation(fit_rows)
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            rows = rows[sizes[rows] > 0]
            if not len(rows):
                continue
            part = sample.part(rows)
            starts = part.first
            x = model.vectors(part, 0, int(starts[-1]))
            r = model.responses(x, starts)
            peak = np.stack([starts[k] + r[starts[k] : starts[k + 1]].argmax(axis=0) for k in range(len(rows))])
            value = np.take_along_axis(r, peak, axis=0) + model.bias
            active = value > 0
            h = np.where(active, value, 0).astype(np.float64)
            p = 1 / (1 + np.exp(-np.clip(h @ model.weights + model.shift, -30, 30)))
            error = (p - toxic[rows]) * weight[rows] / len(rows)
            back = (error[:, None] * model.weights * active).astype(np.float32)
            grad_weights, grad_shift = h.T @ error + 1e-4 * model.weights, error.sum()
            grad_x = np.zeros_like(x)
            ends = starts[1:, None]
            for k, width in enumerate(WIDTHS):
                own = slice(k * FILTERS, (k + 1) * FILTERS)
                grad = np.zeros_like(model.filters[k])
                for d in range(width):
                    to = peak[:, own] + d
                    ok = to < ends
                    g = back[:, own] * ok
                    to = np.minimum(to, len(x) - 1)
                    grad[d] = np.einsum("bf,bfs->sf", g, x[to])
                    np.add.at(grad_x, to.ravel(), (g[:, :, None] * model.filters[k][d].T[None]).reshape(-1, SIZE))
                seen_filters[k] += grad**2
                model.filters[k] -= rate * grad / np.sqrt(seen_filters[k])
            touched = np.flatnonzero(np.abs(grad_x).sum(axis=1) > 0)
            for e, s, c in zip(model.embeddings, seen, part.channels, strict=True):
                bucket, which = np.unique(c[touched], return_inverse=True)
                g = np.zeros((len(bucket), SIZE), np.float32)
                np.add.at(g, which, grad_x[touched])
                s[bucket] += g**2
                e[bucket] -= rate * g / np.sqrt(s[bucket])
            grad_bias = back.sum(axis=0)
            seen_bias += grad_bias**2
            model.bias -= rate * grad_bias / np.sqrt(seen_bias)
            seen_weights += grad_weights**2
            model.weights -= rate * grad_weights / np.sqrt(seen_weights)
            seen_shift += grad_shift**2
            model.shift -= rate * grad_shift / np.sqrt(seen_shift)


def _best_cut(p: np.ndarray, toxic: np.ndarray, weight: np.ndarray | None = None) -> float:
    """Probability between two rows that gives the best F1; the middle of the gap."""
    weight = np.ones(len(p)) if weight is None else weight
    order = np.argsort(-p, kind="stable")
    p, hits, marked = p[order], np.cumsum((toxic * weight)[order]), np.cumsum(weight[order])
    f1 = 2 * hits / (marked + hits[-1])
    f1[np.append(p[1:] == p[:-1], False)] = -1  # no cut between equal rows
    best = int(f1.argmax())
    below = p[best + 1] if best + 1 < len(p) else 0.0
    return float(np.clip((p[best] + below) / 2, 1e-4, 1 - 1e-4))


def _cuts(p: np.ndarray, toxic: np.ndarray, language: np.ndarray, rows: np.ndarray | None = None, weight: np.ndarray | None = None, least: int = 8) -> np.ndarray:
    """A cut by language; languages with few labelled rows of either class take the common one. An entry stands for
    rows rows that weigh weight together."""
    rows = np.ones(len(p)) if rows is None else rows
    weight = rows if weight is None else weight
    common = _best_cut(p, toxic, weight) if (toxic * rows).any() else 0.5
    cuts = np.full(len(FUNCTION_WORDS) + 1, common)
    for k in range(len(FUNCTION_WORDS)):
        own = language == k
        if (toxic * rows)[own].sum() >= least and ((1 - toxic) * rows)[own].sum() >= least:
            cuts[k] = _best_cut(p[own], toxic[own], weight[own])
    return cuts


def _counts(raw: bytes, rows: DataFrame, known: DataFrame, learned: DataFrame) -> pa.Table:
    """language, bin, label, learned, count: over all labelled rows. bin: evidence in steps of 1 / BINS."""
    few = known.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    labelled = rows.join(F.broadcast(known) if few else known, "label_id").join(F.broadcast(learned), F.col("label_id") == F.col("learned_id"), "left")

    def run(batches):
        model = Model.unpacked(raw)
        for batch in batches:
            bins, language = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for a, b, f in features(batch.column(2)):
                bins[a:b], language[a:b] = np.rint(model.evidence(f) * BINS), languages(f)
            yield pa.RecordBatch.from_arrays([pa.array(language), pa.array(bins), batch.column(0), batch.column(1)], names=["language", "bin", "label", "learned"])

    given = labelled.select("label", F.col("learned_id").isNotNull().alias("learned"), "words")
    binned = map_arrow(given, run, "language bigint, bin bigint, label int, learned boolean")
    with small_batches(rows.sparkSession):
        return binned.groupBy("language", "bin", "label", "learned").count().orderBy("language", "bin", "label", "learned").toArrow()


def _fitted_cuts(counts: pa.Table) -> np.ndarray | None:
    """Cuts from the rows that were not learned from; rows of a language and class weigh as many as all of it."""
    language, bins, label, learned, count = (counts[c].to_numpy() for c in ("language", "bin", "label", "learned", "count"))
    weight = np.zeros(len(count))
    free = ~learned.astype(bool)
    for k in np.unique(language):
        for y in (0, 1):
            own = (language == k) & (label == y)
            if (own & free).any():
                weight[own & free] = count[own & free] * (count[own].sum() / count[own & free].sum())
    if not (free & (label == 1)).any() or not (free & (label == 0)).any():
        return None
    return _cuts(1 / (1 + np.exp(-bins[free] / BINS)), label[free].astype(np.int64), language[free], count[free], weight[free])


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _chosen(rows: list[tuple], max_bytes: int) -> list[int]:
    """Ids to learn from. rows: (draw, id, label, bytes). In the order of draw; a text that does not fit is skipped. The
    class of fewer bytes may take half of them, the other what is left."""
    classes = sorted((sorted(r for r in rows if r[2] == k) for k in (0, 1)), key=lambda c: sum(r[3] for r in c))
    chosen, left = [], max_bytes
    for own, room in zip(classes, (max_bytes // 2, max_bytes), strict=True):
        room, before = min(room, left), len(chosen)
        for _, ident, _, size in own:
            if size <= room:
                chosen.append(ident)
                room, left = room - size, left - size
        if own and len(chosen) == before and all(classes):
            raise ValueError(f"no text of label {own[0][2]} fits in max_bytes={max_bytes}")
    return chosen


def _trained(batches):
    """One row model, learned (ids): from all rows label_id, label, words that reach this task."""
    got = pa.Table.from_batches(list(batches), pa.schema([("label_id", pa.int64()), ("label", pa.int32()), ("words", pa.string())])).sort_by("label_id")
    names, toxic = got["label_id"].to_numpy(), got["label"].to_numpy().astype(np.int64)
    sample = Sample(got["words"]) if got.num_rows else None
    del got, batches  # the texts are not needed any more
    model = train(sample, toxic) if sample else None
    ids = [] if model is None else names[model.learned].tolist()
    raw = None if model is None else model.packed()
    yield pa.RecordBatch.from_arrays([pa.array([raw], pa.binary()), pa.array([ids], pa.list_(pa.int64()))], names=["model", "learned"])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> tuple[bytes, np.ndarray] | None:
    """A packed model and its cuts. Trains in one executor task, on a bounded sample of the labelled rows that are not held
    out; thresholds are fitted on all others. Of texts that share an id the one of the least hash is learned from."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("label_id"), F.col("toxic").cast("int").alias("label")).dropna().filter(~held_out(F.col("label_id")))
    known = cut(known.groupBy("label_id").agg(F.max("label").alias("label")))
    draw = F.xxhash64("label_id")
    picks = [known.filter(F.col("label") == k).withColumn("draw", draw).orderBy("draw", "label_id").limit(max_rows) for k in (0, 1)]
    ids = F.broadcast(cut(picks[0].union(picks[1]).coalesce(1)))  # 2 * max_rows rows at most
    texts = docs.select(F.col("doc_id").cast("bigint").alias("label_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("words"))
    rows = texts.join(ids, "label_id")
    measured = rows.groupBy("label_id").agg(F.first("draw").alias("draw"), F.first("label").alias("label"), F.max(F.octet_length("words")).alias("bytes")).collect()
    chosen = _chosen([(r["draw"], r["label_id"], r["label"], r["bytes"]) for r in measured], max_bytes)
    if not chosen:
        return None
    spark = docs.sparkSession
    some = spark.createDataFrame([(x,) for x in chosen], "chosen bigint")
    sample = rows.join(F.broadcast(some), F.col("label_id") == F.col("chosen"), "left_semi").groupBy("label_id", "label").agg(F.min_by("words", F.struct(F.xxhash64("words"), "words")).alias("words"))
    with small_batches(spark):
        made = map_arrow(sample.repartition(1), _trained, "model binary, learned array<bigint>").first()
    if made is None or made["model"] is None:
        return None
    raw = bytes(made["model"])
    learned = spark.createDataFrame([(x,) for x in made["learned"]], "learned_id bigint")
    cuts = _fitted_cuts(_counts(raw, texts, known, learned))
    return raw, Model.unpacked(raw).cuts if cuts is None else cuts


def _model(fitted: tuple[bytes, np.ndarray] | None) -> Model | None:
    if fitted is None:
        return None
    model = Model.unpacked(fitted[0])
    model.cuts = fitted[1]
    return model


def score(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    fitted = fit(docs, labels, **bounds)

    def run(batches):
        model = _model(fitted)
        for batch in batches:
            found = model.scores(batch.column(2)) if model else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found), pa.array((found >= CUT).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, run, "doc_id bigint, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """docs without those predicted toxic."""
    fitted = fit(docs, labels, **bounds)
    if fitted is None:
        return docs
    ship(docs.sparkSession)

    @F.arrow_udf("double")
    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = _model(fitted)
        for batch in texts:
            yield pa.array(model.scores(batch))

    return docs.filter(scored(docs["text"].cast("string")) < CUT)  # only texts go to Python, and scores come back
