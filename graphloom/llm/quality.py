"""Quality classifier with hierarchical empirical Bayes.

A logistic classifier over ratios of a text (features.RATIOS) and over its words gives each document's evidence. Words have
log odds of good and bad texts, by hashed bucket, shrunken where few texts hold them; a text's mean and extremes of them are
lexical features. The sample has two folds: the logistic weights are learned from lexical features whose log odds come
from the other fold.

Probabilities are summed by path and host; the spread of hosts around the global mean, and of paths around their hosts, gives
by the method of moments how many documents a prior is worth. A host's posterior shrinks its mean toward the global mean by
that, a path's posterior shrinks toward its host's, and the document's own evidence is left out of its site's before the two are
combined: odds of the evidence over the classifier's prior, times the odds of the path's posterior. Probabilities are summed in
steps of 2**-20, as whole numbers, so scores do not depend on the order of rows.

The classifier is fitted on a bounded sample: at most max_rows labelled rows that are not held out, in the order of a hash of
their id. Rows whose crc32(id as text) mod 3 is 1 are held out: their labels are never read.

Defined results: null text is empty, a very long one is read whole; a null host or path is a site of its own; without labels of
both classes the evidence is even; several labels of one id: bad if any is; unlike texts of one id: the one of the least hash is
learned from; repeated rows count each; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow, meet
from .features import COUNTS, RATIOS, counts
from .wordhash import Words, blocks

MAX_ROWS = 20_000
KEEP = 0.5
#: Buckets of words.
BUCKETS = 1 << 16
#: Sites that are broadcast at most; beyond, only those with the most rows.
MOST_BROADCAST = 200_000
STEPS = 1 << 20


def design(found: dict[str, np.ndarray], lexical: np.ndarray) -> np.ndarray:
    """Columns for the classifier: each ratio and its square root, the length on a log scale, and lexical features."""
    columns = [np.ones(len(found["n_words"]))]
    for top, bottom in RATIOS.values():
        r = found[top] / np.maximum(found[bottom], 1)
        columns += [r, np.sqrt(r)]
    size = np.log1p(found["n_words"])
    return np.concatenate([np.stack([*columns, size / 8, (found["n_words"] < 10).astype(float)], axis=1), lexical], axis=1)


def _buckets(words: Words) -> np.ndarray:
    return (words.hashes & np.uint64(BUCKETS - 1)).astype(np.int64)


def lexical(words: Words, odds: np.ndarray) -> np.ndarray:
    """By text: mean, least and greatest log odds of its words; 0 without words."""
    out = np.zeros((len(words), 3))
    value = odds[_buckets(words)].astype(np.float64)
    full = np.flatnonzero(np.diff(words.first))
    if len(full):
        at = words.first[full]
        out[full, 0] = np.add.reduceat(value, at) / np.diff(words.first)[full]
        out[full, 1], out[full, 2] = np.minimum.reduceat(value, at), np.maximum.reduceat(value, at)
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, rounds: int = 30) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton steps; the intercept is not penalised."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _word_counts(batches):
    """fold, label, bucket, texts: how many texts of a task's rows hold a bucket; under bucket -1 all of them."""
    held = np.zeros((2, 2, BUCKETS), np.int64)
    rows = np.zeros((2, 2), np.int64)
    for batch in batches:
        fold, label = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
        np.add.at(rows, (fold, label), 1)
        for a, _, words in blocks(batch.column(3)):
            owner = np.repeat(np.arange(len(words)), np.diff(words.first))
            pairs = np.unique(owner * BUCKETS + _buckets(words))
            at = a + pairs // BUCKETS
            np.add.at(held, (fold[at], label[at], pairs % BUCKETS), 1)
    fold, label, bucket = np.nonzero(held)
    every = np.indices((2, 2)).reshape(2, -1)
    columns = [np.concatenate([fold, every[0]]), np.concatenate([label, every[1]]), np.concatenate([bucket, np.full(4, -1)]), np.concatenate([held[fold, label, bucket], rows.ravel()])]
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["fold", "label", "bucket", "texts"])


def word_odds(held: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Shrunken log odds of buckets. held: (label, bucket) texts; rows: texts by label."""
    odds = np.log((held[1] + 0.5) / (rows[1] + 1)) - np.log((held[0] + 0.5) / (rows[0] + 1))
    seen = held.sum(axis=0)
    return (odds * seen / (seen + 3)).astype(np.float32)


class Model:
    def __init__(self, odds: np.ndarray, weights: np.ndarray, prior: float):
        self.odds, self.weights, self.prior = odds, weights, prior

    def probabilities(self, texts) -> np.ndarray:
        out = np.zeros(len(texts))
        for a, b, words in blocks(texts):
            out[a:b] = 1 / (1 + np.exp(-np.clip(design(counts(words), lexical(words, self.odds)) @ self.weights, -30, 30)))
        return np.rint(out * STEPS) / STEPS


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model | None:
    """A model of the sample, or None without both classes. What reaches the driver: counts by bucket, and the sample's
    features."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("label_id"), F.col("quality").cast("int").alias("label")).dropna().filter(~held_out(F.col("label_id")))
    known = known.groupBy("label_id").agg(F.min("label").alias("label"))
    draw = F.xxhash64("label_id")
    some = known.filter("label in (0, 1)").withColumn("draw", draw).orderBy("draw", "label_id").limit(max_rows)  # broadcast: max_rows rows at most
    texts = docs.select(F.col("doc_id").cast("bigint").alias("label_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(some), "label_id").groupBy("label_id", "draw", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    sample = cut(rows.select("label_id", (F.col("draw").bitwiseAND(F.lit(1).cast("bigint"))).cast("int").alias("fold"), "label", "text"))
    got = map_arrow(sample, _word_counts, "fold bigint, label bigint, bucket bigint, texts bigint").groupBy("fold", "label", "bucket").agg(F.sum("texts").alias("texts")).toArrow()
    fold, label, bucket, texts_ = (got[c].to_numpy() for c in ("fold", "label", "bucket", "texts"))
    held, size = np.zeros((2, 2, BUCKETS), np.int64), np.zeros((2, 2), np.int64)
    real = bucket >= 0
    held[fold[real], label[real], bucket[real]] = texts_[real]
    size[fold[~real], label[~real]] = texts_[~real]
    if not size.sum(axis=0).all():
        return None
    other = [word_odds(held[1 - k], size[1 - k]) for k in (0, 1)]

    def run(batches):
        for batch in batches:
            folds = batch.column(1).to_numpy(zero_copy_only=False)
            parts = []
            for a, b, words in blocks(batch.column(3)):
                both = [lexical(words, o) for o in other]
                parts.append(design(counts(words), np.where((folds[a:b] == 0)[:, None], both[0], both[1])))
            x = np.concatenate(parts)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], names=["label_id", "label", "x"])

    table = map_arrow(sample, run, "label_id bigint, label int, x array<double>").toArrow().sort_by("label_id")
    y = table["label"].to_numpy().astype(float)
    x = table["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)
    return Model(word_odds(held.sum(axis=0), size.sum(axis=0)), fit_logistic(x, y), float(y.mean()))


def _concentration(spread: Column, mean: Column, noise: Column) -> Column:
    """How many documents a Beta prior with this mean is worth, from the spread of sites beyond what sampling explains."""
    excess = F.greatest(spread - noise, F.lit(1e-9))
    return F.greatest(F.lit(1.0), F.least(F.lit(1e6), mean * (1 - mean) / excess - 1))


def posteriors(evidence: DataFrame) -> DataFrame:
    """evidence: host, path, p. One row a (host, path): sums and counts of path and host, global mean, concentrations.
    Materialised. All sums are of whole numbers or decimals."""
    steps = F.round(F.col("p") * STEPS).cast("bigint")
    square = steps.cast("decimal(38,0)") * steps.cast("decimal(38,0)")
    paths = cut(evidence.groupBy("host", "path").agg(F.sum(steps).alias("steps"), F.sum(square.cast("decimal(38,0)")).alias("squares"), F.count(F.lit(1)).alias("path_rows")))
    hosts = paths.groupBy("host").agg(F.sum("steps").alias("host_steps"), F.sum("path_rows").alias("host_rows"))
    whole = paths.agg(F.sum("steps").alias("s"), F.sum("path_rows").alias("n")).first()
    mean = whole["s"] / STEPS / whole["n"] if whole["n"] else 0.5
    both = paths.join(hosts.withColumnRenamed("host", "host_of"), F.col("host").eqNullSafe(F.col("host_of"))).drop("host_of")
    both = both.withColumn("path_sum", F.col("steps") / STEPS).withColumn("host_sum", F.col("host_steps") / STEPS)
    rate, host_rate = F.col("path_sum") / F.col("path_rows"), F.col("host_sum") / F.col("host_rows")
    inner = F.greatest(F.col("squares").cast("double") / (STEPS * STEPS) / F.col("path_rows") - rate * rate, F.lit(0.0))
    total = F.sum("path_rows")
    average = lambda x: F.sum(x.cast("decimal(38,12)")).cast("double") / total
    moments = both.agg(
        average(F.col("path_rows") * (host_rate - mean) ** 2).alias("host_spread"),
        average(F.col("path_rows") * inner / F.col("host_rows")).alias("host_noise"),
        average(F.col("path_rows") * (rate - host_rate) ** 2).alias("path_spread"),
        average(inner).alias("path_noise"),
    ).select(
        _concentration(F.col("host_spread"), F.lit(mean), F.col("host_noise")).alias("host_worth"),
        _concentration(F.col("path_spread"), F.lit(mean), F.col("path_noise")).alias("path_worth"),
    ).first()
    worth = [float(v) if v is not None else 1.0 for v in moments]
    return cut(
        both.select(
            F.col("host").alias("site_host"),
            F.col("path").alias("site_path"),
            "path_sum",
            "path_rows",
            "host_sum",
            "host_rows",
            F.lit(mean).alias("mean"),
            F.lit(worth[0]).alias("host_worth"),
            F.lit(worth[1]).alias("path_worth"),
        )
    )


def classified(docs: DataFrame, labels: DataFrame, host: Column | str = "source", path: Column | str = "lang", max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, evidence, host_posterior, path_posterior, score, kept."""
    model = fit(docs, labels, max_rows)
    host, path = (F.col(c) if isinstance(c, str) else c for c in (host, path))

    def run(batches):
        for batch in batches:
            p = model.probabilities(batch.column(3)) if model else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(p)], names=["doc_id", "host", "path", "p"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), host.cast("string").alias("host"), path.cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    evidence = cut(map_arrow(rows, run, "doc_id bigint, host string, path string, p double"))
    joined = meet(evidence, posteriors(evidence), F.expr("host <=> site_host AND path <=> site_path"), "path_rows", MOST_BROADCAST)
    # the document's own evidence is left out of its site's
    host_rate = (F.col("host_sum") - F.col("p") + F.col("host_worth") * F.col("mean")) / (F.col("host_rows") - 1 + F.col("host_worth"))
    path_rate = (F.col("path_sum") - F.col("p") + F.col("path_worth") * F.col("host_posterior")) / (F.col("path_rows") - 1 + F.col("path_worth"))
    inside = lambda c: F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), c))
    odds = lambda c: F.log(inside(c) / (1 - inside(c)))
    prior = model.prior if model else 0.5
    weighed = odds(F.col("p")) - odds(F.lit(prior)) + odds(F.col("path_posterior"))
    out = joined.withColumn("host_posterior", host_rate).withColumn("path_posterior", path_rate).withColumn("score", 1 / (1 + F.exp(-weighed)))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("p").alias("evidence"), "host_posterior", "path_posterior", "score", (F.col("score") >= KEEP).alias("kept"))
