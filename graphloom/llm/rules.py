"""Quality rules with risk-controlled thresholds.

Each rule rejects texts whose ratio (see features.RATIOS) exceeds a cutoff. The cutoff of a rule in a stratum is chosen on
labelled rows of good quality there: going from the loosest to the strictest cutoff of a grid, the exact (Clopper-Pearson)
upper bound of the share of good rows that it rejects must stay within risk; the first that fails ends the walk, so the
cutoffs of one rule need no correction among themselves (fixed sequence), while rules and strata share the error
probability evenly (Bonferroni). With probability 1 - error, every rule rejects at most that share of good texts in every
stratum. Where labels are too few to show this, the rule rejects nothing.

Base rules stand before: under 50 words, or over half of the words in repeated runs of three.

Defined results: null text has no words and fails the base rules; a null stratum is one; several labels of one id: bad if
any is; very long texts are measured whole; repeated rows are judged alike; ratios equal to a cutoff pass; other columns are
not read; without labels only the base rules hold; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow
from .features import COUNTS, RATIOS, measured, ratio

GRID = (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02)
RISK, ERROR = 0.01, 0.05
FEWEST_WORDS = 50


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of n trials, exact sum in logarithms."""
    if p <= 0 or k >= n:
        return 1.0
    if p >= 1:
        return 0.0
    log_p, log_q = math.log(p), math.log1p(-p)
    terms = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * log_p + (n - i) * log_q for i in range(k + 1)]
    top = max(terms)
    return min(1.0, math.exp(top) * math.fsum(math.exp(t - top) for t in terms))


def within(k: int, n: int, risk: float, error: float) -> bool:
    """Whether the exact upper bound, at confidence 1 - error, of a rate seen k times in n is at most risk."""
    return n > 0 and k / n <= risk and binomial_tail(k, n, risk) <= error


def base_failed() -> Column:
    return (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def thresholds(rows: DataFrame, labels: DataFrame, stratum: str, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """stratum_of, one column a rule: its cutoff, or null where none is safe. rows: measured, with doc_id and stratum."""
    good = labels.select(F.col("doc_id").cast("bigint").alias("label_id"), F.col("quality").cast("int").alias("quality")).dropna().groupBy("label_id").agg(F.min("quality").alias("quality")).filter("quality = 1").select("label_id")
    over = [F.count_if(ratio(name) > F.lit(c)).alias(f"{name}_{k}") for name in RATIOS for k, c in enumerate(GRID)]
    table = rows.filter(~base_failed()).join(good, F.col("doc_id").cast("bigint") == F.col("label_id"))
    table = cut(table.groupBy(F.col(stratum).alias("stratum_of")).agg(F.count(F.lit(1)).alias("good"), *over))
    share = error / (len(RATIOS) * max(1, table.count()))

    def run(batches):
        for batch in batches:
            seen = batch.to_pydict()
            found: dict = {"stratum_of": batch.column(0)}
            for name in RATIOS:
                found[name] = []
                for r in range(batch.num_rows):
                    best = None
                    for k, c in enumerate(GRID):
                        if not within(seen[f"{name}_{k}"][r], seen["good"][r], risk, share):
                            break
                        best = c
                    found[name].append(best)
                found[name] = pa.array(found[name], pa.float64())
            yield pa.RecordBatch.from_pydict(found)

    kind = table.schema["stratum_of"].dataType.simpleString()
    return map_arrow(table, run, f"stratum_of {kind}, " + ", ".join(f"{n} double" for n in RATIOS))


def judged(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, error: float = ERROR) -> DataFrame:
    """doc_id, counts, base_failed, kept."""
    rows = cut(measured(docs, "doc_id", stratum))
    cuts = thresholds(rows, labels, stratum, risk, error)
    joined = rows.join(cuts.withColumn("known", F.lit(True)), F.col(stratum).eqNullSafe(F.col("stratum_of")), "left")
    fails = [F.coalesce(ratio(name) > F.col(name), F.lit(False)) for name in RATIOS]
    bad = base_failed()
    for f in fails:
        bad = bad | f
    return joined.select("doc_id", *COUNTS, base_failed().alias("base_failed"), (~bad).alias("kept"))
