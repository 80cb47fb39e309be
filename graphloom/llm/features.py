"""Counts that quality rules and the quality classifier read off whole texts, for runs of texts at a time (numpy)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow
from .wordhash import Words, blocks, mix, ngram_hashes

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bare", "n_upper", "n_letters", "n_marks")
#: Ratios of counts, each 0 to 1; high values speak against a text.
RATIOS = {
    "symbols": ("n_symbols", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "bare_words": ("n_bare", "n_words"),
    "upper_case": ("n_upper", "n_letters"),
    "marks": ("n_marks", "n_words"),
}

_BYTE = np.arange(256)
_SYMBOL = np.isin(_BYTE, list(b"#*$%&|<>"))
_LEAD = (_BYTE & 0xC0) != 0x80
_UPPER = (_BYTE >= 65) & (_BYTE <= 90)
_LETTER = _UPPER | ((_BYTE >= 97) & (_BYTE <= 122)) | (_BYTE >= 0xC0)
_PLAIN = _LETTER | ((_BYTE >= 48) & (_BYTE <= 57)) | (_BYTE >= 128)
_MARK = _BYTE == 33
_SPACE = np.isin(_BYTE, [9, 10, 11, 12, 13, 32])


def _per_text(hits: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(hits)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and how many of them equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines), len(lines) - len(set(lines))


def counts(words: Words) -> dict[str, np.ndarray]:
    data, offsets, first = words.data, words.offsets, words.first
    n = len(words)
    inside = ~_SPACE[data]
    raw = data.tobytes()
    lines = np.array([_lines(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], np.int64).reshape(n, 2)
    text = np.repeat(np.arange(n), np.diff(first))
    covered = np.zeros(len(text), bool)
    m = len(text) - 2
    if m > 0:
        at = np.flatnonzero(text[:m] == text[2:])
        key = mix(ngram_hashes(words.hashes, 3)[at] + text[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, which, times = np.unique(key, return_inverse=True, return_counts=True)
        again = at[times[which] > 1]
        for k in range(3):
            covered[again + k] = True
    plain = np.concatenate([[0], np.cumsum(_PLAIN[data])])
    bare = plain[words.ends] == plain[words.starts]
    return {
        "n_words": np.diff(first),
        "word_chars": _per_text(inside & _LEAD[data], offsets),
        "n_symbols": _per_text(_SYMBOL[data], offsets),
        "n_dup_lines": lines[:, 1],
        "n_repeat_words": _per_text(covered, first),
        "n_lines": lines[:, 0],
        "n_bare": _per_text(bare, first),
        "n_upper": _per_text(_UPPER[data], offsets),
        "n_letters": _per_text(_LETTER[data], offsets),
        "n_marks": _per_text(_MARK[data], offsets),
    }


def table_of(texts) -> dict[str, np.ndarray]:
    parts = [counts(w) for _, _, w in blocks(texts)]
    return {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in COUNTS}


def measured(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns of docs (as they are), and COUNTS."""

    def run(batches):
        for batch in batches:
            found = table_of(batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(found[k].astype(np.int64)) for k in COUNTS]], names=[*columns, *COUNTS])

    kept = docs.select(*[F.col(c) for c in columns], F.col("text").cast("string").alias("_text"))
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]], *[f"{k} bigint" for k in COUNTS]])
    return map_arrow(kept, run, schema)


def ratio(name: str):
    top, bottom = RATIOS[name]
    return F.col(top) / F.greatest(F.col(bottom), F.lit(1))
