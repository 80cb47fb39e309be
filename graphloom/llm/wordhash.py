"""Vectorised word boundaries and 64-bit word hashes over a whole Arrow string array (numpy, no loop over words)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: ASCII white space, controls and punctuation.
PUNCTUATION = np.array([b < 48 or 58 <= b < 65 or 91 <= b < 97 or 123 <= b < 128 for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))
#: Bytes hashed at a time; numpy temporaries take about 40 times as much.
BLOCK = 1 << 20


def _power_tables(n: int):
    global _powers
    if len(_powers[0]) < n:
        n = max(n, BLOCK + (1 << 16))
        grow = lambda b: np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, b, np.uint64), dtype=np.uint64)])
        _powers = (grow(_BASE), grow(_INVERSE))
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words of a run of texts.

    data: bytes of the texts; offsets: byte offset of each text and the end; starts, ends: byte range of each
    word; first: index of each text's first word, and the number of words at the end; hashes: one per word.
    """

    def __init__(self, data, offsets, lower: bool = False, hashed: bool = True, apart=None, prefixes: tuple = ()):
        """apart: 256 booleans, bytes that separate words (default: ASCII white space). prefixes: for each length in
        bytes, self.prefixes has hashes of the words' first bytes."""
        self.data, self.offsets = data, offsets
        n = len(data)
        word = ~(_SPACE if apart is None else apart)[data]
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0], before[1:] = False, word[:-1]
            after[-1], after[:-1] = False, word[1:]
            inner = offsets[(offsets > 0) & (offsets < n)]
            before[inner] = False
            after[inner - 1] = False
        self.starts = np.flatnonzero(word & ~before)
        self.ends = np.flatnonzero(word & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.prefixes = [np.empty(len(self.starts), np.uint64) for _ in prefixes]
        self.hashes = self._hash(lower, prefixes) if hashed else None

    def _hash(self, lower: bool, prefixes: tuple) -> np.ndarray:
        out = np.empty(len(self.starts), np.uint64)
        i = 0
        while i < len(self.starts):
            # blocks that end between words; a longer word stands alone
            j = int(np.searchsorted(self.ends, self.starts[i] + BLOCK, side="right"))
            j = max(j, i + 1)
            a, b = int(self.starts[i]), int(self.ends[j - 1])
            power, inverse = _power_tables(b - a + 1)
            data = self.data[a:b]
            if lower:
                data = _LOWER[data]
            sums = np.zeros(b - a + 1, np.uint64)
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: b - a], out=sums[1:])
            s, e = self.starts[i:j] - a, self.ends[i:j] - a
            out[i:j] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))
            for k, length in enumerate(prefixes):
                cut = np.minimum(s + length, e)
                self.prefixes[k][i:j] = mix((sums[cut] - sums[s]) * inverse[s] + (cut - s + 64).astype(np.uint64))
            i = j
        return out

    def __len__(self) -> int:
        return len(self.offsets) - 1


def buffers(texts) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and 64-bit offsets of an Arrow string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def blocks(texts, limit: int = 4 * BLOCK, **options):
    """(row start, row stop, Words) over runs of rows of about limit bytes; a longer row stands alone."""
    from .common import slices

    data, offsets = buffers(texts)
    for a, b in slices(np.diff(offsets).tolist(), limit):
        yield a, b, Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], **options)


def ngram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive words; runs may cross texts, the caller masks those."""
    m = max(0, len(hashes) - n + 1)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = out * _BASE + hashes[k : k + m]
    return mix(out)
