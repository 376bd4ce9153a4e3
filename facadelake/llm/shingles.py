"""Word and shingle hashes of many texts at once, with numpy.

A word is ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case. Its hash is a polynomial over its bytes, taken
from one running sum over all bytes of the piece, then mixed. A shingle is k consecutive words of one
text; a text with fewer words, but at least one, has its whole word sequence as its only shingle.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint64)
LOWER[65:91] += np.uint64(32)
_BASE = 0x9E3779B97F4A7C55
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * _STEP
    x = x ^ (x >> np.uint64(32))
    x = x * _STEP
    return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=4)
def _powers(base: int, bits: int) -> np.ndarray:
    out = np.full(1 << bits, np.uint64(base), np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SEPARATOR) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every word; no word crosses a text's end."""
    inside = ~separator[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    bits = max(12, int(len(data)).bit_length())
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((LOWER[data] + np.uint64(1)) * _powers(_BASE, bits)[: len(data)], out=sums[1:])
    raw = (sums[ends] - sums[begins]) * _powers(_INVERSE, bits)[begins]
    return mix(raw + (ends - begins).astype(np.uint64) * np.uint64(_BASE))


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles in text order, and where each text's begin: ``len(offsets)`` bounds."""
    begins, ends = word_spans(data, offsets)
    words = word_hashes(data, begins, ends)
    at = np.searchsorted(begins, offsets)  # first word of each text
    n_words = np.diff(at)
    counts = np.where(n_words >= k, n_words - k + 1, np.minimum(n_words, 1))
    bounds = np.concatenate([[0], np.cumsum(counts)])
    owner = np.repeat(np.arange(len(counts)), counts)
    start = at[owner] + np.arange(bounds[-1]) - bounds[owner]
    length = np.minimum(n_words[owner], k)
    out = length.astype(np.uint64)
    for j in range(k):
        here = j < length
        if here.all():
            out = mix(out * np.uint64(_BASE) + words[start + j])
        else:
            out[here] = mix(out[here] * np.uint64(_BASE) + words[start[here] + j])
    return out, bounds


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    hashes, bounds = shingle_hashes(data, offsets, k)
    return [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
