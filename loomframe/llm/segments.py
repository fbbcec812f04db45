"""Windows of symbol sequences, grouped by their minimizers.

A window's minimizer is the k-gram in it of the smallest hash (the leftmost of
equal ones), so equal windows have equal minimizers at equal places. A segment
is a maximal run of windows with the same minimizer occurrence: at most
window - k + 1 windows. Windows that occur twice always meet under one key, the
minimizer's hash; all else about them is decided there. Hashes here choose keys
only: whether content is equal is told by keyed digests of its bytes.
"""

from __future__ import annotations

from functools import lru_cache
from hashlib import blake2b

import numpy as np

PIECE = 1 << 19  # symbols worked on at once; longer texts are cut with an overlap of a window
M64 = (1 << 64) - 1
#: An odd base.
BASE = 0x9E3779B97F4A7C15
POS = np.uint64((1 << 24) - 1)


def powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


UP, DOWN = powers(BASE, PIECE + 1), powers(pow(BASE, -1, 1 << 64), PIECE + 1)


def mix(h: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


def sums(symbols: np.ndarray) -> np.ndarray:
    out = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * UP[: len(symbols)], out=out[1:])
    return out


def range_hash(c: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes of symbol ranges from the sums `c`, alike wherever a range lies."""
    return mix((c[ends] - c[starts]) * DOWN[starts] + (ends - starts).astype(np.uint64))


class WordDigests(dict):
    """Keyed 64-bit digests of words, by word; forgotten when there are too many."""

    def __init__(self, key: bytes):
        super().__init__()
        self.key = key

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 19:
            self.clear()
        self[word] = h = int.from_bytes(blake2b(word, digest_size=8, key=self.key).digest(), "little")
        return h


@lru_cache(maxsize=2)
def word_digests(key: bytes) -> WordDigests:
    """One for each Python worker."""
    return WordDigests(key)


def digests(body: memoryview, starts: np.ndarray, ends: np.ndarray, key: bytes, size: int = 8) -> np.ndarray:
    """Keyed digests of byte ranges, as rows of 64-bit numbers."""
    told = [blake2b(body[a:b], digest_size=size, key=key).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    return np.frombuffer(b"".join(told), np.int64).reshape(-1, size // 8)


def window_minimum(x: np.ndarray, w: int) -> np.ndarray:
    """Minima of all windows of `w`: by blocks, from both sides."""
    n = len(x)
    full = np.full(-(-n // w) * w, np.uint64(M64))
    full[:n] = x
    rows = full.reshape(-1, w)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def segments(symbols: np.ndarray, doc: np.ndarray, window: int, k: int) -> tuple[np.ndarray, ...]:
    """(first window, windows, key) of the segments of joined sequences; `doc` tells them apart."""
    n = len(symbols)
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, none
    c = sums(symbols)
    grams = np.arange(n - k + 1)
    h = range_hash(c, grams, grams + k)
    low = window_minimum((h & ~POS) | grams.astype(np.uint64), window - k + 1)
    valid = np.flatnonzero(doc[: n - window + 1] == doc[window - 1 :])
    if not len(valid):
        return none, none, none
    at = (low[valid] & POS).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (valid[1:] != valid[:-1] + 1)])
    first, count = valid[new], np.diff(np.append(new, len(valid)))
    return first, count, h[at[new]].view(np.int64)
