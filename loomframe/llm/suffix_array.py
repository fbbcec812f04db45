"""Suffix arrays by the difference cover of 3, sorting with numpy."""

from __future__ import annotations

import numpy as np


def names(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(order, name of each, number of names) of integer keys."""
    order = np.argsort(keys)  # equal keys may come in any order
    sorted_keys = keys[order]
    name = np.empty(len(keys), np.int64)
    name[order] = np.r_[0, np.cumsum(sorted_keys[1:] != sorted_keys[:-1])]
    return order, name, int(name[order[-1]]) + 1 if len(keys) else 0


def packed(width: int, first: np.ndarray, second: np.ndarray, third: np.ndarray) -> np.ndarray:
    """Rows of three numbers of up to `width` bits as integers in the rows' order; pairs are named first where three do not fit."""
    pair = (first << width) | second
    return ((pair if 3 * width <= 63 else names(pair)[1]) << width) | third


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix order of non-negative integers, a prefix before what it begins.

    Suffixes at 1 and 2 modulo 3 are sorted by their triples, whose names are
    sorted recursively where they repeat; the rest is sorted by symbol and the
    rank that follows, and merged in.
    """
    n = len(text)
    if n < 40:
        rows = [(text[i:].tolist(), i) for i in range(n)]
        return np.array([i for _, i in sorted(rows)], np.int64)
    s = np.zeros(n + 3, np.int64)
    s[:n] = names(text)[1] + 1
    width = max(int(s.max()).bit_length(), (2 * n // 3 + 3).bit_length())
    ones, twos, noughts = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3), np.arange(0, n, 3)
    sample = np.concatenate([ones, twos])
    order, name, count = names(packed(width, s[sample], s[sample + 1], s[sample + 2]))
    if count < len(sample):
        order = suffix_array(name + 1)
    rank = np.zeros(n + 3, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    sampled = sample[order]
    sampled = sampled[sampled < n]
    key0 = (s[noughts] << width) | rank[noughts + 1]
    zero = noughts[np.argsort(key0)]  # the ranks tell all apart
    in1, in2 = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    before = np.searchsorted((s[in1] << width) | rank[in1 + 1], (s[zero] << width) | rank[zero + 1])
    both = np.concatenate([in2, zero])
    keys = packed(width, s[both], s[both + 1], rank[both + 2])
    before += np.searchsorted(keys[: len(in2)], keys[len(in2) :])
    out = np.full(n, -1, np.int64)
    out[np.arange(len(zero)) + before] = zero
    out[out < 0] = sampled
    return out


def shared_prefixes(data: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each place in `order` but the last: whether it and the next begin with the same `length` symbols, of 0 to 256.

    Seven symbols are compared at once, and the last seven of the prefix in the end.
    """
    step = min(7, length)
    packed = np.zeros(max(len(data) - step + 1, 0), np.int64)
    for j in range(step):
        packed = (packed << 9) | data[j : j + len(packed)]
    open_ = np.flatnonzero(np.maximum(order[:-1], order[1:]) + length <= len(data))
    for j in [*range(0, length - step, step), length - step]:
        open_ = open_[packed[order[open_] + j] == packed[order[open_ + 1] + j]]
        if not len(open_):
            break
    out = np.zeros(max(len(order) - 1, 0), bool)
    out[open_] = True
    return out
