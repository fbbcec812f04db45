"""A compressed FM-index: suffix order, BWT and a wavelet matrix with packed ranks."""

from __future__ import annotations

import numpy as np

ONE, SIX, LOW = np.uint64(1), np.uint64(6), np.uint64(63)


class Bits:
    """A bit vector of 64-bit words with one count for each word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words) + 1, np.int32)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])
        self.ones = int(self.before[-1])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        at = i >> 6
        mask = (ONE << (i & 63).astype(np.uint64)) - ONE
        return self.before[at] + np.bitwise_count(self.words[at] & mask)


class WaveletMatrix:
    def __init__(self, seq: np.ndarray, bits: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for bit in range(bits - 1, -1, -1):
            b = (seq >> bit) & 1
            self.levels.append((bit, Bits(b), int(len(b) - b.sum())))
            seq = np.concatenate([seq[b == 0], seq[b == 1]])
        self.first = np.zeros(1 << bits, np.int64)
        at = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
        self.first[seq[at]] = at

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        for bit, bits, zeros in self.levels:
            ones = bits.rank(i)
            i = np.where((symbol >> bit) & 1, zeros + ones, i - ones)
        return i - self.first[symbol]


def suffix_order(tokens: np.ndarray) -> np.ndarray:
    """Suffix order by prefix doubling."""
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        key = rank * (n + 1)
        key[:-step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        new = np.r_[0, np.cumsum(key[order][1:] != key[order][:-1])]
        rank[order] = new
        if new[-1] == n - 1 or step >= n:
            return order
        step *= 2


class FMIndex:
    """Sequences of symbols from 1, each closed by a sentinel of its own; searched backwards, many at once."""

    def __init__(self, sequences: list[np.ndarray], symbols: int):
        m = len(sequences)
        sizes = np.array([len(s) + 1 for s in sequences])
        text = np.zeros(sizes.sum(), np.int64)
        ends = np.cumsum(sizes) - 1
        inner = np.ones(len(text), bool)
        inner[ends] = False
        text[inner] = np.concatenate(sequences)
        order = suffix_order(np.where(inner, text + m, np.cumsum(~inner) - 1))
        self.bwt = WaveletMatrix(text[order - 1], max(1, int(symbols).bit_length()))
        self.below = np.r_[0, np.cumsum(np.bincount(text, minlength=symbols + 1))]
        self.size = len(text)

    def intervals(self, text: np.ndarray, first: np.ndarray, sizes: np.ndarray, shortest: int, least: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sequence, start, end) of the maximal stretches of at least `shortest` symbols that occur `least` times or more.

        Sequences stand in `text` from `first` on; all are streamed at once. Each
        end has a matching statistic, the longest stretch up to it that occurs so
        often: one backward search to the left, until its range gets too small.
        The next end is then the farthest that could still have a stretch of
        the wanted length with the symbol that did not fit.
        """
        out = []
        at = np.flatnonzero(sizes >= shortest)
        base, end = first[at], sizes[at].astype(np.int64)
        pos, lo, hi = end.copy(), np.zeros(len(at), np.int64), np.full(len(at), self.size, np.int64)
        while len(at):
            c = text[base + pos - 1]
            both = self.bwt.rank(np.concatenate([c, c]), np.concatenate([lo, hi]))
            low, high = self.below[c] + both[: len(c)], self.below[c] + both[len(c) :]
            fits = high - low >= least
            pos = pos - fits
            stop = ~fits | (pos == 0)
            found = np.flatnonzero(stop & (end - pos >= shortest))
            if len(found):
                out.append((at[found], pos[found], end[found]))
            end = np.where(stop, np.minimum(end - 1, pos - 1 + shortest), end)
            pos, lo, hi = np.where(stop, end, pos), np.where(stop, 0, low), np.where(stop, self.size, high)
            left = end >= shortest
            if not left.all():
                at, base, end, pos, lo, hi = (x[left] for x in (at, base, end, pos, lo, hi))
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (none, none, none)
