"""An FM-index over integer symbols: suffix array, wavelet matrix ranks, sampled positions. Symbol 0 parts segments."""

from __future__ import annotations

import numpy as np

SAMPLE = 8


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffixes of s in order, by prefix doubling. Every 0 is a symbol of its own, lower than all others, in the order of
    position; so comparing stops at a segment's end and takes log2(longest segment) rounds at most."""
    n = s.size
    zeros = np.flatnonzero(s == 0)
    rank = s.astype(np.int64) + zeros.size
    rank[zeros] = np.arange(zeros.size)
    order = np.argsort(rank, kind="stable")
    rank = dense(rank[order], order)
    step = 1
    while n and rank.max() < n - 1:
        second = np.full(n, -1, np.int64)
        second[: n - step] = rank[step:]
        key = rank * (n + 1) + second + 1
        order = np.argsort(key, kind="stable")
        rank = dense(key[order], order)
        step *= 2
    return order


def dense(ordered: np.ndarray, order: np.ndarray) -> np.ndarray:
    out = np.empty(order.size, np.int64)
    out[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])]) if order.size else []
    return out


class WaveletMatrix:
    """Ranks of symbols: one bit vector a level, highest bit first; zeros are kept before ones on the next level."""

    def __init__(self, s: np.ndarray, top: int) -> None:
        self.levels = []
        for bit in reversed(range(max(1, int(top).bit_length()))):
            bits = (s >> bit & 1).astype(np.uint8)
            packed = np.zeros(-(-(s.size + 1) // 64) * 8, np.uint8)
            packed[: -(-s.size // 8)] = np.packbits(bits, bitorder="little")
            words = packed.view("<u8")
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])
            self.levels.append((bit, words, before, s.size - int(bits.sum())))
            s = np.concatenate([s[bits == 0], s[bits == 1]])

    @staticmethod
    def ones(words: np.ndarray, before: np.ndarray, i: np.ndarray) -> np.ndarray:
        at = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return before[at] + np.bitwise_count(words[at] & mask).astype(np.int64)

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c stands before i."""
        lo, hi = np.zeros_like(i), i.copy()
        for bit, words, before, zeros in self.levels:
            one = (c >> bit & 1).astype(bool)
            a, b = self.ones(words, before, lo), self.ones(words, before, hi)
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
        return hi - lo

    def symbol_and_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at i and how often it stands before i."""
        c, lo, at = np.zeros_like(i), np.zeros_like(i), i.copy()
        for bit, words, before, zeros in self.levels:
            a, b, e = self.ones(words, before, lo), self.ones(words, before, at), self.ones(words, before, at + 1)
            one = e > b
            c = c | np.where(one, 1 << bit, 0)
            lo, at = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, at - b)
        return c, at - lo


class FMIndex:
    def __init__(self, s: np.ndarray, top: int, sample: int = SAMPLE) -> None:
        """s: symbols 0..top, with a 0 at its end; sample: every so manyth position of s is kept."""
        order = suffix_array(s)
        bwt = np.where(order > 0, s[order - 1], 0)
        self.ranks = WaveletMatrix(bwt, top)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=top + 1))])
        # a segment's first position is kept too, so that no walk leaves its segment
        kept = (order % sample == 0) | (bwt == 0)
        self.kept, self.kept_rank, self.positions = kept, np.cumsum(kept) - 1, order[kept]
        self.n = s.size

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of patterns, all of one length and without 0, the range of suffixes that it begins."""
        m = patterns.shape[0]
        lo, hi = np.zeros(m, np.int64), np.full(m, self.n, np.int64)
        live = np.arange(m)
        for j in reversed(range(patterns.shape[1])):
            c = patterns[live, j]
            a = self.before[c] + self.ranks.rank(c, lo[live])
            b = self.before[c] + self.ranks.rank(c, hi[live])
            lo[live], hi[live] = a, np.maximum(a, b)
            live = live[a < b]
            if not live.size:
                break
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes: steps back to a kept one, then as many forward."""
        out, steps, live, at = np.empty(rows.size, np.int64), 0, np.arange(rows.size), rows.astype(np.int64)
        while live.size:
            held = self.kept[at]
            out[live[held]] = self.positions[self.kept_rank[at[held]]] + steps
            live, at = live[~held], at[~held]
            if live.size:
                c, r = self.ranks.symbol_and_rank(at)
                at = self.before[c] + r
                steps += 1
        return out
