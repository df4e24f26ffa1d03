"""Compressed FM-index over word numbers: bit-packed wavelet matrix, backward search of many patterns at once."""

from __future__ import annotations

import numpy as np


def suffix_order(ids: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` words at least, by prefix doubling."""
    n = len(ids)
    base = int(ids.max()) + 2
    rank, have = ids.astype(np.int64) + 1, 1
    if base < 1 << 20:  # three words in one number
        wide = np.concatenate([rank, np.zeros(2, np.int64)])
        rank, have = (wide[:n] * base + wide[1 : n + 1]) * base + wide[2 : n + 2], 3
        order = np.argsort(rank)
    else:
        order = np.argsort(rank, kind="stable")
    while True:
        by = rank[order]
        place = np.concatenate([[1], 1 + np.cumsum(by[1:] != by[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = place
        if have >= depth or place[-1] == n:
            return order
        after = np.zeros(n, np.int64)
        after[: n - have] = rank[have:]
        rank = rank * (n + 1) + after
        order = np.argsort(rank)
        have *= 2


class FmIndex:
    """Counts and finds word patterns of at most ``depth`` words in a text of word numbers (0 ends a part). weights: how
    many times each word of the text counts, where that is not once."""

    def __init__(self, ids: np.ndarray, depth: int, weights: np.ndarray | None = None):
        self.ids, self.n = ids, len(ids)
        order = suffix_order(ids, depth)
        self.weight = None if weights is None else np.concatenate([[0], np.cumsum(weights[order])])  # of suffixes, in order
        seq = ids[order - 1]  # the word before each suffix; the text's last before its first
        self.first = np.concatenate([[0], np.cumsum(np.bincount(ids))]).astype(np.int64)
        symbols = len(self.first) - 1
        self.bits = max(1, int(symbols - 1).bit_length())
        self.words, self.ranks, self.zeros = [], [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (seq >> level) & 1
            packed = np.packbits(np.concatenate([bit, np.zeros(64 - self.n % 64, bit.dtype)]).astype(bool), bitorder="little").view("<u8")
            self.words.append(packed)
            self.ranks.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed))[:-1]]).astype(np.int32))
            self.zeros.append(self.n - int(bit.sum()))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])
        self.begin = self._descend(np.arange(symbols), np.zeros(symbols, np.int64))

    def _descend(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Follow position i down the wavelet matrix along the bits of symbol c."""
        for k in range(self.bits):
            block = i >> 6
            below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.ranks[k][block] + np.bitwise_count(self.words[k][block] & below)
            i = np.where((c >> (self.bits - 1 - k)) & 1, self.zeros[k] + ones, i - ones)
        return i

    def extended(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with word c put before them."""
        k = len(c)
        down = self._descend(np.concatenate([c, c]), np.concatenate([lo, hi]))
        start = self.first[c] - self.begin[c]
        return start + down[:k], start + down[k:]

    def matched(self, ends: np.ndarray, length: int, least: int = 2) -> np.ndarray:
        """Backward search of the ``length`` words before each end, in this text: -1 if they occur ``least``
        times, else the place of the word with which the match statistic ends."""
        fail = np.full(len(ends), -1, np.int64)
        act, at = np.arange(len(ends)), ends - 1
        c = self.ids[at]
        lo, hi = self.first[c], self.first[c + 1]
        for step in range(length):
            if step:
                at = at - 1
                c = self.ids[at]
                lo, hi = self.extended(c, lo, hi)
            short = (hi - lo if self.weight is None else self.weight[hi] - self.weight[lo]) < least
            if short.any():
                fail[act[short]] = at[short]
                on = ~short
                act, at, lo, hi = act[on], at[on], lo[on], hi[on]
                if not len(act):
                    break
        return fail


def repeated_cover(index: FmIndex, start: np.ndarray, windows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of words covered by repeated windows: (part, from, to), from and to within the part.

    start: place of each part in the index's text; windows: how many windows start in it. A failed search
    tells that every window over [failing word, end) is unique, so the next test is past that word. After a
    repeated window the next test is one length on: if that is repeated too, all between is covered; if not,
    the windows between are tested for the last one that is.
    """
    part, at = np.arange(len(start)), np.zeros(len(start), np.int64)
    gap = np.zeros(len(start), np.int64)  # windows before ``at`` that were jumped over
    found_part, found_at = [], []
    keep = windows > 0
    part, at, gap = part[keep], at[keep], gap[keep]
    while len(part):
        fail = index.matched(start[part] + at + length, length)
        good = fail < 0
        found_part.append(part[good])
        found_at.append(at[good])
        look = ~good & (gap > 0)
        if look.any():
            n = gap[look]
            owner = np.repeat(np.flatnonzero(look), n)
            t = at[owner] - 1 - (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))  # from the last one down
            hit = index.matched(start[part[owner]] + t + length, length) < 0
            owner, first = np.unique(owner[hit], return_index=True)
            found_part.append(part[owner])
            found_at.append(t[hit][first])
        last = windows[part] - 1
        step = np.where(good, np.minimum(at + length, last), fail - start[part] + 1)
        done = np.where(good, at >= last, step > last)
        gap = np.where(good, step - at - 1, 0)
        part, at, gap = part[~done], step[~done], gap[~done]
    part, at = np.concatenate([*found_part, np.zeros(0, np.int64)]), np.concatenate([*found_at, np.zeros(0, np.int64)])
    order = np.lexsort((at, part))
    part, at = part[order], at[order]
    new = np.ones(len(part), bool)
    new[1:] = (part[1:] != part[:-1]) | (at[1:] > at[:-1] + length)
    last = np.append(np.flatnonzero(new)[1:], len(part)) - 1 if len(part) else np.zeros(0, np.int64)
    return part[new], at[new], at[last] + length
