"""Words of whole text batches as numpy arrays: borders, hashes, sampled word runs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

from ._common import text_buffer

#: Bytes of text that are cut into words at once (one longer text is cut as a whole).
SLICE = 4 << 20
#: Longer words are hashed one by one.
LONG_WORD = 256

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MASK = np.array([(1 << 8 * i) - 1 for i in range(8)] + [2**64 - 1], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def is_space(data: np.ndarray) -> np.ndarray:
    return _SPACE[data]


@dataclass(frozen=True)
class Words:
    """Words of some texts, in order: bytes, first and last byte of each word, its text's number, and where texts begin."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    offsets: np.ndarray | None = None

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, eight bytes at a time."""
        size = self.end - self.start
        padded = np.zeros(len(self.data) + 8, np.uint8)
        padded[: len(self.data)] = self.data
        lanes = np.ndarray((len(self.data) + 1,), "<u8", padded, strides=(1,))
        h = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for at in range(0, LONG_WORD, 8):
            own = np.flatnonzero((size > at) & (size <= LONG_WORD)) if at else np.flatnonzero(size <= LONG_WORD)
            if not len(own):
                break
            h[own] = mixed(h[own] ^ (lanes[self.start[own] + at] & _MASK[np.minimum(size[own] - at, 8)]))
        for i in np.flatnonzero(size > LONG_WORD).tolist():
            h[i] = xxhash.xxh64_intdigest(self.data[self.start[i] : self.end[i]].tobytes(), 1)
        return h

    def equal(self, other: np.ndarray) -> bool:
        """Whether every word i has the bytes of word other[i]."""
        size = self.end - self.start
        if not np.array_equal(size, size[other]):
            return False
        padded = np.zeros(len(self.data) + 8, np.uint8)
        padded[: len(self.data)] = self.data
        lanes = np.ndarray((len(self.data) + 1,), "<u8", padded, strides=(1,))
        left = np.flatnonzero((other != np.arange(len(size))) & (size <= LONG_WORD))
        for at in range(0, LONG_WORD, 8):
            left = left[size[left] > at]
            if not len(left):
                break
            if ((lanes[self.start[left] + at] ^ lanes[self.start[other[left]] + at]) & _MASK[np.minimum(size[left] - at, 8)]).any():
                return False
        long = np.flatnonzero(size > LONG_WORD).tolist()
        return all(np.array_equal(self.data[self.start[i] : self.end[i]], self.data[self.start[o] : self.end[o]]) for i, o in zip(long, other[long].tolist(), strict=True))


def word_slices(column: pa.Array, gaps: np.ndarray = _SPACE) -> Iterator[tuple[int, int, Words]]:
    """(first row, rows, words) of parts of an Arrow column of texts; nulls have no words. gaps: which bytes part words."""
    data, at = text_buffer(column)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(at, at[first] + SLICE, "right")) - 1)
        own, offsets = data[at[first] : at[last]], at[first : last + 1] - at[first]
        space = gaps[own]
        opens, closes = np.empty(len(own), bool), np.empty(len(own), bool)
        if len(own):
            opens[0], opens[1:] = True, space[:-1]
            closes[-1], closes[:-1] = True, space[1:]
            opens[offsets[:-1][offsets[:-1] < len(own)]] = True
            closes[offsets[1:][offsets[1:] > 0] - 1] = True
        start, end = np.flatnonzero(opens & ~space), np.flatnonzero(closes & ~space) + 1
        yield first, last - first, Words(own, start, end, np.searchsorted(offsets, start, "right") - 1, offsets)
        first = last


def _slide(best, a: np.ndarray, width: int) -> np.ndarray:
    """Minimum or maximum of each ``width`` neighbours."""
    have = 1
    while have < width:
        more = min(have, width - have)
        a = best(a[:-more], a[more:]) if len(a) > more else a[:0]
        have += more
    return a


@dataclass(frozen=True)
class Samples:
    """Sampled runs of ``gram`` words: place of the first word, hash, and the least hash from each window on."""

    at: np.ndarray
    gram: np.ndarray
    least: np.ndarray  # by window start; 0: no window of one text starts here

    def starts(self, which: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last start of the windows that sampled run ``which`` stands for."""
        back = np.arange(width - 1, -1, -1)
        s = self.at[which][:, None] - back
        own = (s >= 0) & (s < len(self.least))
        own &= self.least[np.where(own, s, 0)] == self.gram[which][:, None]
        return self.at[which] - back[own.argmax(axis=1)], self.at[which] - own[:, ::-1].argmax(axis=1)


def samples(h: np.ndarray, text: np.ndarray, window: int, gram: int) -> Samples:
    """Runs of ``gram`` words whose hash is the least in some window of ``window`` words (all that tie for it).

    Equal windows hold the same least run, wherever they stand, so they share a sample.
    """
    n, width = len(h), window - gram + 1
    none = np.zeros(0, np.int64)
    if n < window:
        return Samples(none, none.astype(np.uint64), none.astype(np.uint64))
    g = np.zeros(n - gram + 1, np.uint64)
    for j in range(gram):
        g = g * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n - gram + 1]
    g = mixed(g) | np.uint64(1)
    least = _slide(np.minimum, g, width)
    least = np.where(text[: n - window + 1] == text[window - 1 :], least, np.uint64(0))
    pad = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero(_slide(np.maximum, np.concatenate([pad, least, pad]), width) == g)
    return Samples(at, g[at], least)
