"""Exact names of words and of word runs: equal runs have equal numbers, by doubling their length."""

from __future__ import annotations

import numpy as np

from ._words import Words


def exact_ids(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word, equal where the bytes are, and the first word of each number."""
    _, first, ids = np.unique(words.hashes(), return_index=True, return_inverse=True)
    if not words.equal(first[ids]):  # two words with one hash
        known: dict[bytes, int] = {}
        ids = np.array([known.setdefault(words.data[a:b].tobytes(), len(known)) for a, b in zip(words.start.tolist(), words.end.tolist(), strict=True)], np.int64)
        first = np.unique(ids, return_index=True)[1]
    return ids.astype(np.int64), first


def named(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Numbers of pairs; both sides are numbers below 2**31."""
    if not len(left):
        return left
    return np.unique((left << np.int64(31)) | right, return_inverse=True)[1].astype(np.int64)


def window_names(ids: np.ndarray, text: np.ndarray, doublings: int) -> np.ndarray:
    """Names of the windows of 2**doublings words of one text, by their first word; windows of two texts differ, and
    words where no window of one text starts have -1."""
    names = named(text, ids)
    for k in range(doublings):
        step = 1 << k
        if len(names) <= step:
            return np.full(len(ids), -1, np.int64)
        names = named(names[:-step], names[step:])
    size = 1 << doublings
    whole = text[: len(names)] == text[size - 1 :]
    return np.concatenate([np.where(whole, names, -1), np.full(len(ids) - len(names), -1, np.int64)])
