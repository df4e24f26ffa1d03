"""Weighted acyclic automata of n-grams by levels: the path to an arc spells an n-gram, the arc's weight is its count.

Level 0 has the languages, levels 1 to 3 the words. Arcs of a state stand in the order of their labels, which are
places in a sorted vocabulary. Equal states (equal arcs: labels, weights, targets) are kept once.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np

from ._words import mixed

DEPTH = 4
_KINDS = (np.uint8, np.uint16, np.uint32, np.int64)


@dataclass
class Level:
    """Arcs of a level's states: state i has arcs cuts[i] to cuts[i + 1]."""

    cuts: np.ndarray
    label: np.ndarray
    weight: np.ndarray
    target: np.ndarray  # state of the next level


@dataclass
class Transducer:
    vocab: list[bytes]
    levels: list[Level]


def _grouped(state: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(state, np.arange(n + 1))


def _spread(cuts: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of states, arc) for all arcs of states, in order."""
    states = states.astype(np.int64, copy=False)
    n = cuts[states + 1] - cuts[states]
    which = np.repeat(np.arange(len(states)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + cuts[states][which]


def _merged_states(level: Level) -> tuple[Level, np.ndarray]:
    """The level with equal states kept once, and the new number of each state."""
    n = len(level.cuts) - 1
    size = level.cuts[1:] - level.cuts[:-1]
    h = mixed(mixed(mixed(level.label.astype(np.uint64) + np.uint64(1)) + level.weight.astype(np.uint64)) + level.target.astype(np.uint64))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h, dtype=np.uint64)])
    sign = mixed(total[level.cuts[1:]] - total[level.cuts[:-1]] + size.astype(np.uint64))
    _, first, of = np.unique(sign, return_index=True, return_inverse=True)
    like = first[of]  # the first state with this sign; states that differ from it stay as they are
    differ = size != size[like]
    which, arc = _spread(level.cuts, np.arange(n))
    comparable = ~differ[which]
    which, arc = which[comparable], arc[comparable]
    other = level.cuts[like[which]] + arc - level.cuts[which]
    bad = (level.label[arc] != level.label[other]) | (level.weight[arc] != level.weight[other]) | (level.target[arc] != level.target[other])
    differ[which[bad]] = True
    like[differ] = np.flatnonzero(differ)
    stay, number = np.unique(like, return_inverse=True)
    which, arc = _spread(level.cuts, stay)
    return Level(_grouped(which, len(stay)), level.label[arc], level.weight[arc], level.target[arc]), number


def build(vocab: list[bytes], rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Transducer:
    """rows[k]: (parent, label, weight) of the n-grams of level k in sorted order; parent is a row of level k - 1. From
    the last level up, states are made and equal ones merged, so a level's targets are final when its states are compared."""
    levels, number = [], np.zeros(0, np.int64)
    for k in range(DEPTH - 1, -1, -1):
        parent, label, weight = rows[k]
        n = len(rows[k - 1][0]) if k else 1
        target = number if k + 1 < DEPTH else np.zeros(len(label), np.int64)
        level, number = _merged_states(Level(_grouped(parent, n), label, weight, target))
        levels.append(level)
    return Transducer(vocab, levels[::-1])


def paths(t: Transducer) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """What ``build`` takes: the automaton as a tree, level by level."""
    out, states = [], np.zeros(1, np.int64)
    for level in t.levels:
        parent, arc = _spread(level.cuts, states)
        out.append((parent, level.label[arc].astype(np.int64), level.weight[arc].astype(np.int64)))
        states = level.target[arc]
    return out


def _common(vocabs: list[list[bytes]]) -> tuple[list[bytes], list[np.ndarray]]:
    vocab = sorted(set().union(*vocabs))
    place = {w: i for i, w in enumerate(vocab)}
    return vocab, [np.array([place[w] for w in v], np.int64) for v in vocabs]


def union(parts: Iterable[Transducer]) -> tuple[list[bytes], list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """The union of automata as a tree; weights of equal paths are added. All automata are walked together, one level at
    a time: arcs with one label that leave states reached by one path become one arc."""
    parts = list(parts)
    if not parts:
        return [], [(np.zeros(0, np.int64),) * 3] * DEPTH
    vocab, maps = _common([t.vocab for t in parts])
    rows = []
    reached = [np.zeros(1, np.int64) for _ in parts]  # state of the union in which each state of a part is
    states = [np.zeros(1, np.int64) for _ in parts]
    for k in range(DEPTH):
        at, label, weight, target, sizes = [], [], [], [], []
        for i, t in enumerate(parts):
            level = t.levels[k]
            which, arc = _spread(level.cuts, states[i])
            at.append(reached[i][which])
            label.append(maps[i][level.label[arc]])
            weight.append(level.weight[arc])
            target.append(level.target[arc])
            sizes.append(len(arc))
        at, label, weight = (np.concatenate(x).astype(np.int64, copy=False) for x in (at, label, weight))
        key, number = np.unique(at * np.int64(max(1, len(vocab))) + label, return_inverse=True)
        total = np.zeros(len(key), np.int64)
        np.add.at(total, number, weight)
        rows.append((key // max(1, len(vocab)), key % max(1, len(vocab)), total))
        reached = np.split(number, np.cumsum(sizes)[:-1])
        states = target
    return vocab, rows


def kept(vocab: list[bytes], rows: list, least: int) -> tuple[list[bytes], list]:
    """Without words and word runs of a weight under ``least``; a shorter run stays if it leads to one that stays, a
    language stays always. Words that no arc has leave the vocabulary."""
    stay = [None] * DEPTH
    for k in range(DEPTH - 1, -1, -1):
        stay[k] = rows[k][2] >= least if k else np.ones(len(rows[0][0]), bool)
        if k + 1 < DEPTH:
            stay[k][rows[k + 1][0][stay[k + 1]]] = True
    return _compact(vocab, [[x[s] for x in r] for r, s in zip(rows, stay, strict=True)], stay)


def _compact(vocab: list[bytes], rows: list, stay: list[np.ndarray]) -> tuple[list[bytes], list]:
    used = np.unique(np.concatenate([r[1] for r in rows]))
    out = []
    for k, (parent, label, weight) in enumerate(rows):
        out.append((np.cumsum(stay[k - 1])[parent] - 1 if k else parent, np.searchsorted(used, label), weight))
    return [vocab[i] for i in used.tolist()], out


def composed(asked: Transducer, vocab: list[bytes], rows: list) -> list[np.ndarray]:
    """Weights that the tree has for the paths of ``asked`` (0: no such path), level by level as ``paths`` has them, and
    the places of its arcs (-1: none), as pairs: both are walked together, one level at a time."""
    place = {w: i for i, w in enumerate(vocab)}
    own = np.array([place.get(w, -1) for w in asked.vocab], np.int64)
    out, states, where = [], np.zeros(1, np.int64), np.zeros(1, np.int64)
    for k, level in enumerate(asked.levels):
        which, arc = _spread(level.cuts, states)
        parent, label, weight = rows[k]
        size = max(1, len(vocab))
        key = where[which] * size + own[level.label[arc]]
        known = (where[which] >= 0) & (own[level.label[arc]] >= 0)
        have = parent * size + label
        at = np.minimum(np.searchsorted(have, key), max(0, len(have) - 1))
        known &= have[at] == key if len(have) else False
        where = np.where(known, at, -1)
        out.append((np.where(known, weight[at], 0) if len(have) else np.zeros(len(key), np.int64), where))
        states = level.target[arc]
    return out


def dump(t: Transducer) -> bytes:
    """As bytes; each array in the smallest whole numbers that hold it."""
    arrays = [np.array([len(w) for w in t.vocab], np.int64), *(x for level in t.levels for x in (level.cuts[1:] - level.cuts[:-1], level.label, level.weight, level.target))]
    parts = []
    for a in arrays:
        top = int(a.max()) if len(a) else 0
        kind = next(i for i, c in enumerate(_KINDS) if top <= np.iinfo(c).max)
        parts += [struct.pack("<BQ", kind, len(a)), a.astype(_KINDS[kind]).tobytes()]
    return b"".join([*parts, *t.vocab])


def load(blob: bytes) -> Transducer:
    at, arrays = 0, []
    for _ in range(1 + 4 * DEPTH):
        kind, n = struct.unpack_from("<BQ", blob, at)
        a = np.frombuffer(blob, _KINDS[kind], n, at + 9)
        at += 9 + a.nbytes
        arrays.append(a)  # arcs stay as narrow as they were stored until they are walked
    ends = (at + np.cumsum(arrays[0], dtype=np.int64)).tolist()
    vocab = [blob[a:b] for a, b in zip([at, *ends], ends, strict=False)]
    levels = [Level(np.concatenate([[0], np.cumsum(arrays[i], dtype=np.int64)]), *arrays[i + 1 : i + 4]) for i in range(1, 1 + 4 * DEPTH, 4)]
    return Transducer(vocab, levels)
