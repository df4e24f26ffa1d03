"""Nearest chips by a k-d tree, for blocks of colours: in a plain colour space, and by CIEDE2000."""

from __future__ import annotations

import numpy as np

#: Chips of a leaf; colours that are looked up at once; decimal places to which distances count.
LEAF, BLOCK, PLACES = 8, 4096, 12
#: So few chips are compared in a plain space without the tree: a table of them is faster than the walk.
FEW = 256
#: More than rounding can lose between a bound and a distance.
SLACK = 1e-9

_FAR = 25.0**7


def _share(c: np.ndarray) -> np.ndarray:
    p = c**7
    return np.sqrt(p / (p + _FAR))


def ciede2000(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """CIEDE2000 of pairs of rows of Lab, as functions.color.ciede2000 has it."""
    l1, a1, b1, l2, a2, b2 = *one.T, *two.T
    g = 0.5 * (1 - _share((np.hypot(a1, b1) + np.hypot(a2, b2)) / 2))
    p1, p2 = a1 * (1 + g), a2 * (1 + g)
    c1, c2 = np.hypot(p1, b1), np.hypot(p2, b2)
    h1, h2 = (np.where((p == 0) & (b == 0), 0, np.mod(np.degrees(np.arctan2(b, p)) + 360, 360)) for p, b in ((p1, b1), (p2, b2)))
    total, turn, gray = h1 + h2, h2 - h1, c1 * c2 == 0
    near = np.abs(turn) <= 180
    dh = np.where(gray, 0, np.where(near, turn, np.where(turn > 0, turn - 360, turn + 360)))
    mid_h = np.where(gray, total, np.where(near, total / 2, np.where(total < 360, (total + 360) / 2, (total - 360) / 2)))
    mid_c, off = (c1 + c2) / 2, ((l1 + l2) / 2 - 50) ** 2
    wave = lambda scale, shift: np.cos(np.radians(scale * mid_h + shift))
    t = 1 - 0.17 * wave(1, -30) + 0.24 * wave(2, 0) + 0.32 * wave(3, 6) - 0.20 * wave(4, -63)
    rotation = 2 * _share(mid_c) * np.sin(np.radians(60 * np.exp(-(((mid_h - 275) / 25) ** 2))))
    dl = (l2 - l1) / (1 + 0.015 * off / np.sqrt(20 + off))
    dc = (c2 - c1) / (1 + 0.045 * mid_c)
    dt = 2 * np.sqrt(c1 * c2) * np.sin(np.radians(dh / 2)) / (1 + 0.015 * mid_c * t)
    return np.sqrt(np.maximum(0, dl * dl + dc * dc + dt * dt - rotation * dc * dt))


def squared(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Squared distance of pairs of rows."""
    d = one - two
    return d[:, 0] ** 2 + d[:, 1] ** 2 + d[:, 2] ** 2


def _grown(c: np.ndarray) -> np.ndarray:
    """How much chroma the formula adds to a mean chroma c at most."""
    return 0.5 * c * (1 - _share(c))


#: The greatest of it, over all chromas, and a little more.
_MOST_GROWN = float(_grown(np.linspace(0, 200, 20001)).max()) + 0.01
#: The greatest weight of lightness in the formula, and the sine of the greatest rotation.
_MOST_SL, _MOST_TURN = 1 + 0.015 * 2500 / np.sqrt(2520), np.sin(np.radians(60))


def _squared_bound(gap: np.ndarray, own: np.ndarray, chroma: np.ndarray) -> np.ndarray:
    return (gap**2).sum(axis=1)


def _ciede2000_bound(gap: np.ndarray, own: np.ndarray, chroma: np.ndarray) -> np.ndarray:
    """No CIEDE2000 of a colour and a chip is less, for chips ``gap`` away at least on each axis and of at most ``chroma``.

    Chroma and hue differ by the distance in (a, b) at least, as the formula only stretches a; each is divided by at
    most 1 + 0.045 * the mean chroma; and the mixed term takes at most a share of both."""
    mean = (np.hypot(own[:, 1], own[:, 2]) + chroma) / 2 + _MOST_GROWN
    rest = 1 - _MOST_TURN * _share(mean)
    return np.sqrt((gap[:, 0] / _MOST_SL) ** 2 + rest * (gap[:, 1] ** 2 + gap[:, 2] ** 2) / (1 + 0.045 * mean) ** 2)


class ChipTree:
    """Chips by halves along their longest axis. nearest() gives, for each colour, the least (distance to PLACES, index)."""

    def __init__(self, index: np.ndarray, points: np.ndarray, metric: str = "squared") -> None:
        self.distance, self.bound = {"squared": (squared, _squared_bound), "ciede2000": (ciede2000, _ciede2000_bound)}[metric]
        order, parts, children = np.argsort(index, kind="stable"), [], []
        self.few = (points[order], np.asarray(index)[order].astype(np.int64)) if metric == "squared" and len(order) <= FEW else None

        def split(own: np.ndarray) -> int:
            at = len(children)
            children.append((-1, -1))
            parts.append(own)
            if len(own) > LEAF:
                axis = int(np.ptp(points[own], axis=0).argmax())
                by = own[np.argsort(points[own, axis], kind="stable")]
                children[at] = (split(by[: len(by) // 2]), split(by[len(by) // 2 :]))
            return at

        split(order)
        self.children = np.array(children)
        self.low, self.high = (np.array([f(points[p], axis=0) for p in parts]) for f in (np.min, np.max))
        chroma = np.hypot(points[:, 1], points[:, 2])
        self.chroma = np.array([chroma[p].max() for p in parts])
        leaf = self.children[:, 0] < 0
        sizes = np.where(leaf, [len(p) for p in parts], 0)
        self.cuts = np.concatenate([[0], np.cumsum(sizes)])
        kept = np.concatenate([p for p, own in zip(parts, leaf, strict=True) if own])
        self.points, self.index = points[kept], np.asarray(index)[kept].astype(np.int64)

    def _least(self, own: np.ndarray, colors: np.ndarray, which: np.ndarray, node: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The distances and indexes of the leaves' chips, put into least (colours, 2): the first of the least ones."""
        n = self.cuts[node + 1] - self.cuts[node]
        row = np.repeat(np.arange(len(node)), n)
        chip = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + self.cuts[node][row]
        which = which[row]
        d = np.round(self.distance(colors[which], self.points[chip]), PLACES)
        order = np.lexsort((self.index[chip], d, which))
        which, d, chip = which[order], d[order], chip[order]
        first = np.ones(len(which), bool)
        first[1:] = which[1:] != which[:-1]
        which, d, index = which[first], d[first], self.index[chip[first]]
        better = (d < own[which]) | ((d == own[which]) & (index < least[which]))
        own[which[better]], least[which[better]] = d[better], index[better]
        return least

    def nearest(self, colors: np.ndarray) -> np.ndarray:
        """Chip indexes of rows of colours, in blocks."""
        return np.concatenate([self._block(colors[at : at + BLOCK]) for at in range(0, len(colors), BLOCK)]) if len(colors) else np.zeros(0, np.int64)

    def _block(self, colors: np.ndarray) -> np.ndarray:
        if self.few:
            points, index = self.few
            return index[np.round(sum((colors[:, c, None] - points[:, c]) ** 2 for c in range(3)), PLACES).argmin(axis=1)]
        every = np.arange(len(colors))
        best, least = np.full(len(colors), np.inf), np.full(len(colors), np.iinfo(np.int64).max)
        node = np.zeros(len(colors), np.int64)  # down to one leaf first, for a bound that cuts much
        while (inner := self.children[node, 0] >= 0).any():
            pair = self.children[node[inner]]
            gaps = [self._gap(colors[inner], c) for c in pair.T]
            bounds = [self.bound(g, colors[inner], self.chroma[c]) for g, c in zip(gaps, pair.T, strict=True)]
            node[inner] = np.where(bounds[0] <= bounds[1], pair[:, 0], pair[:, 1])
        self._least(best, colors, every, node, least)
        which, node = every, np.zeros(len(colors), np.int64)
        while len(which):
            near = self.bound(self._gap(colors[which], node), colors[which], self.chroma[node]) <= best[which] + SLACK
            which, node = which[near], node[near]
            leaf = self.children[node, 0] < 0
            if leaf.any():
                self._least(best, colors, which[leaf], node[leaf], least)
            which, node = np.repeat(which[~leaf], 2), self.children[node[~leaf]].ravel()
        return least

    def _gap(self, colors: np.ndarray, node: np.ndarray) -> np.ndarray:
        return np.maximum(0, np.maximum(self.low[node] - colors, colors - self.high[node]))

