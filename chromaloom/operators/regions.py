"""Paint-by-number areas: facets, their neighbours, widths and merges, region tables, outlines."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .iterate import checkpoint

# Share of the image that the least facet has at detail 0 and 1; rounds and likeness of merges.
LARGEST_SHARE, SMALLEST_SHARE = 0.003, 0.0001
MERGE_ROUNDS, LIKE_LIGHTNESS = 40, 0.20
#: Pixels that an image worked on whole may have: twice the largest working size of four megapixels.
MOST_PIXELS = 1 << 23
#: Pixels of an image whose channels are smoothed together.
SMALL = 1 << 16
#: Pixels of a tile's side: what one task works on where tiles are independent.
TILE = 512
#: Places of a distance pass that are worked on at once.
FRONT = 1 << 20


def flatten_l0(pixels: DataFrame, flatten: float) -> DataFrame:
    """Pixels with texture smoothed and edges kept, by L0 gradient minimisation (Xu et al. 2011) with FFTs.

    One full image is one group; channels come back as whole numbers, halves up."""
    strength = 0.002 + 0.045 * min(1.0, max(0.0, flatten))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        image = np.stack([np.maximum(_grid(frame, c), 0).astype(np.float32) / np.float32(255) for c in "rgb"], axis=2)  # a missing pixel is black
        out = _at(frame, np.floor(smoothed(image, strength) * np.float32(255) + np.float32(0.5)).astype(np.int32))
        return frame[["image_id", "x", "y"]].assign(r=out[:, 0], g=out[:, 1], b=out[:, 2])

    kind = pixels.schema["image_id"].dataType.simpleString()
    return pixels.select("image_id", "x", "y", "r", "g", "b").groupBy("image_id").applyInPandas(run, f"image_id {kind}, x int, y int, r int, g int, b int")


def smoothed(image: np.ndarray, strength: float) -> np.ndarray:
    """One image (h, w, 3) in 0..1: alternate between keeping strong gradients and solving for the image that has
    them, with a weight that doubles up to 1e5. In 32-bit floats, by transforms of real numbers; a channel at a time where
    an image is large: at the cap of MOST_PIXELS that is some 600 MB."""
    h, w, channels = image.shape
    rows, columns = np.sin(np.pi * np.fft.fftfreq(h)) ** 2, np.sin(np.pi * np.fft.rfftfreq(w)) ** 2
    wave = (4 * (rows[:, None] + columns[None, :])).astype(np.float32)
    at_once = channels if h * w <= SMALL else 1
    out = [np.ascontiguousarray(image[..., c : c + at_once].transpose(2, 0, 1), np.float32) for c in range(0, channels, at_once)]
    start = [np.fft.rfft2(c) for c in out]
    beta = 2 * strength
    while beta < 1e5:
        power, steps = np.zeros((h, w), np.float32), []
        for c in out:
            dx, dy = np.roll(c, -1, 2) - c, np.roll(c, -1, 1) - c
            for one in dx**2 + dy**2:
                power += one
            steps.append((dx, dy) if at_once > 1 else None)
        strong = power >= strength / beta
        for k, c in enumerate(out):
            dx, dy = steps[k] or (np.roll(c, -1, 2) - c, np.roll(c, -1, 1) - c)
            dx, dy = dx * strong, dy * strong
            back = np.roll(dx, 1, 2) - dx + np.roll(dy, 1, 1) - dy
            out[k] = np.fft.irfft2((start[k] + np.float32(beta) * np.fft.rfft2(back)) / (1 + np.float32(beta) * wave), s=(h, w))
        beta *= 2
    return np.clip(np.concatenate(out).transpose(1, 2, 0), 0, 1)


def flatten_edges(pixels: DataFrame, sigma_s: float = 57.0, sigma_r: float = 0.23, mode: str = "recurs") -> DataFrame:
    """Pixels smoothed up to edges by a domain transform (Gastal and Oliveira 2011): the cheap way to flatten. mode:
    recurs (recursive filter) or normconv (normalised convolution); sigmas are held to 1..200 and 0.01..1.

    One full image is one group; channels come back as whole numbers, halves up."""
    if mode not in ("recurs", "normconv"):
        raise ValueError(f"unknown filter: {mode}")
    reach, edge = min(200.0, max(1.0, sigma_s)), min(1.0, max(0.01, sigma_r))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        image = np.maximum(np.stack([_grid(frame, c) for c in "rgb"], axis=2), 0) / 255
        out = _at(frame, np.floor(np.clip(domain_filtered(image, reach, edge, mode), 0, 1) * 255 + 0.5).astype(np.int32))
        return frame[["image_id", "x", "y"]].assign(r=out[:, 0], g=out[:, 1], b=out[:, 2])

    kind = pixels.schema["image_id"].dataType.simpleString()
    return pixels.select("image_id", "x", "y", "r", "g", "b").groupBy("image_id").applyInPandas(run, f"image_id {kind}, x int, y int, r int, g int, b int")


def domain_filtered(image: np.ndarray, sigma_s: float, sigma_r: float, mode: str, rounds: int = 3) -> np.ndarray:
    """One image (h, w, 3) in 0..1, filtered along rows and columns in turn, each round with half the reach of the last.
    Distances along a line grow with the change of colour, so that means do not reach across edges."""
    steps = []
    for axis in (0, 1):
        change = np.abs(np.diff(image, axis=axis)).sum(axis=2)
        steps.append(np.pad(1 + sigma_s / sigma_r * change, [(1, 0) if a == axis else (0, 0) for a in (0, 1)], constant_values=1.0))
    out = image
    for i in range(rounds):
        sigma = sigma_s * np.sqrt(3) * 2.0 ** (rounds - 1 - i) / np.sqrt(4.0**rounds - 1)
        for axis in (1, 0):
            lines, d = (out, steps[1]) if axis else (out.transpose(1, 0, 2), steps[0].T)
            lines = _swept(lines, np.exp(-np.sqrt(2) / sigma) ** d) if mode == "recurs" else _box_means(lines, np.cumsum(d, axis=1), sigma * np.sqrt(3))
            out = lines if axis else lines.transpose(1, 0, 2)
    return out


def _swept(lines: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """Each pixel takes ``keep`` of what its neighbour has beyond it, from left to right and back."""
    out = lines.copy()
    for x in range(1, out.shape[1]):
        out[:, x] += keep[:, x, None] * (out[:, x - 1] - out[:, x])
    for x in range(out.shape[1] - 2, -1, -1):
        out[:, x] += keep[:, x + 1, None] * (out[:, x + 1] - out[:, x])
    return out


def _box_means(lines: np.ndarray, place: np.ndarray, radius: float) -> np.ndarray:
    """Means of the pixels of a line whose places are within the radius."""
    out = np.empty_like(lines)
    for y, at in enumerate(place):
        low, high = np.searchsorted(at, at - radius), np.searchsorted(at, at + radius, "right")
        total = np.vstack([np.zeros(lines.shape[2]), np.cumsum(lines[y], axis=0)])
        out[y] = (total[high] - total[low]) / (high - low)[:, None]
    return out


def _linked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each of n nodes' components over links (a, b): hooks and pointer jumps."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        if (low == high).all():
            return root
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]


def labelled(paint: np.ndarray) -> np.ndarray:
    """4-connected areas of equal paint (h, w): each pixel's least pixel number in its area."""
    at = np.arange(paint.size).reshape(paint.shape)
    right, down = paint[:, :-1] == paint[:, 1:], paint[:-1] == paint[1:]
    a = np.concatenate([at[:, :-1][right], at[:-1][down]])
    b = np.concatenate([at[:, 1:][right], at[1:][down]])
    return _linked(paint.size, a, b).reshape(paint.shape)


def _grid(frame: pd.DataFrame, column: str) -> np.ndarray:
    """A column as an array (h, w); -1 where a pixel is missing. Larger images than MOST_PIXELS are an error: they are
    to be brought to their working size first (grid.to_work_size)."""
    if (int(frame["y"].max()) + 1) * (int(frame["x"].max()) + 1) > MOST_PIXELS:
        raise ValueError(f"an image has over {MOST_PIXELS} pixels")
    out = np.full((int(frame["y"].max()) + 1, int(frame["x"].max()) + 1), -1, np.int64)
    out[frame["y"], frame["x"]] = frame[column]
    return out


def _at(frame: pd.DataFrame, grid: np.ndarray) -> np.ndarray:
    return grid[frame["y"], frame["x"]]


def facets(pixels: DataFrame) -> DataFrame:
    """pixels (image_id, x, y, chip_idx) plus facet_id: 4-connected areas of one paint, numbered by their first pixel
    (y * width + x). Images may have any size: each is labelled tile by tile, and only what meets at a tile's border is
    joined. Images of one tile need nothing more."""
    kind = pixels.schema["image_id"].dataType.simpleString()
    own = pixels.select("image_id", "x", "y", "chip_idx")
    sizes = checkpoint(own.groupBy("image_id").agg((F.max("x") + 1).cast("long").alias("__w"), (F.max("y") + 1).alias("__h")))
    tile = lambda c: F.floor(F.col(c) / TILE).cast("int")

    def label(frame: pd.DataFrame) -> pd.DataFrame:
        y, x, width = frame["y"] - frame["y"].min(), frame["x"] - frame["x"].min(), int(frame["__w"].iloc[0])
        paint = np.full((int(y.max()) + 1, int(x.max()) + 1), -1, np.int64)
        paint[y, x] = frame["chip_idx"]
        first_y, first_x = np.divmod(labelled(paint)[y, x], paint.shape[1])
        number = (first_y + int(frame["y"].min())) * width + first_x + int(frame["x"].min())
        return frame[["image_id", "x", "y", "chip_idx"]].assign(facet_id=number)

    tiles = own.join(sizes, "image_id").groupBy("image_id", tile("y").alias("ty"), tile("x").alias("tx"))
    parts = tiles.applyInPandas(label, f"image_id {kind}, x int, y int, chip_idx int, facet_id long")
    if sizes.filter((F.col("__w") > TILE) | (F.col("__h") > TILE)).isEmpty():
        return parts
    parts = checkpoint(parts)
    roots = _border_roots(parts, kind).withColumnRenamed("part", "facet_id")
    return parts.join(roots, ["image_id", "facet_id"], "left").select("image_id", "x", "y", "chip_idx", F.coalesce("root", "facet_id").alias("facet_id"))


def _border_roots(parts: DataFrame, kind: str) -> DataFrame:
    """(image_id, part, root): of areas that touch areas of the same paint in other tiles, the least of all they reach.

    Border pixels meet the pixel beyond the border by its place. The links of an image, each once, are one group: no
    more than its tiles have border pixels, which is 4 / TILE of its pixels, and far fewer where areas are large."""
    place = lambda side, x, y: F.struct(F.lit(side).alias("side"), x.alias("x"), y.alias("y"))
    x, y = F.col("x"), F.col("y")
    low = F.array_compact(F.array(F.when(x % TILE == TILE - 1, place(0, x + 1, y)), F.when(y % TILE == TILE - 1, place(1, x, y + 1))))
    high = F.array_compact(F.array(F.when(x % TILE == 0, place(0, x, y)), F.when(y % TILE == 0, place(1, x, y))))
    ends = [parts.select("image_id", "chip_idx", F.col("facet_id").alias(n), F.explode(e).alias("at")).select("image_id", "chip_idx", n, "at.*") for n, e in (("a", low), ("b", high))]
    links = ends[0].join(ends[1], ["image_id", "chip_idx", "side", "x", "y"]).select("image_id", "a", "b").distinct()

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        known, place = np.unique(frame[["a", "b"]].to_numpy().T.ravel(), return_inverse=True)
        a, b = np.split(place, 2)
        return pd.DataFrame({"image_id": frame["image_id"].iloc[0], "part": known, "root": known[_linked(len(known), a, b)]})

    return links.groupBy("image_id").applyInPandas(join, f"image_id {kind}, part long, root long")


def facet_stats(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("image_id", "facet_id", "chip_idx").agg(F.count("*").alias("area"))


def _by_tile(pixels: DataFrame, halo: int, run: Callable[[np.ndarray, np.ndarray, np.ndarray, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """run(labels, y, x, own) on each tile of pixels (image_id, x, y, facet_id): the facet numbers of the tile and its halo
    as an array (-1: no pixel), and the places in it of the tile's own pixels and their rows. Pixels are shuffled once;
    a facet's number is not negative."""

    def on_tile(frame: pd.DataFrame) -> pd.DataFrame:
        y, x = (frame[c].to_numpy() - frame[c].min() + halo for c in "yx")
        labels = np.full((int(y.max()) + 1 + halo, int(x.max()) + 1 + halo), -1, np.int64)
        labels[y, x] = frame["facet_id"]
        own = ((frame["y"] // TILE == frame["ty"]) & (frame["x"] // TILE == frame["tx"])).to_numpy()
        return run(labels, y[own], x[own], frame[own])

    return in_tiles(pixels.select("image_id", "x", "y", "facet_id"), halo).groupBy("image_id", "ty", "tx").applyInPandas(on_tile, schema)


def facet_adjacency(pixels: DataFrame) -> DataFrame:
    """(image_id, a, b): unordered pairs of different facets that share an edge, a < b. A tile gives a pair once."""

    def pairs(labels: np.ndarray, y: np.ndarray, x: np.ndarray, own: pd.DataFrame) -> pd.DataFrame:
        f = labels[y, x]
        both = np.concatenate([np.stack([f, labels[y, x + 1]], axis=1), np.stack([f, labels[y + 1, x]], axis=1)])
        both = np.unique(np.sort(both[(both[:, 1] >= 0) & (both[:, 0] != both[:, 1])], axis=1), axis=0)
        return pd.DataFrame({"image_id": own["image_id"].iloc[:1].repeat(len(both)).to_numpy() if len(own) else [], "a": both[:, 0], "b": both[:, 1]})

    kind = pixels.schema["image_id"].dataType.simpleString()
    return _by_tile(pixels, 1, pairs, f"image_id {kind}, a long, b long").distinct()


def in_tiles(pixels: DataFrame, halo: int) -> DataFrame:
    """pixels plus (ty, tx), the tile of TILE pixels a side in which a row is worked on: its own, and those of which it
    is within ``halo`` pixels. Only pixels near a tile's border are in several."""
    at = lambda c, by: F.floor((F.col(c) + by) / TILE).cast("int")
    rows = pixels.withColumn("ty", F.explode(F.sequence(at("y", -halo), at("y", halo))))
    return rows.withColumn("tx", F.explode(F.sequence(at("x", -halo), at("x", halo))))


def _wide_rows(pixels: DataFrame, radius: float, summed: bool) -> DataFrame:
    """Each pixel, or each facet of each tile, with ``wide``: whether a pixel is at least radius from all boundary. Tiles
    have a halo of the radius and one pixel, by which the boundary is known as far as it counts."""

    def run(labels: np.ndarray, y: np.ndarray, x: np.ndarray, own: pd.DataFrame) -> pd.DataFrame:
        far = boundary_distance(facet_edges(labels) & (labels >= 0))
        rows = own[["image_id", "x", "y", "facet_id"]].assign(wide=far[y, x] >= radius * radius)
        return rows.groupby(["image_id", "facet_id"], as_index=False)["wide"].max() if summed else rows

    kind, label = (pixels.schema[c].dataType.simpleString() for c in ("image_id", "facet_id"))
    schema = f"image_id {kind}, facet_id {label}, wide boolean" if summed else f"image_id {kind}, x int, y int, facet_id {label}, wide boolean"
    return _by_tile(pixels, int(np.ceil(max(0.0, radius))) + 1, run, schema)


def wide_pixels(pixels: DataFrame, radius: float) -> DataFrame:
    """(image_id, x, y, facet_id) of pixels at least ``radius`` from every boundary pixel (exact Euclidean distance): those
    with a 4-neighbour of another facet, or none. Facet numbers are not negative. Work goes by tiles, so an image may have
    any size."""
    return _wide_rows(pixels, radius, False).filter("wide").drop("wide")


def has_width(pixels: DataFrame, radius: float) -> DataFrame:
    """(image_id, facet_id, wide): whether a facet holds a pixel at least ``radius`` from the boundary. As wide_pixels; a
    tile gives one row for each of its facets."""
    return _wide_rows(pixels, radius, True).groupBy("image_id", "facet_id").agg(F.max("wide").alias("wide"))


def min_area(detail: Column, n_pixels: Column, radius: Column) -> Column:
    """Least area of a facet: a share of the image that falls geometrically with detail, the radius's disk at least."""
    d = F.greatest(F.lit(0.0), F.least(F.lit(1.0), detail))
    return F.greatest(F.lit(np.pi) * radius * radius, F.lit(LARGEST_SHARE) * F.pow(F.lit(SMALLEST_SHARE / LARGEST_SHARE), d) * n_pixels)


def _narrow(labels: np.ndarray, radius: float, n: int) -> np.ndarray:
    """Of facets 0..n-1, whether each has no pixel at least ``radius`` from the boundary."""
    return np.bincount(labels[boundary_distance(facet_edges(labels)) >= radius * radius], minlength=n) == 0


def _contacts(labels: np.ndarray) -> np.ndarray:
    """(pairs, 2): each two numbers that share a pixel edge, both ways round."""
    beside = [np.stack([x.ravel(), y.ravel()]) for x, y in ((labels[:, 1:], labels[:, :-1]), (labels[1:], labels[:-1]))]
    x, y = np.concatenate([*beside, *(b[::-1] for b in beside)], axis=1)
    return np.unique(np.stack([x, y], axis=1)[x != y], axis=0)


def merged(paint: np.ndarray, lab: np.ndarray, least: float, radius: float = 0.0) -> np.ndarray:
    """The paint map after small or narrow facets have joined a larger neighbour, round by round.

    paint: (h, w) rows of lab. Facets are contracted in their graph of contacts, which is made once. The order of size
    (ties: the smaller number first) decides who is larger. In a round in which some facet can join one of like
    lightness, only such joins are made, each to the nearest in colour; else unlike ones are."""
    seeds, facet = np.unique(labelled(paint), return_inverse=True)
    facet, n = facet.reshape(paint.shape), len(seeds)
    color_of, size, home, touch = paint.ravel()[seeds], np.bincount(facet.ravel(), minlength=n), np.arange(n), _contacts(facet)
    for _ in range(MERGE_ROUNDS):
        place = np.empty(n, np.int64)
        place[np.lexsort((np.arange(n), -size))] = np.arange(n)  # 0: the largest
        weak = size < least
        if radius > 0:
            weak |= _narrow(home[facet], radius, n)
        way = touch[weak[touch[:, 0]] & (place[touch[:, 0]] > place[touch[:, 1]])]
        if not len(way):
            break
        gap = lab[color_of[way]]
        gap = gap[:, 0] - gap[:, 1]
        like = np.abs(gap[:, 0]) <= LIKE_LIGHTNESS
        if like.any():
            way, gap = way[like], gap[like]
        way = way[np.lexsort((way[:, 1], (gap**2).sum(axis=1)))]
        goes, first = np.unique(way[:, 0], return_index=True)
        step = np.arange(n)
        step[goes] = way[first, 1]
        for _ in range(int(n).bit_length()):  # a chain of joins ends at its largest facet
            step = step[step]
        home, size = step[home], np.bincount(step, weights=size, minlength=n).astype(np.int64)
        touch = np.unique(step[touch], axis=0)
        touch = touch[touch[:, 0] != touch[:, 1]]
    return color_of[home[facet]]


def merge_facets(pixels: DataFrame, palette: DataFrame, least_area: float, radius: float = 0.0) -> DataFrame:
    """(image_id, x, y, chip_idx, facet_id) after merges and a new labelling: facets under the area or narrower than
    the radius are gone where they had a larger neighbour, and neighbours differ in paint.

    One full image is one group; the palette is of checked size."""
    kind = pixels.schema["image_id"].dataType.simpleString()
    return pixels.select("image_id", "x", "y", "chip_idx").groupBy("image_id").applyInPandas(_merging(palette, least_area, radius), f"image_id {kind}, x int, y int, chip_idx int, facet_id long")


def _merging(palette: DataFrame, least_area: float, radius: float):
    """One image's pixels (x, y, chip_idx) -> with chip_idx after merges, and facet_id."""
    from .dither import _palette_arrays

    idx, lab = _palette_arrays(palette)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        grid = _grid(frame, "chip_idx")  # a missing pixel takes the first paint while areas merge
        paint = merged(np.searchsorted(idx, np.maximum(grid, idx[0])), lab, least_area, radius)
        return frame.assign(chip_idx=_at(frame, idx[paint]), facet_id=_at(frame, labelled(np.where(grid < 0, -1, paint))))

    return run


def edge_distance(labels: np.ndarray) -> np.ndarray:
    """Distance of each pixel to the nearest pixel of another facet or outside the image, exact.

    Along a row only the pixel's own run of its facet counts: what lies beyond is farther than the run's end. So each
    run is an envelope of its own, closed by its two ends."""
    h, w = labels.shape
    up = _column_distance(labels)
    starts = np.ones((h, w), bool)
    starts[:, 1:] = labels[:, 1:] != labels[:, :-1]
    first = np.flatnonzero(starts.ravel())
    at, size = np.arange(h * w), np.diff(np.append(first, h * w))
    to_end = np.minimum(at - np.repeat(first, size) + 1, np.repeat(first + size, size) - at)
    return np.sqrt(np.minimum(to_end**2, _envelope(up.ravel() ** 2, first))).reshape(h, w)


def _column_distance(labels: np.ndarray) -> np.ndarray:
    """Steps up or down each pixel's column to another facet or out of the image."""
    h, w = labels.shape
    row = np.arange(h)[:, None]
    change = labels[1:] != labels[:-1]
    top, bottom = np.zeros((h, w), np.int64), np.full((h, w), h - 1, np.int64)
    top[1:] = np.maximum.accumulate(np.where(change, row[1:], 0), axis=0)
    bottom[:-1] = np.minimum.accumulate(np.where(change, row[:-1], h - 1)[::-1], axis=0)[::-1]
    return np.minimum(row - top, bottom - row) + 1


def _envelope(f: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The least (x - y) ** 2 + f[y] over all y of x's run, for each x: a lower envelope of parabolas for each run of f
    (first: where runs begin). f holds whole numbers.

    The best y never falls as x grows. So the first x of a run looks at the whole run, then x in the middle of two that
    are done looks only from the best y of the one to the best y of the other: each halving of the step costs one pass."""
    n = len(f)
    size = np.diff(np.append(first, n))
    run = np.repeat(np.arange(len(first)), size)
    within = np.arange(n) - first[run]
    least, best = np.empty(n, np.int64), np.empty(n, np.int64)
    for step in [0, *(1 << k for k in range(int(size.max()).bit_length() - 1, -1, -1))]:
        x = first if step == 0 else np.flatnonzero(within % (2 * step) == step)
        for k in range(0, len(x), FRONT):  # bounds the memory of a pass
            own = x[k : k + FRONT]
            end = first[run[own]] + size[run[own]] - 1
            low, high = (own, end) if step == 0 else (best[own - step], np.where(own + step <= end, best[np.minimum(own + step, n - 1)], end))
            many = high - low + 1
            cut = np.concatenate([[0], np.cumsum(many)[:-1]])
            y = np.arange(int(many.sum())) + np.repeat(low - cut, many)
            cost = ((np.repeat(own, many) - y) ** 2 + f[y]) * np.int64(n) + y  # the first of equal ones
            won = np.minimum.reduceat(cost, cut)
            least[own], best[own] = won // n, won % n
    return least


def boundary_distance(edge: np.ndarray) -> np.ndarray:
    """Squared distance of each pixel (h, w) to the nearest pixel of ``edge``; over (h + w) ** 2 where there is none."""
    h, w = edge.shape
    row, far = np.arange(h)[:, None], h + w + 1
    last = np.maximum.accumulate(np.where(edge, row, -far), axis=0)
    following = np.minimum.accumulate(np.where(edge, row, h + far)[::-1], axis=0)[::-1]
    return _envelope((np.minimum(row - last, following - row) ** 2).ravel(), np.arange(0, h * w, w)).reshape(h, w)


def facet_edges(labels: np.ndarray) -> np.ndarray:
    """Which pixels (h, w) have a 4-neighbour of another facet, or none."""
    wide = np.pad(labels, 1, constant_values=-1)
    return (labels != wide[:-2, 1:-1]) | (labels != wide[2:, 1:-1]) | (labels != wide[1:-1, :-2]) | (labels != wide[1:-1, 2:])


_REGION = "image_id {kind}, facet_id long, chip_idx int, area long, min_x int, max_x int, min_y int, max_y int, pole_x int, pole_y int, radius double"


def _region_rows(frame: pd.DataFrame) -> pd.DataFrame:
    """One image's pixels (image_id, x, y, chip_idx, facet_id) -> a row for each facet."""
    d = _at(frame, edge_distance(_grid(frame, "facet_id")))
    x, y, chip, facet = (frame[c].to_numpy() for c in ("x", "y", "chip_idx", "facet_id"))
    order = np.lexsort((x, y, -d, chip, facet))  # a facet's pole comes first
    x, y, chip, facet, d = x[order], y[order], chip[order], facet[order], d[order]
    first = np.flatnonzero(np.append(True, (facet[1:] != facet[:-1]) | (chip[1:] != chip[:-1])))
    sides = {f"{way}_{c}": f.reduceat(v, first) for c, v in (("x", x), ("y", y)) for way, f in (("min", np.minimum), ("max", np.maximum))}
    area, image = np.diff(np.append(first, len(x))), frame["image_id"].iloc[0]
    return pd.DataFrame({"image_id": image, "facet_id": facet[first], "chip_idx": chip[first], "area": area, **sides, "pole_x": x[first], "pole_y": y[first], "radius": d[first]})


def regions(pixels: DataFrame) -> DataFrame:
    """(image_id, facet_id, chip_idx, area, min_x, max_x, min_y, max_y, pole_x, pole_y, radius): a row for each facet;
    its pole is the pixel farthest from its boundary (the first in row order). One full image is one group."""
    kind = pixels.schema["image_id"].dataType.simpleString()
    return pixels.select("image_id", "x", "y", "chip_idx", "facet_id").groupBy("image_id").applyInPandas(_region_rows, _REGION.format(kind=kind))


def merged_regions(pixels: DataFrame, palette: DataFrame, least_area: float, radius: float = 0.0) -> DataFrame:
    """regions of merge_facets, in one pass over each image."""
    kind = pixels.schema["image_id"].dataType.simpleString()
    merge = _merging(palette, least_area, radius)
    return pixels.select("image_id", "x", "y", "chip_idx").groupBy("image_id").applyInPandas(lambda frame: _region_rows(merge(frame)), _REGION.format(kind=kind))


def painted_regions(pixels: DataFrame, kept: DataFrame, palette: DataFrame, least_area: float, radius: float = 0.0) -> DataFrame:
    """regions of pixels (image_id, x, y, r, g, b), each snapped to the nearest of its image's kept chips (image_id,
    chip_idx; least index on a tie) in OKLab, after merge_facets: one pass over each image. Images without chips have no
    rows."""
    from .dither import _with_lab

    merge, kind = _merging(palette, least_area, radius), pixels.schema["image_id"].dataType.simpleString()
    chips = kept.select(F.col("image_id").alias("__image"), "chip_idx").join(palette.select("chip_idx", "ok_l", "ok_a", "ok_b"), "chip_idx")
    empty = pd.DataFrame({c.split()[0]: [] for c in _REGION.split(", ")})

    def run(frame: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(frame) or not len(own):
            return empty
        own = own.sort_values("chip_idx")
        lab, idx = own[["ok_l", "ok_a", "ok_b"]].to_numpy(), own["chip_idx"].to_numpy()
        at, near = frame[["__l", "__a", "__b"]].to_numpy(), np.empty(len(frame), np.int32)
        for k in range(0, len(at), 1 << 16):
            near[k : k + (1 << 16)] = idx[np.round(((at[k : k + (1 << 16), None] - lab[None]) ** 2).sum(axis=2), 12).argmin(axis=1)]
        return _region_rows(merge(frame[["image_id", "x", "y"]].assign(chip_idx=near)))

    own = _with_lab(pixels, 1.0).select("image_id", "x", "y", "__l", "__a", "__b")
    return own.groupBy("image_id").cogroup(chips.groupBy("__image")).applyInPandas(run, _REGION.format(kind=kind))


def label_font(min_radius: Column, radius: Column, digits: Column) -> Column:
    """Font size of a region's number: capped by both radii, 24, and the digits' box inside the circle."""
    base = F.when(min_radius > 0, F.least(1.4 * min_radius, F.lit(24.0))).otherwise(F.least(1.4 * radius, F.lit(24.0)))
    return F.least(base, 1.4 * radius, 1.8 * radius / F.hypot(0.6 * F.greatest(F.lit(1), digits), F.lit(1.0)))


def boundary_edges(pixels: DataFrame) -> DataFrame:
    """(image_id, x1, y1, x2, y2, a, b): unit edges between facets, from corner to corner; a lies above or left of b,
    and -1 is outside the image. Each pixel gives its upper and left edge, and a lower or right one where the image ends."""

    def edges(labels: np.ndarray, y: np.ndarray, x: np.ndarray, own: pd.DataFrame) -> pd.DataFrame:
        f, px, py, image = labels[y, x], own["x"].to_numpy(), own["y"].to_numpy(), own["image_id"].to_numpy()
        out = []
        for dy, dx, x1, y1, x2, y2 in ((-1, 0, 0, 0, 1, 0), (0, -1, 0, 0, 0, 1), (1, 0, 0, 1, 1, 1), (0, 1, 1, 0, 1, 1)):
            other = labels[y + dy, x + dx]
            at = (other != f) if dy + dx < 0 else (other < 0)
            a, b = (other[at], f[at]) if dy + dx < 0 else (f[at], other[at])
            out.append(pd.DataFrame({"image_id": image[at], "x1": px[at] + x1, "y1": py[at] + y1, "x2": px[at] + x2, "y2": py[at] + y2, "a": a, "b": b}))
        return pd.concat(out)

    kind = pixels.schema["image_id"].dataType.simpleString()
    return _by_tile(pixels, 1, edges, f"image_id {kind}, x1 int, y1 int, x2 int, y2 int, a long, b long")


def junctions(edges: DataFrame) -> DataFrame:
    """(image_id, x, y, degree): corners where not exactly two edges meet, and the corners of the image."""
    ends = edges.select("image_id", F.explode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("c"))
    degree = ends.groupBy("image_id", "c.x", "c.y").agg(F.count("*").alias("degree"))
    size = edges.groupBy("image_id").agg(F.max("x2").alias("w"), F.max("y2").alias("h"))
    corner = F.col("x").isin(0) | (F.col("x") == F.col("w"))
    corner = corner & ((F.col("y") == 0) | (F.col("y") == F.col("h")))
    return degree.join(size, "image_id").filter((F.col("degree") != 2) | corner).select("image_id", "x", "y", "degree")


def arcs(edges: DataFrame) -> DataFrame:
    """(image_id, arc_id, seq, x, y, a, b): the corners of each arc in order, and the two regions it parts (a < b).

    edges: as boundary_edges gives them. An arc runs from junction to junction, or round a loop that has none; its number
    is that of its first unit edge in the order of (y1, x1, y2, x2). It begins at the junction that comes first in row
    order, a loop at the first corner of its first edge. One image's edges are one group, bounded by its pixels."""
    kind = edges.schema["image_id"].dataType.simpleString()
    own = edges.select("image_id", "x1", "y1", "x2", "y2", "a", "b")
    return own.groupBy("image_id").applyInPandas(_arc_rows, f"image_id {kind}, arc_id int, seq int, x int, y int, a long, b long")


def _arc_rows(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values(["y1", "x1", "y2", "x2"])
    side = int(frame["x2"].max()) + 1
    ends = np.stack([frame["y1"] * side + frame["x1"], frame["y2"] * side + frame["x2"]], axis=1).astype(np.int64)
    n, corners = len(ends), int(ends.max()) + 1
    last_y = int(frame["y2"].max())
    joint = np.bincount(ends.ravel(), minlength=corners) != 2
    joint[[0, side - 1, last_y * side, last_y * side + side - 1]] = True
    # the two edges of every plain corner, by the halves (2 * edge + end) that lie there
    half = np.argsort(ends.ravel(), kind="stable")
    half = half[~joint[ends.ravel()[half]]].reshape(-1, 2)
    beyond = np.full(2 * n, -1)
    beyond[half[:, 0]], beyond[half[:, 1]] = half[:, 1], half[:, 0]
    arc = _linked(n, half[:, 0] // 2, half[:, 1] // 2)
    free = np.flatnonzero(beyond < 0)
    starts = {}
    for h in free[np.argsort(ends.ravel()[free], kind="stable")].tolist():
        starts.setdefault(int(arc[h // 2]), h)  # the first of an arc's ends
    number, seq, at = [], [], []
    for k in np.unique(arc).tolist():
        h = first = starts.get(k, 2 * k)
        points = [int(ends.ravel()[h])]
        while True:
            points.append(int(ends.ravel()[h ^ 1]))  # along the edge to its other end, and over to the next edge
            h = int(beyond[h ^ 1])
            if h < 0 or h == first:
                break
        number += [k] * len(points)
        seq += range(len(points))
        at += points
    at, regions_of = np.array(at), np.sort(frame[["a", "b"]].to_numpy(), axis=1)[number]
    return pd.DataFrame({"image_id": frame["image_id"].iloc[0], "arc_id": number, "seq": seq, "x": at % side, "y": at // side, "a": regions_of[:, 0], "b": regions_of[:, 1]})
