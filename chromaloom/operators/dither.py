"""Palette restriction and dithering of cell grids, each image by itself."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from importlib.resources import files

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import color
from . import palette as pal
from . import regions
from .iterate import stored
from .nearest import ciede2000

DITHER_MODES = ("none", "knoll_yliluoma", "floyd_steinberg", "texture")
MOST_SWAPS = 100
#: Distances that a k-medoids search has in memory at once (64 MB).
TABLE_CELLS = 1 << 23
# Side of the threshold tile, width of its bump, share of first points, seed.
TILE, SIGMA, FIRST_SHARE, SEED = 256, 1.9, 0.1, 1729
#: Stands for a missing cell in an array of chips; cells whose windows are counted at once.
NO_CHIP, TEXTURE_ROWS = -(1 << 62), 1 << 16


def threshold(x: Column, y: Column) -> Column:
    """0..255 by place in a 256 x 256 tile of blue noise, in which each value occurs 256 times: blue_noise_tile. Any other
    pattern can be given to the operators as a table (x, y, v)."""
    place = F.pmod(y.cast("int"), F.lit(TILE)) * TILE + F.pmod(x.cast("int"), F.lit(TILE)) + 1
    return F.conv(F.hex(F.substr(F.lit(bytearray(blue_noise_tile())), place, F.lit(1))), 16, 10).cast("int")


@lru_cache(maxsize=1)
def blue_noise_tile() -> bytes:
    """The stored tile, row by row: what blue_noise() gives (a test makes it anew)."""
    return files(__package__).joinpath("blue_noise.bin").read_bytes()


def blue_noise(size: int = TILE, sigma: float = SIGMA, share: float = FIRST_SHARE, seed: int = SEED) -> np.ndarray:
    """(size, size) thresholds 0..255 without low frequencies, by void and cluster (Ulichney 1993): a table to make once
    and give to dither_ky and texture as rows (x, y, v). Every value stands in as many places as any other, within one."""
    reach = int(np.ceil(4 * sigma))
    near = np.arange(-reach, reach + 1)
    bump = np.exp(-(near[:, None] ** 2 + near[None] ** 2) / (2 * sigma**2))
    n, rng = size * size, np.random.default_rng(seed)
    crowd, on = np.zeros((size, size)), np.zeros(n, bool)

    def put(k: int, sign: int) -> None:
        np.add.at(crowd, np.ix_((k // size + near) % size, (k % size + near) % size), sign * bump)
        on[k] = sign > 0

    def cluster() -> int:
        return int(np.where(on, crowd.ravel(), -np.inf).argmax())

    def void() -> int:
        return int(np.where(on, np.inf, crowd.ravel()).argmin())

    for k in rng.choice(n, max(1, int(n * share)), replace=False):
        put(int(k), 1)
    for _ in range(n):  # even the first points out, until the one that is lifted falls back into its own place
        k = cluster()
        put(k, -1)
        to = void()
        put(to, 1)
        if to == k:
            break
    rank, start, had = np.empty(n, np.int64), crowd.copy(), on.copy()
    for i in range(int(on.sum()) - 1, -1, -1):
        k = cluster()
        rank[k] = i
        put(k, -1)
    crowd[:], on[:] = start, had
    for i in range(int(on.sum()), n):
        k = void()
        rank[k] = i
        put(k, 1)
    return (rank * 256 // n).reshape(size, size)


def _with_threshold(cells: DataFrame, lut: DataFrame | None, how: str = "inner") -> DataFrame:
    """cells plus __t. A table of thresholds has 65,536 rows and is broadcast."""
    if lut is None:
        return cells.withColumn("__t", threshold(F.col("cx"), F.col("cy")))
    tile = lut.select(F.col("x").alias("__x"), F.col("y").alias("__y"), F.col("v").alias("__t")).filter("__x between 0 and 255 and __y between 0 and 255").dropDuplicates(["__x", "__y"])
    return cells.join(F.broadcast(tile), (F.pmod("cx", F.lit(256)) == F.col("__x")) & (F.pmod("cy", F.lit(256)) == F.col("__y")), how).drop("__x", "__y")


def _palette_arrays(palette: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    chips = pal.palette_rows(palette, ["chip_idx", "ok_l", "ok_a", "ok_b"])
    return chips["chip_idx"].to_numpy(np.int32), chips[["ok_l", "ok_a", "ok_b"]].to_numpy(np.float64)


def _with_lab(cells: DataFrame, chroma_scale: float) -> DataFrame:
    lab = color.rgb_to_oklab(F.col("r"), F.col("g"), F.col("b"))
    if chroma_scale != 1.0:
        lab = color.adjust_oklab(*lab, F.lit(0.0), F.lit(0.0), F.lit(float(chroma_scale)))
    return cells.withColumns(dict(zip(("__l", "__a", "__b"), lab, strict=True)))


def ky_candidates(target: np.ndarray, lab: np.ndarray, n: int) -> np.ndarray:
    """(rows, n) chip places: each pick brings the running mean nearest the target; sorted by lightness, stably."""
    total, out = np.zeros_like(target), np.empty((len(target), n), np.int64)
    for i in range(1, n + 1):
        want = target * i - total
        out[:, i - 1] = ((lab[None] - want[:, None]) ** 2).sum(axis=2).argmin(axis=1)
        total += lab[out[:, i - 1]]
    return np.take_along_axis(out, np.argsort(lab[out, 0], axis=1, kind="stable"), 1)


def dither_ky(cells: DataFrame, palette: DataFrame, n: int, chroma_scale: float = 1.0, lut: DataFrame | None = None) -> DataFrame:
    """cells plus chip_idx by Knoll-Yliluoma: of n candidates of the cell's colour, the one its place picks."""
    if n < 1:
        raise ValueError("at least one candidate")
    idx, lab = _palette_arrays(palette)

    @F.pandas_udf("array<int>")
    def candidates(l: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        own, out = np.stack([l, a, b], axis=1), []
        for at in range(0, len(own), 256):
            out.extend(idx[ky_candidates(own[at : at + 256], lab, n)])
        return pd.Series(out)

    colors = _with_lab(cells.select("r", "g", "b").distinct(), chroma_scale)
    colors = colors.select("r", "g", "b", candidates("__l", "__a", "__b").alias("__c"))
    out = _with_threshold(cells, lut).join(colors, ["r", "g", "b"])
    return out.withColumn("chip_idx", F.get("__c", F.floor(F.col("__t") * n / 256).cast("int"))).drop("__t", "__c")


def diffused(target: np.ndarray, lab: np.ndarray) -> np.ndarray:
    """Floyd-Steinberg over one grid (h, w, 3): chip places. Errors off the grid are dropped.

    A cell needs the errors of its left neighbour and of three cells above, so all cells with one x + 2 y are free at
    the same time: w + 2 h steps, each over a whole front. A cell's errors are added in the order of a scan by rows
    (above left, above, above right, left), so that the sums are the scan's to the last bit."""
    h, w, _ = target.shape
    row = w + 2
    work, out = np.zeros(((h + 1) * row, 3)), np.zeros((h + 1) * row, np.int64)
    work.reshape(h + 1, row, 3)[:h, 1 : w + 1] = target
    most = max(1, TABLE_CELLS // 4 // len(lab))
    for t in range(w + 2 * h - 2):
        low, high = max(0, (t - w + 2) // 2), min(h - 1, t // 2)  # rows of the front; the next one is row - 2 on
        for y in range(low, high + 1, most):
            n = min(most, high + 1 - y)
            first = y * row + t - 2 * y + 1
            front = lambda step: slice(first + step, first + step + (n - 1) * (row - 2) + 1, row - 2)  # noqa: B023, E731
            own = work[front(0)]
            best = sum((lab[None, :, c] - own[:, None, c]) ** 2 for c in range(3)).argmin(axis=1)
            out[front(0)] = best
            error = (own - lab[best]) / 16.0
            work[front(row - 1)] += 3 * error
            work[front(row)] += 5 * error
            work[front(row + 1)] += 1 * error
            work[front(1)] += 7 * error
    return out.reshape(h + 1, row)[:h, 1 : w + 1]


def dither_fs(cells: DataFrame, palette: DataFrame, chroma_scale: float = 1.0) -> DataFrame:
    """(image_id, cx, cy, chip_idx) by error diffusion in OKLab: in scan order inside an image, images in parallel.

    An image's cells are a full grid, one row a cell."""
    idx, lab = _palette_arrays(palette)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["cy", "cx"])
        w = int(frame["cx"].max()) + 1
        grid = frame[["__l", "__a", "__b"]].to_numpy().reshape(-1, w, 3)
        return frame[["image_id", "cx", "cy"]].assign(chip_idx=idx[diffused(grid, lab)].ravel())

    own = _with_lab(cells, chroma_scale).select("image_id", "cx", "cy", "__l", "__a", "__b")
    kind = cells.schema["image_id"].dataType.simpleString()
    return own.groupBy("image_id").applyInPandas(run, f"image_id {kind}, cx int, cy int, chip_idx int")


def texture(cells: DataFrame, strength: float, lut: DataFrame | None = None) -> DataFrame:
    """(image_id, cx, cy, chip_idx): inner cells give way to the commonest other chip of their 5 x 5 window.

    A cell gives way where threshold / 255 < strength * (equal neighbours / 8) ** 3; ties go to the chip seen first in
    row order. Cells are shuffled once, to the tiles they are in or near. A strength of 0 or less changes nothing."""
    own, side = cells.select("image_id", "cx", "cy", "chip_idx"), regions.TILE
    if strength <= 0:
        return own

    def on_tile(frame: pd.DataFrame) -> pd.DataFrame:
        y, x = (frame[c].to_numpy() - frame[c].min() + 2 for c in "yx")
        paint = np.full((int(y.max()) + 3, int(x.max()) + 3), NO_CHIP, np.int64)
        paint[y, x] = frame["chip_idx"].fillna(NO_CHIP)
        mine = ((frame["y"] // side == frame["ty"]) & (frame["x"] // side == frame["tx"])).to_numpy()
        chips = textured(paint, y[mine], x[mine], frame["__t"].to_numpy(np.float64)[mine], strength)
        out = frame.loc[mine, ["image_id", "x", "y"]].set_axis(["image_id", "cx", "cy"], axis=1)
        return out.assign(chip_idx=pd.arrays.IntegerArray(chips, chips == NO_CHIP))

    rows = _with_threshold(own, lut, "left").withColumnsRenamed({"cx": "x", "cy": "y"})
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema.fields)
    return regions.in_tiles(rows, 2).groupBy("image_id", "ty", "tx").applyInPandas(on_tile, schema)


def textured(paint: np.ndarray, y: np.ndarray, x: np.ndarray, t: np.ndarray, strength: float) -> np.ndarray:
    """The chips at places (y, x) of paint, none of them within two of its border, after those of threshold t that are to
    give way have done so. NO_CHIP has no part in it, and a threshold that is missing keeps its cell."""
    around = lambda y, x, reach: (paint[y + dy, x + dx] for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1) if dx or dy)
    out = paint[y, x]
    same = sum((other == out).astype(np.int64) for other in around(y, x, 1))
    gives = np.flatnonzero((t / 255.0 < strength * np.power(same / 8.0, 3.0)) & (out != NO_CHIP))
    for at in range(0, len(gives), TEXTURE_ROWS):
        k = gives[at : at + TEXTURE_ROWS]
        others = np.stack(list(around(y[k], x[k], 2)), axis=1)
        votes = np.stack([(others == other[:, None]).sum(axis=1) for other in others.T], axis=1)
        votes[(others == out[k, None]) | (others == NO_CHIP)] = 0
        best = votes.argmax(axis=1)[:, None]
        won = np.take_along_axis(votes, best, 1)[:, 0] > 0
        out[k[won]] = np.take_along_axis(others, best, 1)[won, 0]
    return out


def medoids(distances: Callable[[slice], np.ndarray], w: np.ndarray, k: int, m: int, most: int = MOST_SWAPS) -> np.ndarray:
    """Weighted k-medoids among m candidates: medoids join one by one, each where all points' cost falls most; then the
    best exchange of a medoid for another candidate is made while it lowers the cost (``most`` times at most).

    distances gives the distances of a slice of points to all candidates. Points are taken in blocks, so memory is
    bounded whatever their number. One table serves both steps: the cost if a candidate joins and, for each medoid,
    what its own points lose if it goes (Schubert and Rousseeuw 2019). Ties go to the earlier medoid, then the lower
    candidate."""
    n = len(w)
    blocks = [slice(at, at + max(1, TABLE_CELLS // m)) for at in range(0, n, max(1, TABLE_CELLS // m))]
    kept = distances(blocks[0]) if len(blocks) == 1 else None  # a single block is computed once
    of = (lambda s: kept) if kept is not None else distances
    chosen, changes = np.zeros(0, np.int64), 0
    first, second, owner = np.full(n, np.inf), np.full(n, np.inf), np.zeros(n, np.int64)
    while len(chosen) < k or changes < most:
        full = len(chosen) == k
        joins, leaves = np.zeros(m), np.zeros((k, m))
        for s in blocks:
            d = of(s)
            own = np.minimum(first[s, None], d)
            joins += w[s] @ own
            if full:
                np.add.at(leaves, owner[s], w[s, None] * (np.minimum(second[s, None], d) - own))
        joins[chosen] = np.inf
        if full:
            place, candidate = np.unravel_index((joins + leaves).argmin(), leaves.shape)
            if not (joins + leaves)[place, candidate] < w @ first - 1e-12:
                break
            chosen[place], changes = candidate, changes + 1
        else:
            chosen = np.append(chosen, joins.argmin())
        for s in blocks:
            d = of(s)[:, chosen]
            order = np.argsort(d, axis=1, kind="stable")[:, :2]
            owner[s], first[s] = order[:, 0], np.take_along_axis(d, order[:, :1], 1)[:, 0]
            if len(chosen) > 1:
                second[s] = np.take_along_axis(d, order[:, 1:], 1)[:, 0]
    return np.sort(chosen)


def restrict_pam(cells: DataFrame, palette: DataFrame, k: int | None, metric: str = "oklab") -> DataFrame:
    """(image_id, chip_idx): the k chips of each image that lie nearest its colours, as weighted k-medoids.

    All chips where k is null, not over 0, or not under their number. Works on an image's colour histogram."""
    idx, lab = _palette_arrays(palette)
    images = cells.select("image_id").distinct()
    if k is None or k <= 0 or k >= len(idx):
        return images.crossJoin(F.broadcast(palette.select("chip_idx")))
    if metric not in ("oklab", "ciede2000"):
        raise ValueError(f"unknown distance metric: {metric}")
    hist = pal.color_histogram(cells)
    kind = cells.schema["image_id"].dataType.simpleString()
    if metric == "oklab":
        own = _with_lab(hist, 1.0).select("image_id", "n", "r", "g", "b", F.array("__l", "__a", "__b").alias("v"))
    else:
        lab = pal.with_lab(palette, ("l", "a", "bb")).orderBy("chip_idx").select("l", "a", "bb").toPandas().to_numpy(np.float64)
        own = pal.with_lab(hist, ("l1", "a1", "b1")).select("image_id", "n", "r", "g", "b", F.array("l1", "a1", "b1").alias("v"))

    def to_all(v: np.ndarray) -> np.ndarray:
        """Distances of colours to all chips."""
        if metric == "oklab":
            return ((v[:, None] - lab[None]) ** 2).sum(axis=2)
        return ciede2000(np.repeat(v, len(lab), axis=0), np.tile(lab, (len(v), 1))).reshape(len(v), len(lab))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["r", "g", "b"])
        v = np.array(frame["v"].tolist(), np.float64)
        return pd.DataFrame({"image_id": frame["image_id"].iloc[0], "chip_idx": idx[medoids(lambda s: to_all(v[s]), frame["n"].to_numpy(np.float64), k, len(idx))]})

    return own.groupBy("image_id").applyInPandas(run, f"image_id {kind}, chip_idx int")


def snap_kept(cells: DataFrame, kept: DataFrame, palette: DataFrame) -> DataFrame:
    """cells plus chip_idx, the nearest of the image's own kept chips in OKLab (least index on a tie)."""
    chips = kept.join(palette.select("chip_idx", "ok_l", "ok_a", "ok_b"), "chip_idx").withColumnRenamed("image_id", "__i")
    colors = _with_lab(cells.select("image_id", "r", "g", "b").distinct(), 1.0)
    pairs = colors.join(chips, F.col("image_id") == F.col("__i"))
    d = F.pow(F.col("__l") - F.col("ok_l"), F.lit(2.0)) + F.pow(F.col("__a") - F.col("ok_a"), F.lit(2.0)) + F.pow(F.col("__b") - F.col("ok_b"), F.lit(2.0))
    best = pairs.groupBy("image_id", "r", "g", "b").agg(F.min(F.struct(F.round(d, 12).alias("d"), F.col("chip_idx").alias("i"))).alias("best"))
    return cells.join(best.select("image_id", "r", "g", "b", F.col("best.i").alias("chip_idx")), ["image_id", "r", "g", "b"])


def map_cells(cells: DataFrame, palette: DataFrame, mode: str = "none", strength: float = 0.5, metric: str = "oklab", chroma_scale: float = 1.0, lut: DataFrame | None = None) -> DataFrame:
    """(image_id, cx, cy, chip_idx) by the named dither mode and metric; unknown names are errors."""
    if mode not in DITHER_MODES:
        raise ValueError(f"unknown dither mode: {mode}")
    if metric not in ("oklab", "ciede2000"):
        raise ValueError(f"unknown distance metric: {metric}")
    if mode == "knoll_yliluoma":
        n = 2 if strength <= 0.375 else 4 if strength <= 0.625 else 8 if strength <= 0.875 else 16
        return dither_ky(cells, palette, n, chroma_scale, lut).select("image_id", "cx", "cy", "chip_idx")
    if mode == "floyd_steinberg":
        return dither_fs(cells, palette, chroma_scale)
    out = pal.snap(cells, palette, metric, chroma_scale).select("image_id", "cx", "cy", "chip_idx")
    return texture(out, strength, lut) if mode == "texture" else out


def select_paints(pixels: DataFrame, palette: DataFrame, k: int, restriction: str = "top_n") -> DataFrame:
    """(image_id, chip_idx): at most k paints of each image (two at least are allowed), from all of its pixels: each
    distinct colour is snapped once and chips are counted before they are shuffled."""
    if restriction not in ("top_n", "pam"):
        raise ValueError(f"unknown restriction: {restriction}")
    snapped = pal.snap_oklab(pixels, palette)
    if restriction == "top_n":
        return pal.top_n_chips(pal.chip_histogram(snapped), max(2, k)).select("image_id", "chip_idx")
    chips = palette.select("chip_idx", *(F.col(c).alias(f"p{c}") for c in "rgb"))
    painted = snapped.drop("r", "g", "b").join(chips, "chip_idx").select("image_id", *(F.col(f"p{c}").alias(c) for c in "rgb"))
    return restrict_pam(painted, palette, max(2, k))


#: OKLab as whole numbers from 0 on: parts of one, and what is added to a and b.
MICRO, SHIFT = 1_000_000, 2_000_000
#: Centres that are told apart, each by its row in every task.
MOST_CENTRES = 1024


def kmeans_colors(pixels: DataFrame, k: int, rounds: int = 15) -> DataFrame:
    """(cluster, ok_l, ok_a, ok_b): k-means centres of the corpus's colours in OKLab, weighted by their pixels.

    The first centre is the commonest colour (the least r, g, b on a tie), each other the colour farthest from all so
    far; then at most ``rounds`` rounds of means. Colours, at most 256 ** 3, are counted once and stored in the shared
    folder; a round is one aggregation of them, of which k rows come to the driver. Places are whole millionths, so sums
    are exact and the result does not depend on how rows are dealt. A centre without colours stays where it is; fewer
    colours than k give fewer centres, no pixels none."""
    if not 1 <= k <= MOST_CENTRES:
        raise ValueError(f"k is 1 to {MOST_CENTRES}")
    place = lambda c, add: F.floor(F.col(c) * float(MICRO) + 0.5).cast("long") + add
    counted = _with_lab(pixels.groupBy("r", "g", "b").agg(F.count("*").alias("n")), 1.0)
    colors = stored(counted.select("r", "g", "b", "n", place("__l", 0).alias("l"), place("__a", SHIFT).alias("a"), place("__b", SHIFT).alias("bb")))

    centres = [tuple(r) for r in colors.orderBy(F.desc("n"), "r", "g", "b").select("l", "a", "bb").limit(1).collect()]
    while 0 < len(centres) < k:
        far = colors.withColumn("far", _to_centres(centres, "min")).filter("far > 0").orderBy(F.desc("far"), "r", "g", "b").select("l", "a", "bb").limit(1).collect()
        if not far:
            break
        centres.append(tuple(far[0]))
    # sums of products as those of their upper and lower 32 bits, which do not leave 64 bits
    halves = {c: (F.col("n") * F.col(c), f"{c}_high", f"{c}_low") for c in ("l", "a", "bb")}
    total = [F.sum(e).alias(n) for p, high, low in halves.values() for e, n in ((F.shiftright(p, 32), high), (p.bitwiseAND(F.lit((1 << 32) - 1)), low))]
    for _ in range(rounds if centres else 0):
        sums = colors.withColumn("i", _to_centres(centres, "argmin")).groupBy("i").agg(F.sum("n").alias("w"), *total).collect()
        moved = list(centres)
        for s in sums:
            moved[s["i"]] = tuple((2 * ((s[high] << 32) + s[low]) + s["w"]) // (2 * s["w"]) for _, high, low in halves.values())
        if moved == centres:
            break
        centres = moved
    rows = [(i, l / MICRO, (a - SHIFT) / MICRO, (b - SHIFT) / MICRO) for i, (l, a, b) in enumerate(centres)]
    return pixels.sparkSession.createDataFrame(rows, "cluster int, ok_l double, ok_a double, ok_b double")


def _to_centres(centres: list[tuple], what: str) -> Column:
    """Of the squared distances of a colour (l, a, bb) to the centres the least (min) or its place (argmin, the first)."""
    at = np.array(centres, np.int64)

    @F.pandas_udf("long")
    def nearest(l: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        own, out, step = np.stack([l, a, b], axis=1), np.empty(len(l), np.int64), max(1, (1 << 20) // len(at))
        for k in range(0, len(own), step):
            out[k : k + step] = getattr(sum((own[k : k + step, c, None] - at[:, c]) ** 2 for c in range(3)), what)(axis=1)
        return pd.Series(out)

    return nearest("l", "a", "bb")
