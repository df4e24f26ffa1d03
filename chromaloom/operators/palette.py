"""Palettes: loading, nearest chips, reduction to few chips, naming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import color
from .iterate import numbered
from .nearest import ChipTree

#: A palette is sent to every task; more chips than this are refused.
MOST_CHIPS = 100_000


def with_oklab(chips: DataFrame) -> DataFrame:
    """Add ok_l, ok_a and ok_b to a table with r, g and b."""
    return chips.withColumns(dict(zip(("ok_l", "ok_a", "ok_b"), color.rgb_to_oklab(F.col("r"), F.col("g"), F.col("b")), strict=True)))


def load_palette(munsell: DataFrame, grays: DataFrame, mode: str = "color", tier: int = 512) -> DataFrame:
    """The chips in play: in colour the first ``tier`` by chip_idx and then all grays; in bw the grays alone.

    chip_idx is numbered anew from 0, colours first. A mode without chips is an error when the rows are read.
    """
    if mode not in ("color", "bw"):
        raise ValueError(f"unknown colour mode: {mode}")
    tagged = grays.withColumn("__part", F.lit(1))
    if mode == "color":
        tagged = munsell.filter(F.col("chip_idx") < tier).withColumn("__part", F.lit(0)).unionByName(tagged)
    done = numbered(tagged, ["__part", "chip_idx"], "__place")
    return done.withColumn("chip_idx", (F.col("__place") - 1).cast("int")).drop("__part", "__place")


def checked_palette(palette: DataFrame) -> DataFrame:
    """The palette itself, after a count: none or too many chips are errors. A held palette has been counted."""
    if _held(palette) is None:
        n = palette.limit(MOST_CHIPS + 1).count()
        if not 1 <= n <= MOST_CHIPS:
            raise ValueError(f"a palette has 1 to {MOST_CHIPS} chips")
    return palette


def held_palette(palette: DataFrame) -> DataFrame:
    """A checked palette read once: its rows, at most MOST_CHIPS, come to the driver, and later uses cost no scan."""
    rows = palette.limit(MOST_CHIPS + 1).toPandas()
    if not 1 <= len(rows) <= MOST_CHIPS:
        raise ValueError(f"a palette has 1 to {MOST_CHIPS} chips")
    out = palette.sparkSession.createDataFrame(rows, palette.schema)
    out._held_rows = rows
    return out


def _held(palette: DataFrame) -> pd.DataFrame | None:
    return getattr(palette, "_held_rows", None)


def palette_rows(palette: DataFrame, columns: list[str]) -> pd.DataFrame:
    """Columns of a checked palette in the order of chip_idx, at the driver."""
    rows = _held(palette)
    if rows is None:
        rows = checked_palette(palette).select(*columns).toPandas()
    return rows[columns].sort_values("chip_idx").reset_index(drop=True)


def apply_filters(pixels: DataFrame, filters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pixels with their image's filter applied, and the filter rows refused for an unknown type.

    An image without a filter keeps its pixels; one whose filter is refused has none in the output."""
    known = F.coalesce(F.col("filter_type").isin(*color.FILTER_TYPES), F.lit(False))
    joined = pixels.join(filters.select("image_id", "filter_type", F.lit(True).alias("__asked")), "image_id", "left")
    joined = joined.filter(F.col("__asked").isNull() | known)
    done = color.apply_filter(F.col("filter_type"), F.col("r"), F.col("g"), F.col("b"))
    out = joined.withColumn("__v", done).select(*(F.coalesce(F.col(f"__v.{c}"), F.col(c)).alias(c) if c in "rgb" else F.col(c) for c in pixels.columns))
    return out, filters.filter(~known)


def _search(palette: DataFrame, metric: str) -> Callable[..., Column]:
    """A function of a colour's three columns, OKLab or Lab by the metric, that gives its nearest chip (least index on a
    tie). The chips of a checked palette, as a tree, go to every task that asks."""
    if metric == "ciede2000":
        chips = with_lab(checked_palette(palette), ("l", "a", "bb")).select("chip_idx", "l", "a", "bb").toPandas()
    else:
        chips = palette_rows(palette, ["chip_idx", "ok_l", "ok_a", "ok_b"])
    tree = ChipTree(chips["chip_idx"].to_numpy(np.int64), chips.iloc[:, 1:].to_numpy(np.float64), "ciede2000" if metric == "ciede2000" else "squared")

    @F.pandas_udf("int")
    def nearest(l: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(tree.nearest(np.stack([l, a, b], axis=1).astype(np.float64)).astype(np.int32))

    return nearest


def snap_oklab(cells: DataFrame, palette: DataFrame, chroma_scale: float = 1.0) -> DataFrame:
    """cells (r, g, b) plus chip_idx: the nearest chip by squared OKLab distance, the least index on a tie.

    Distances are rounded at the twelfth place, so that ties are ties. Colours are made distinct first: at
    most 256 ** 3, and far fewer, are looked up in a tree of the chips.
    """
    nearest = _search(palette, "oklab")
    lab_of = color.rgb_to_oklab(F.col("r"), F.col("g"), F.col("b"))
    if chroma_scale != 1.0:
        lab_of = color.adjust_oklab(*lab_of, F.lit(0.0), F.lit(0.0), F.lit(float(chroma_scale)))
    colors = cells.select("r", "g", "b").distinct().select("r", "g", "b", nearest(*lab_of).alias("chip_idx"))
    return cells.join(colors, ["r", "g", "b"])


def with_lab(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """df (r, g, b) plus its CIE Lab under three names."""
    return df.withColumns(dict(zip(names, color.rgb_to_lab(F.col("r"), F.col("g"), F.col("b")), strict=True)))


def snap_ciede2000(cells: DataFrame, palette: DataFrame) -> DataFrame:
    """As snap_oklab by CIEDE2000: a lower bound of the difference cuts the tree of the chips, and the whole formula is for
    what is left of it."""
    nearest = _search(palette, "ciede2000")
    colors = cells.select("r", "g", "b").distinct().select("r", "g", "b", nearest(*color.rgb_to_lab(F.col("r"), F.col("g"), F.col("b"))).alias("chip_idx"))
    return cells.join(colors, ["r", "g", "b"])


def snap(cells: DataFrame, palette: DataFrame, metric: str = "oklab", chroma_scale: float = 1.0) -> DataFrame:
    """Either metric; the chroma boost is for OKLab alone."""
    if metric == "oklab":
        return snap_oklab(cells, palette, chroma_scale)
    if metric == "ciede2000":
        return snap_ciede2000(cells, palette)
    raise ValueError(f"unknown distance metric: {metric}")


def lookup_chip(cells: DataFrame, palette: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells of a chip's exact colour with chip_idx; the other cells). Of chips with one colour the least index."""
    chips = palette.groupBy(color.pack_rgb(F.col("r"), F.col("g"), F.col("b")).alias("__rgb")).agg(F.min("chip_idx").alias("chip_idx"))
    keyed = cells.withColumn("__rgb", color.pack_rgb(F.col("r"), F.col("g"), F.col("b")))
    return keyed.join(chips, "__rgb").drop("__rgb"), keyed.join(chips, "__rgb", "left_anti").drop("__rgb")


def color_histogram(cells: DataFrame) -> DataFrame:
    return cells.groupBy("image_id", "r", "g", "b").agg(F.count("*").alias("n"))


def chip_histogram(cells: DataFrame) -> DataFrame:
    return cells.groupBy("image_id", "chip_idx").agg(F.count("*").alias("n"))


def top_n_chips(hist: DataFrame, n: int | None) -> DataFrame:
    """(image_id, chip_idx, n) of the n most used chips of each image, smaller indexes first on a tie; all of
    them where n is null or not over 0."""
    if n is None or n <= 0:
        return hist
    place = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("n"), "chip_idx"))
    return hist.withColumn("__rank", place).filter(F.col("__rank") <= n).drop("__rank")


def resnap(hist: DataFrame, kept: DataFrame, palette: DataFrame, metric: str = "oklab") -> DataFrame:
    """(image_id, chip_idx, new_idx): each used chip's nearest kept chip of the same image; kept chips are their own.

    Works on an image's few chips, never on its cells."""
    chips = palette.select("chip_idx", "r", "g", "b", "ok_l", "ok_a", "ok_b")
    own = hist.select("image_id", "chip_idx").join(chips, "chip_idx")
    other = kept.select("image_id", "chip_idx").join(chips, "chip_idx").select("image_id", *(F.col(c).alias(f"k_{c}") for c in chips.columns))
    pairs = own.join(other, "image_id")
    if metric == "oklab":
        d = sum((F.pow(F.col(c) - F.col(f"k_{c}"), F.lit(2.0)) for c in ("ok_l", "ok_a", "ok_b")), F.lit(0.0))
    elif metric == "ciede2000":
        labs = dict(zip(("l1", "a1", "b1", "l2", "a2", "b2"), (*color.rgb_to_lab(*(F.col(c) for c in "rgb")), *color.rgb_to_lab(*(F.col(f"k_{c}") for c in "rgb"))), strict=True))
        pairs = color.with_ciede2000(pairs.withColumns(labs), ("l1", "a1", "b1"), ("l2", "a2", "b2"), "de")
        d = F.col("de")
    else:
        raise ValueError(f"unknown distance metric: {metric}")
    d = F.when(F.col("chip_idx") == F.col("k_chip_idx"), -1.0).otherwise(F.round(d, 12))
    best = pairs.groupBy("image_id", "chip_idx").agg(F.min(F.struct(d.alias("d"), F.col("k_chip_idx").alias("i"))).alias("best"))
    return best.select("image_id", "chip_idx", F.col("best.i").alias("new_idx"))


def reduce_top_n(cells: DataFrame, palette: DataFrame, n: int | None, metric: str = "oklab") -> DataFrame:
    """Snapped cells (image_id, chip_idx, ...) with chip_idx among the image's n most used and ``reduced``:
    whether the image had more."""
    hist = chip_histogram(cells)
    kept = top_n_chips(hist, n)
    moves = resnap(hist, kept, palette, metric)
    used = hist.groupBy("image_id").agg(F.count("*").alias("__used"))
    most = n if n and n > 0 else None
    out = cells.join(moves, ["image_id", "chip_idx"]).join(used, "image_id")
    reduced = F.col("__used") > most if most else F.lit(False)
    return out.withColumns({"reduced": reduced, "chip_idx": F.col("new_idx")}).drop("new_idx", "__used")


def inner_colors(cells: DataFrame, palette: DataFrame, preset: str, metric: str = "oklab") -> DataFrame:
    """cells plus inner_idx: the mean colour adjusted by a preset, snapped to the full palette in OKLab; under
    CIEDE2000 that chip is snapped again by the other metric."""
    hue, lightness, chroma = color.INNER_FILTERS.get(preset, color.INNER_FILTERS["none"])
    lab = color.adjust_oklab(*color.rgb_to_oklab(F.col("r"), F.col("g"), F.col("b")), F.lit(hue), F.lit(lightness), F.lit(chroma))
    best = cells.select("r", "g", "b").distinct().select("r", "g", "b", _search(palette, "oklab")(*lab).alias("inner_idx"))
    if metric == "ciede2000":
        picked = palette.select(F.col("chip_idx").alias("inner_idx"), "r", "g", "b")
        again = snap_ciede2000(picked, palette).select("inner_idx", F.col("chip_idx").alias("again"))
        best = best.join(again, "inner_idx").select("r", "g", "b", F.col("again").alias("inner_idx"))
    return cells.join(best, ["r", "g", "b"])


def translate(cells: DataFrame, kept: DataFrame) -> DataFrame:
    """Indexes into an image's kept list (position from 0 in index order) -> palette indexes."""
    place = F.row_number().over(Window.partitionBy("image_id").orderBy("chip_idx")) - 1
    lists = kept.select("image_id", F.col("chip_idx").alias("full_idx"), place.alias("chip_idx"))
    return cells.join(lists, ["image_id", "chip_idx"]).withColumn("chip_idx", F.col("full_idx")).drop("full_idx")


def legend(traces: DataFrame, palette: DataFrame) -> DataFrame:
    """(image_id, number, chip_idx, notation, color_name): used chips that exist, numbered from 1 in list order."""
    used = traces.select("image_id", F.posexplode("used").alias("at", "chip_idx"))
    rows = used.join(palette.select("chip_idx", "notation", "color_name"), "chip_idx")
    number = F.row_number().over(Window.partitionBy("image_id").orderBy("at"))
    return rows.select("image_id", number.alias("number"), "chip_idx", "notation", "color_name")


def name_grays(grays: DataFrame) -> DataFrame:
    """Grays named 'System Gray NN' by value, then notation."""
    place = F.col("__place").cast("string")
    named = numbered(grays, ["value", "notation"], "__place")
    return named.withColumn("color_name", F.concat(F.lit("System Gray "), F.lpad(place, F.greatest(F.lit(2), F.length(place)), F.lit("0")))).drop("__place")


def name_chips(munsell: DataFrame) -> DataFrame:
    """Chips named by their bucket and a running number in it, by (hue_pct, value, chroma, id)."""
    named = munsell.withColumn("bucket", color.color_bucket_name(F.col("hue_family"), F.col("value"), F.col("chroma")))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("hue_pct", "value", "chroma", "id"))
    return named.withColumn("color_name", F.concat(F.col("bucket"), F.lit(" "), place.cast("string")))


def _claims(own: pd.DataFrame, free: pd.DataFrame) -> pd.DataFrame:
    """(chip_idx, name_idx) of one palette's chips and names, both in index order."""
    if len(own) > len(free):
        raise ValueError("more chips than names")
    lab, taken, out = free[["ok_l", "ok_a", "ok_b"]].to_numpy(np.float64), np.zeros(len(free), bool), []
    for c in own.itertuples():
        d = np.round(((lab - np.array([c.ok_l, c.ok_a, c.ok_b])) ** 2).sum(axis=1), 12)
        best = int(np.where(taken, np.inf, d).argmin())
        taken[best] = True
        out.append((c.chip_idx, int(free["name_idx"].iloc[best])))
    return pd.DataFrame(out, columns=["chip_idx", "name_idx"])


#: Chips that take their names in one round: each colour among them gets so many of the nearest free names that the others
#: of the round cannot use them up. Their square is the numbers that come to the driver.
NAME_BATCH = 2048


def assign_names(chips: DataFrame, names: DataFrame) -> DataFrame:
    """(chip_idx, name_idx): each chip in index order takes its nearest name not taken yet, ties to the least
    name_idx. chips: (chip_idx, ok_l, ok_a, ok_b); names: (name_idx, the same). More chips than names is an
    error. Both tables are palettes of checked size, MOST_CHIPS at most.

    NAME_BATCH chips at a time: tasks list the nearest free names of the batch's colours, each once, as many as the batch
    has chips; the driver, which holds both palettes, goes down the chips and gives each the first of its list that is
    free. So there is one job for a batch, however alike its colours are.
    """
    spark = chips.sparkSession
    own = checked_palette(chips).select("chip_idx", "ok_l", "ok_a", "ok_b").orderBy("chip_idx").toPandas()
    free = checked_palette(names).select("name_idx", "ok_l", "ok_a", "ok_b").orderBy("name_idx").toPandas()
    if len(own) > len(free):
        raise ValueError("more chips than names")
    lab, taken = free[["ok_l", "ok_a", "ok_b"]].to_numpy(np.float64), np.zeros(len(free), bool)
    out = np.empty(len(own), np.int64)
    for at in range(0, len(own), NAME_BATCH):
        colors, color = np.unique(own[["ok_l", "ok_a", "ok_b"]].to_numpy(np.float64)[at : at + NAME_BATCH], axis=0, return_inverse=True)
        lists = _nearest_free(spark, colors, lab, np.flatnonzero(~taken), len(color))
        look = [0] * len(colors)
        for k, c in enumerate(color.ravel().tolist()):
            while taken[lists[c][look[c]]]:
                look[c] += 1
            out[at + k] = lists[c][look[c]]
            taken[out[at + k]] = True
    pairs = pd.DataFrame({"chip_idx": own["chip_idx"].to_numpy(np.int32), "name_idx": free["name_idx"].to_numpy(np.int32)[out]})
    return spark.createDataFrame(pairs, "chip_idx int, name_idx int")


def _nearest_free(spark: SparkSession, colors: np.ndarray, lab: np.ndarray, free: np.ndarray, n: int) -> list[np.ndarray]:
    """For each colour, the n nearest free names (fewer if there are not so many), nearest first, ties by place."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            lists = []
            for c in frame[["l", "a", "b"]].to_numpy(np.float64):
                d = np.round(((lab[free] - c) ** 2).sum(axis=1), 12)
                near = np.flatnonzero(d <= np.partition(d, n - 1)[n - 1]) if n < len(d) else np.arange(len(d))
                lists.append(free[near[np.argsort(d[near], kind="stable")[:n]]].astype(np.int32).tobytes())
            yield pd.DataFrame({"i": frame["i"], "names": lists})

    rows = pd.DataFrame(colors, columns=["l", "a", "b"]).assign(i=np.arange(len(colors)))
    parts = max(1, min(len(colors), spark.sparkContext.defaultParallelism))
    asked = spark.createDataFrame(rows, "l double, a double, b double, i long").repartition(parts, "i")
    got = asked.mapInPandas(run, "i long, names binary").toPandas().sort_values("i")
    return [np.frombuffer(x, np.int32) for x in got["names"]]


def assign_names_by(chips: DataFrame, names: DataFrame, by: str) -> DataFrame:
    """(by, chip_idx, name_idx): assign_names for many palettes at once, one for each value of by (a whole number,
    not null), each of at most MOST_CHIPS chips and names. Palettes are independent, so each is a task's group."""

    def claim(key: tuple, own: pd.DataFrame, free: pd.DataFrame) -> pd.DataFrame:
        if max(len(own), len(free)) > MOST_CHIPS:
            raise ValueError("a palette is too large")
        out = _claims(own.sort_values("chip_idx"), free.sort_values("name_idx"))
        out.insert(0, by, key[0])
        return out

    own = chips.select(by, "chip_idx", "ok_l", "ok_a", "ok_b").groupBy(by)
    free = names.select(by, "name_idx", "ok_l", "ok_a", "ok_b").groupBy(by)
    return own.cogroup(free).applyInPandas(claim, f"{by} long, chip_idx int, name_idx int")
