"""Images as pixel rows: crops, composites, cell averages, payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import work_edge


def cell_means(pixels: DataFrame, grids: DataFrame) -> DataFrame:
    """(image_id, cx, cy, r, g, b): mean colour of each cell, halves up.

    grids: (image_id, width, height, cells_x, cells_y), joined by image. Means are partial sums before the
    shuffle, so it carries cells, not pixels. Images without a grid are left out.
    """
    cx = F.least(F.col("cells_x") - 1, F.floor(F.col("x") * F.col("cells_x") / F.col("width"))).cast("int")
    cy = F.least(F.col("cells_y") - 1, F.floor(F.col("y") * F.col("cells_y") / F.col("height"))).cast("int")
    placed = pixels.join(grids, "image_id").select("image_id", cx.alias("cx"), cy.alias("cy"), "r", "g", "b")
    return placed.groupBy("image_id", "cx", "cy").agg(*(F.floor(F.avg(c) + 0.5).cast("int").alias(c) for c in "rgb"))


def to_work_size(pixels: DataFrame, megapixels: float) -> DataFrame:
    """(image_id, x, y, r, g, b) with each image's longer edge at most work_edge: larger images become areas' means,
    others keep their pixels. Sizes are one row an image; only partial means are shuffled."""
    size = pixels.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    edge = work_edge(F.lit(float(megapixels)), F.col("width"), F.col("height"))
    share = F.least(F.lit(1.0), edge / F.greatest("width", "height"))
    cells = (F.greatest(F.lit(1), F.floor(F.col(c) * share + 0.5)).cast("int").alias(n) for c, n in (("width", "cells_x"), ("height", "cells_y")))
    done = cell_means(pixels, size.select("image_id", "width", "height", *cells))
    return done.withColumnsRenamed({"cx": "x", "cy": "y"})


def crop(pixels: DataFrame, rects: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pixels inside their image's rectangle, moved to its corner; rectangles refused).

    rects: (image_id, x, y, w, h) whole numbers; sizes: (image_id, width, height). Refused: null or negative
    corner, a side under 10, outside the image, or no such image."""
    known = rects.join(sizes.select("image_id", "width", "height"), "image_id", "left")
    good = (F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("w") >= 10) & (F.col("h") >= 10) & (F.col("x") + F.col("w") <= F.col("width")) & (F.col("y") + F.col("h") <= F.col("height"))
    good = F.coalesce(good, F.lit(False))
    keep = known.filter(good).select("image_id", *(F.col(c).alias(f"r_{c}") for c in "xywh"))
    inside = (F.col("x") >= F.col("r_x")) & (F.col("x") < F.col("r_x") + F.col("r_w")) & (F.col("y") >= F.col("r_y")) & (F.col("y") < F.col("r_y") + F.col("r_h"))
    out = pixels.join(keep, "image_id").filter(inside)
    return out.select("image_id", (F.col("x") - F.col("r_x")).alias("x"), (F.col("y") - F.col("r_y")).alias("y"), "r", "g", "b"), known.filter(~good).select(*rects.columns)


def composite_white(pixels: DataFrame, plans: DataFrame) -> DataFrame:
    """Each image's canvas: the seen part of the image at its place, white elsewhere.

    plans: (image_id, canvas_w, canvas_h, left, top, width, height, at_x, at_y) as content_region gives them.
    """
    p = plans.select("image_id", *(F.col(c).alias(f"p_{c}") for c in ("left", "top", "width", "height", "at_x", "at_y")))
    inside = (F.col("x") >= F.col("p_left")) & (F.col("x") < F.col("p_left") + F.col("p_width")) & (F.col("y") >= F.col("p_top")) & (F.col("y") < F.col("p_top") + F.col("p_height"))
    moved = pixels.join(p, "image_id").filter(inside)
    moved = moved.select("image_id", (F.col("x") - F.col("p_left") + F.col("p_at_x")).cast("long").alias("x"), (F.col("y") - F.col("p_top") + F.col("p_at_y")).cast("long").alias("y"), "r", "g", "b")
    rows = plans.filter("canvas_w > 0 and canvas_h > 0").select("image_id", "canvas_w", F.explode(F.sequence(F.lit(0).cast("long"), F.col("canvas_h") - 1)).alias("y"))
    canvas = rows.select("image_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("canvas_w") - 1)).alias("x"), "y")
    return canvas.join(moved, ["image_id", "x", "y"], "left").select("image_id", "x", "y", *(F.coalesce(c, F.lit(255)).alias(c) for c in "rgb"))


def decode_cells(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Base64 cell grids -> (image_id, cx, cy, r, g, b), and the payloads refused.

    payloads: (image_id, cells_b64, cells_x, cells_y). Refused: text that is not base64, or bytes that are not
    three for each cell."""
    data = payloads.withColumn("__d", F.expr("try_to_binary(cells_b64, 'base64')"))
    good = F.coalesce((F.length("__d") == F.col("cells_x") * F.col("cells_y") * 3) & (F.col("cells_x") > 0) & (F.col("cells_y") > 0), F.lit(False))
    cells = data.filter(good).withColumn("__hex", F.hex("__d")).withColumn("__i", F.explode(F.sequence(F.lit(0), F.col("cells_x") * F.col("cells_y") - 1)))
    parts = [F.conv(F.col("__hex").substr(F.col("__i") * 6 + at, F.lit(2)), 16, 10).cast("int").alias(c) for at, c in ((1, "r"), (3, "g"), (5, "b"))]
    out = cells.select("image_id", (F.col("__i") % F.col("cells_x")).alias("cx"), F.floor(F.col("__i") / F.col("cells_x")).cast("int").alias("cy"), *parts)
    return out, data.filter(~good).drop("__d")


def encode_cells(cells: DataFrame) -> DataFrame:
    """The wire form of cell grids: (image_id, cells_b64, cells_x, cells_y). One image's cells meet in one row."""
    own = F.format_string("%02x%02x%02x", F.col("r"), F.col("g"), F.col("b"))
    rows = cells.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("cy", "cx", own.alias("h")))).alias("l"), (F.max("cx") + 1).alias("cells_x"), (F.max("cy") + 1).alias("cells_y"))
    return rows.select("image_id", F.base64(F.unhex(F.array_join(F.col("l.h"), ""))).alias("cells_b64"), "cells_x", "cells_y")


def trace_summary(cells: DataFrame) -> DataFrame:
    """(image_id, n_chips, n_cells, used): distinct chips, cells, and the sorted list of chips."""
    return cells.groupBy("image_id").agg(F.countDistinct("chip_idx").alias("n_chips"), F.count("*").alias("n_cells"), F.sort_array(F.collect_set("chip_idx")).alias("used"))


def number_labels(cells: DataFrame) -> DataFrame:
    """cells plus label: an image's used chips numbered from 1 in index order. Ranks are made on the chips."""
    from pyspark.sql import Window

    chips = cells.select("image_id", "chip_idx").distinct()
    chips = chips.withColumn("label", F.row_number().over(Window.partitionBy("image_id").orderBy("chip_idx")))
    return cells.join(chips, ["image_id", "chip_idx"])
