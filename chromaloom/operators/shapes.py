"""Drawings as rows: squares, ellipses, numbers, and one SVG text for each image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _num(c: Column) -> Column:
    """Three decimals, trailing zeros cut."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.3f", c.cast("double")), "0+$", ""), r"\.$", "")


def pixelate_shapes(cells: DataFrame, dims: DataFrame) -> DataFrame:
    """(image_id, layer, seq, shape): a unit square for each cell (layer 1) and the grid's lines (layer 2).

    cells: (image_id, cx, cy, hex); dims: (image_id, cells_x, cells_y)."""
    square = F.format_string('<rect x="%d" y="%d" width="1" height="1" fill="%s"/>', F.col("cx"), F.col("cy"), F.col("hex"))
    own = cells.join(dims.select("image_id", "cells_x"), "image_id").select("image_id", F.lit(1).alias("layer"), (F.col("cy") * F.col("cells_x") + F.col("cx")).cast("long").alias("seq"), square.alias("shape"))
    x, y = F.col("cells_x"), F.col("cells_y")
    across = dims.select("image_id", "cells_x", "cells_y", F.explode(F.sequence(F.lit(0), x)).alias("i")).select("image_id", F.lit(2).alias("layer"), F.col("i").cast("long").alias("seq"), F.format_string('<path d="M%d 0V%d"/>', F.col("i"), y).alias("shape"))
    down = dims.select("image_id", "cells_x", "cells_y", F.explode(F.sequence(F.lit(0), y)).alias("i")).select("image_id", F.lit(2).alias("layer"), (x + 1 + F.col("i")).cast("long").alias("seq"), F.format_string('<path d="M0 %dH%d"/>', F.col("i"), x).alias("shape"))
    return own.unionByName(across).unionByName(down)


def circulate_shapes(cells: DataFrame, dims: DataFrame, outer: tuple[float, float], inner: tuple[float, float] | None = None, contour: float = 0.0) -> DataFrame:
    """(image_id, layer, seq, shape): outer ellipses (layer 1), inner ones (layer 2) and the frame (layer 3).

    cells: (image_id, cx, cy, hex, inner_hex); axes as parts of a cell; contour: stroke width, 0 for none."""
    stroke = f' stroke="#000000" stroke-width="{contour:g}"' if contour > 0 else ""

    def ellipse(axes: tuple[float, float], fill: str) -> Column:
        parts = (F.lit('<ellipse cx="'), _num(F.col("cx") + 0.5), F.lit('" cy="'), _num(F.col("cy") + 0.5), F.lit(f'" rx="{axes[0] / 2:g}" ry="{axes[1] / 2:g}" fill="'), F.col(fill), F.lit(f'"{stroke}/>'))
        return F.concat(*parts)

    own = cells.join(dims, "image_id")
    seq = (F.col("cy") * F.col("cells_x") + F.col("cx")).cast("long").alias("seq")
    out = own.select("image_id", F.lit(1).alias("layer"), seq, ellipse(outer, "hex").alias("shape"))
    if inner is not None:
        out = out.unionByName(own.select("image_id", F.lit(2).alias("layer"), seq, ellipse(inner, "inner_hex").alias("shape")))
    frame = F.format_string('<rect x="0" y="0" width="%d" height="%d" fill="none" stroke="#000000"/>', F.col("cells_x"), F.col("cells_y"))
    return out.unionByName(dims.select("image_id", F.lit(3).alias("layer"), F.lit(0).cast("long").alias("seq"), frame.alias("shape")))


def label_shapes(cells: DataFrame, cell_w: float = 1.0, cell_h: float = 1.0) -> DataFrame:
    """(image_id, layer, seq, shape): each cell's number at its centre. cells: (image_id, cx, cy, label, cells_x)."""
    size = F.lit(0.4 * min(cell_w, cell_h))
    text = F.concat(F.lit('<text x="'), _num((F.col("cx") + 0.5) * cell_w), F.lit('" y="'), _num((F.col("cy") + 0.5) * cell_h), F.lit('" font-size="'), _num(size), F.lit('">'), F.col("label").cast("string"), F.lit("</text>"))
    return cells.select("image_id", F.lit(4).alias("layer"), (F.col("cy") * F.col("cells_x") + F.col("cx")).cast("long").alias("seq"), text.alias("shape"))


def to_documents(shapes: DataFrame, dims: DataFrame) -> DataFrame:
    """(image_id, svg): an image's shapes in order of layer and seq in one text. Shape rows are the main output; a
    text has one image's shapes, which one task must hold."""
    body = shapes.groupBy("image_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("layer", "seq", "shape"))), lambda s: s["shape"]), "").alias("body"))
    head = F.format_string('<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 %d %d">', F.col("cells_x"), F.col("cells_y"))
    return body.join(dims, "image_id").select("image_id", F.concat(head, "body", F.lit("</svg>")).alias("svg"))


def _elements(documents: DataFrame, element: str) -> DataFrame:
    """(image_id, seq, shape): each element of that name in an image's drawing, in order. documents: (image_id, svg)."""
    found = F.regexp_extract_all("svg", F.lit(rf"<{element}\b[^>]*>"), F.lit(0))
    return documents.select("image_id", F.posexplode(found).alias("seq", "shape"))


def _attribute(name: str) -> Column:
    return F.regexp_extract("shape", rf"\s{name}=\"([^\"]*)\"", 1)


def read_pixelate(documents: DataFrame) -> DataFrame:
    """Drawings of squares -> (image_id, cx, cy, hex): the cells that pixelate_shapes drew. Null texts and drawings without
    coloured squares have none."""
    own = _elements(documents, "rect").filter(_attribute("fill").rlike("^#[0-9a-fA-F]{6}$"))
    return own.select("image_id", *(_attribute(a).try_cast("int").alias(c) for a, c in (("x", "cx"), ("y", "cy"))), F.lower(_attribute("fill")).alias("hex"))


def read_circulate(documents: DataFrame) -> DataFrame:
    """Drawings of ellipses -> (image_id, cx, cy, ring, hex, rx, ry): ring 1 is a cell's first ellipse, ring 2 the one
    inside it. Outlines without a colour are left out."""
    own = _elements(documents, "ellipse").filter(_attribute("fill").rlike("^#[0-9a-fA-F]{6}$"))
    own = own.select("image_id", "seq", *(F.floor(_attribute(c).try_cast("double")).cast("int").alias(c) for c in ("cx", "cy")), F.lower(_attribute("fill")).alias("hex"), *(_attribute(c).try_cast("double").alias(c) for c in ("rx", "ry")))
    ring = F.row_number().over(Window.partitionBy("image_id", "cx", "cy").orderBy("seq"))
    return own.withColumn("ring", ring).select("image_id", "cx", "cy", "ring", "hex", "rx", "ry")
