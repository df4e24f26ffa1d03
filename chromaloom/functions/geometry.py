"""Print geometry as column expressions. Micro-pixels (1 px = 1,000,000) are exact whole numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PPI, PX_U, MIN_U, MAX_U = 72, 1_000_000, 1_000_000, 32_768_000_000
UNITS = ("mm", "cm", "pt", "px")
MOST_BYTES, MOST_PIXELS = 50 * 1024 * 1024, 100_000_000
OUTER_MOST = 0.85

#: Decimal places that a unit's text is cut to, and micro-pixels of one such step as a fraction.
_STEP = {"px": (6, 1, 1), "mm": (3, PPI * PX_U, 25_400), "cm": (4, PPI * PX_U, 25_400), "pt": (6, PPI, 72)}


def _half_up(x: Column) -> Column:
    """As Math.round: halves go up."""
    return F.floor(x + 0.5)


def _wide(x: Column) -> Column:
    return x.cast("decimal(38,0)")


def _divided(n: Column, d: int) -> Column:
    """n / d for n >= 0, halves up, exact."""
    return _wide(F.floor((_wide(n) * 2 + d) / F.lit(2 * d).cast("decimal(12,0)")))


def unit_to_pxu(value: Column, unit: Column) -> Column:
    """Decimal text in a unit -> micro-pixels; null for bad text or an unknown unit."""
    text = F.replace(F.trim(value), F.lit(","), F.lit("."))
    good = text.rlike(r"^\d+(\.\d*)?$") & (F.length(text) <= 24)
    whole, part = F.substring_index(text, ".", 1), F.when(F.instr(text, ".") > 0, F.substring_index(text, ".", -1)).otherwise("")
    out = F.lit(None).cast("bigint")
    for name, (places, up, down) in _STEP.items():
        scaled = F.concat(whole, F.substring(F.rpad(part, places, "0"), 1, places)).try_cast("decimal(30,0)")
        exact = _divided(scaled.cast("decimal(30,0)") * F.lit(up).cast("decimal(8,0)"), down)
        out = F.when(unit == name, exact.try_cast("bigint")).otherwise(out)
    return F.when(good, out)


def pxu_to_unit(pxu: Column, unit: Column, places: int = 4) -> Column:
    """Micro-pixels -> decimal text with at most ``places`` decimals, trailing zeros cut; null for an unknown unit.

    Millimetres and centimetres go through whole steps of the unit (1/1000 mm), as they are shown."""
    out = F.lit(None).cast("string")
    size = F.abs(pxu)
    for name, (scale, up, down) in {"px": (6, 1, 1), "pt": (6, 1, 1), "mm": (3, 25_400, PPI * PX_U), "cm": (4, 25_400, PPI * PX_U)}.items():
        steps = _divided(_wide(size) * up, down)
        if scale > places:
            shown, dp = _divided(steps, 10 ** (scale - places)), places
        else:
            shown, dp = steps, scale
        digits = F.lpad(shown.cast("string"), F.greatest(F.length(shown.cast("string")), F.lit(dp + 1)), F.lit("0"))
        text = F.concat(digits.substr(F.lit(1), F.length(digits) - dp), F.lit("."), digits.substr(F.length(digits) - dp + 1, F.lit(dp)))
        text = F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"\.$", "")
        out = F.when(unit == name, F.concat(F.when((pxu < 0) & (text != "0"), "-").otherwise(""), text)).otherwise(out)
    return out


def convert_unit(value: Column, unit: Column, to: Column) -> Column:
    return pxu_to_unit(unit_to_pxu(value, unit), to)


def pxu_to_px(pxu: Column) -> Column:
    """Cached whole pixels: rounded, one at least."""
    return F.greatest(F.lit(1), F.floor((_wide(pxu) + 500_000) / F.lit(1_000_000).cast("decimal(7,0)")).cast("long"))


def state_problem(width: Column, height: Column, x: Column, y: Column, x_given: Column, y_given: Column, rotation: Column) -> Column:
    """Why an image state is refused, or null. Sizes are required; an axis may be left out but not be null."""

    def number(c: Column) -> Column:
        return F.when(c.rlike(r"^\s*[+-]?\d{1,18}\s*$"), F.trim(c).try_cast("long"))

    def bad_size(c: Column) -> Column:
        n = number(c)
        return n.isNull() | (n < MIN_U) | (n > MAX_U)

    def bad_axis(c: Column, given: Column) -> Column:
        n = number(c)
        return given & (n.isNull() | (n < -MAX_U) | (n > MAX_U))

    turn = rotation.try_cast("double")
    return F.when(bad_size(width), "width").when(bad_size(height), "height").when(bad_axis(x, x_given), "x").when(bad_axis(y, y_given), "y").when(turn.isNull() | F.isnan(turn) | (F.abs(turn) == float("inf")), "rotation")


def place_image(art_w: Column, art_h: Column, w: Column, h: Column, dpi: Column) -> Column:
    """Centre and size on the artboard: physical size by dpi (72 where that is bad), shrunk to fit, never grown."""
    good = (art_w > 0) & (art_h > 0) & (w > 0) & (h > 0)
    scale = F.lit(float(PPI)) / F.when((dpi > 0) & ~F.isnan(dpi.cast("double")) & (dpi < float("inf")), dpi).otherwise(float(PPI))
    pw, ph = w * scale, h * scale
    fit = F.least(F.lit(1.0), F.try_divide(art_w, pw), F.try_divide(art_h, ph))
    return F.when(good, F.struct((art_w / 2).alias("x"), (art_h / 2).alias("y"), (pw * fit).alias("width"), (ph * fit).alias("height")))


def content_region(art_w: Column, art_h: Column, pad: dict[str, Column], image: dict[str, Column], w: Column, h: Column) -> Column:
    """The traced canvas: artboard less padding, at the source's density, and which part of the source covers it.

    pad: left, right, top, bottom. image: left, top, width, height on the artboard. Struct of reason (null where
    it can be planned), canvas_w, canvas_h, left, top, width, height (of the source), at_x, at_y, coverage.
    """
    zero = F.lit(0.0)
    pl = F.greatest(zero, F.least(pad["left"], art_w))
    pr = F.greatest(zero, F.least(pad["right"], art_w - pl))
    pt = F.greatest(zero, F.least(pad["top"], art_h))
    pb = F.greatest(zero, F.least(pad["bottom"], art_h - pt))
    cw, ch = art_w - pl - pr, art_h - pt - pb
    reason = (
        F.when(~F.coalesce((art_w > 0) & (art_h > 0), F.lit(False)), "artboard size")
        .when(~F.coalesce((image["width"] > 0) & (image["height"] > 0), F.lit(False)), "display size")
        .when(~F.coalesce((w > 0) & (h > 0), F.lit(False)), "intrinsic size")
        .when(~((cw > 0) & (ch > 0)), "empty content area")
    )
    sx, sy = F.try_divide(w, image["width"]), F.try_divide(h, image["height"])
    canvas_w, canvas_h = F.greatest(F.lit(1), _half_up(cw * sx)), F.greatest(F.lit(1), _half_up(ch * sy))
    px, py = (image["left"] - pl) * sx, (image["top"] - pt) * sy
    left, top = F.greatest(zero, px), F.greatest(zero, py)
    right, bottom = F.least(canvas_w.cast("double"), px + w), F.least(canvas_h.cast("double"), py + h)
    seen = (right > left) & (bottom > top)
    full = (px <= 0) & (py <= 0) & (px + w >= canvas_w) & (py + h >= canvas_h)
    ok = reason.isNull()

    def where(c: Column, name: str) -> Column:
        return F.when(ok & seen, c).cast("long").alias(name)

    return F.struct(
        reason.alias("reason"),
        F.when(ok, canvas_w).cast("long").alias("canvas_w"),
        F.when(ok, canvas_h).cast("long").alias("canvas_h"),
        where(F.greatest(F.lit(0), _half_up(left - px)), "left"),
        where(F.greatest(F.lit(0), _half_up(top - py)), "top"),
        where(F.greatest(F.lit(1), _half_up(right - left)), "width"),
        where(F.greatest(F.lit(1), _half_up(bottom - top)), "height"),
        where(_half_up(left), "at_x"),
        where(_half_up(top), "at_y"),
        F.when(ok, F.when(~seen, "none").when(full, "full").otherwise("partial")).alias("coverage"),
    )


def _grid(display_w: Column, display_h: Column, pitch_w: Column, pitch_h: Column) -> Column:
    nx = F.when(pitch_w > 0, F.floor(F.try_divide(display_w, pitch_w))).otherwise(0)
    ny = F.when(pitch_h > 0, F.floor(F.try_divide(display_h, pitch_h))).otherwise(0)
    return F.struct(
        nx.cast("long").alias("cells_x"), ny.cast("long").alias("cells_y"), pitch_w.alias("pitch_w"), pitch_h.alias("pitch_h"),
        (nx * pitch_w).alias("used_w"), (ny * pitch_h).alias("used_h"), (display_w - nx * pitch_w).alias("border_w"), (display_h - ny * pitch_h).alias("border_h"),
        ((nx >= 1) & (ny >= 1)).alias("valid"),
    )


def pixelate_grid(display_w: Column, display_h: Column, cell_w: Column, cell_h: Column) -> Column:
    zero = F.lit(0.0)
    return _grid(display_w, display_h, F.greatest(zero, cell_w), F.greatest(zero, cell_h))


def circulate_grid(display_w: Column, display_h: Column, before: tuple[Column, Column], outer: tuple[Column, Column], after: tuple[Column, Column]) -> Column:
    """A cell's pitch is the space before, the outer ellipse and the space after; each pair is (width, height)."""
    zero = F.lit(0.0)
    pw, ph = (F.greatest(zero, before[i]) + F.greatest(zero, outer[i]) + F.greatest(zero, after[i]) for i in (0, 1))
    return _grid(display_w, display_h, pw, ph)


def ellipse_fractions(pitch: tuple[Column, Column], outer: tuple[Column, Column], inner: tuple[Column, Column]) -> Column:
    """Ellipse axes as parts of the pitch, one at most, the outer 0.85 at most so that neighbours keep apart."""
    one, most = F.lit(1.0), F.lit(OUTER_MOST)
    o = [F.least(most, one, F.try_divide(outer[i], pitch[i])) for i in (0, 1)]
    i_ = [F.least(one, F.try_divide(inner[i], pitch[i])) for i in (0, 1)]
    return F.struct(o[0].alias("outer_w"), o[1].alias("outer_h"), i_[0].alias("inner_w"), i_[1].alias("inner_h"))


def centered_crop(pixel_w: Column, pixel_h: Column, display_w: Column, display_h: Column, grid: Column) -> Column:
    """The grid's used area as a pixel rectangle, rounded and kept inside the source."""
    dx, dy = F.try_divide(pixel_w, display_w), F.try_divide(pixel_h, display_h)
    x, y = _half_up(grid["border_w"] / 2 * dx), _half_up(grid["border_h"] / 2 * dy)
    w, h = _half_up(grid["used_w"] * dx), _half_up(grid["used_h"] * dy)
    x, y = F.greatest(F.lit(0), F.least(x, pixel_w - 1)), F.greatest(F.lit(0), F.least(y, pixel_h - 1))
    w, h = F.greatest(F.lit(1), F.least(w, pixel_w - x)), F.greatest(F.lit(1), F.least(h, pixel_h - y))
    return F.struct(*(c.cast("long").alias(n) for c, n in ((x, "x"), (y, "y"), (w, "w"), (h, "h"))))


def work_edge(mp: Column, w: Column, h: Column) -> Column:
    """Longer edge for about mp megapixels: never above the source, within 256..8192; 720 for a bad size."""
    long, short = F.greatest(w, h), F.least(w, h)
    bad = ~F.coalesce((w > 0) & (h > 0), F.lit(False))
    edge = _half_up(F.sqrt(mp * 1e6 * F.try_divide(long, short)))
    return F.when(bad, 720).otherwise(F.least(F.lit(8192), F.greatest(F.lit(256), F.least(long, edge)))).cast("long")


def upload_problem(n_bytes: Column, mime: Column, w: Column, h: Column, allowed: tuple[str, ...] | None = None, most_bytes: int = MOST_BYTES, most_pixels: int = MOST_PIXELS) -> Column:
    """The first rule an upload breaks: size, type (where a list is given), pixels; null if none."""
    out = F.when(n_bytes > most_bytes, "too large")
    if allowed is not None:
        out = out.when(~F.coalesce(F.trim(mime).isin(*allowed), F.lit(False)), "unsupported type")
    return out.when(w.cast("decimal(20,0)") * h.cast("decimal(20,0)") > most_pixels, "too many pixels")


def image_dpi(dpi_x: Column, dpi_y: Column) -> Column:
    """Mean of both axes, else the one there is, one at least; 72 without any (zero counts as none)."""
    x, y = F.nullif(dpi_x, F.lit(0)), F.nullif(dpi_y, F.lit(0))
    one = F.lit(1.0)
    return F.when(x.isNotNull() & y.isNotNull(), F.greatest(one, _half_up((x + y) / 2).cast("double"))).when(F.coalesce(x, y).isNotNull(), F.greatest(one, F.coalesce(x, y).cast("double"))).otherwise(72.0)
