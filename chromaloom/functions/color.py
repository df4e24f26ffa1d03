"""Colour scalars as column expressions: tone filters, OKLab, CIE Lab, CIEDE2000, hex, colour names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The published OKLab matrices (linear sRGB -> cone response -> OKLab).
LMS = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
LAB = ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660))
# Linear sRGB -> XYZ (D65) and the D65 reference white.
XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
WHITE = (0.95047, 1.0, 1.08883)
# Tone filters that images may name.
FILTER_TYPES = ("bw_hard", "bw_soft", "bw_warm")
# Inner-colour presets as (hue in degrees, lightness shift, chroma scale).
INNER_FILTERS = {"none": (0.0, 0.0, 1.0), "darker": (0.0, -0.2, 1.0), "lighter": (0.0, 0.2, 1.0), "complement": (180.0, 0.0, 1.0), "stronger": (0.0, 0.0, 1.5), "muted": (0.0, 0.0, 0.5)}
# Hue words of the Munsell hue families.
HUE_WORDS = {"R": "red", "YR": "orange", "Y": "yellow", "GY": "yellow green", "G": "green", "BG": "bluish green", "B": "blue", "PB": "purplish blue", "P": "purple", "RP": "reddish purple"}


def _dot(row, columns) -> Column:
    a, b, c = (F.lit(k) * x for k, x in zip(row, columns, strict=True))
    return a + b + c


def _byte(x: Column) -> Column:
    """Clip to 0..255 and truncate; rounding at the ninth place first keeps whole numbers whole."""
    return F.floor(F.round(F.greatest(F.lit(0.0), F.least(F.lit(255.0), x)), 9)).cast("int")


def luma709(r: Column, g: Column, b: Column) -> Column:
    return F.lit(0.2126) * r + F.lit(0.7152) * g + F.lit(0.0722) * b


def _gray(v: Column) -> Column:
    return F.struct(v.alias("r"), v.alias("g"), v.alias("b"))


def bw_hard(r: Column, g: Column, b: Column) -> Column:
    """High contrast: gamma 0.85, then 1.5 times the distance from 128."""
    return _gray(_byte((F.pow(luma709(r, g, b) / 255.0, F.lit(0.85)) * 255.0 - 128.0) * 1.5 + 128.0))


def bw_soft(r: Column, g: Column, b: Column) -> Column:
    return _gray(_byte(F.pow(luma709(r, g, b) / 255.0, F.lit(1.1)) * 255.0))


def bw_warm(r: Column, g: Column, b: Column) -> Column:
    """A gray tinted warm: red up five in a hundred, blue down eight."""
    y = luma709(r, g, b)
    return F.struct(_byte(y * 1.05).alias("r"), _byte(y).alias("g"), _byte(y * 0.92).alias("b"))


def apply_filter(kind: Column, r: Column, g: Column, b: Column) -> Column:
    """The filter a row names; null for any other name."""
    return F.when(kind == "bw_hard", bw_hard(r, g, b)).when(kind == "bw_soft", bw_soft(r, g, b)).when(kind == "bw_warm", bw_warm(r, g, b))


def srgb_to_linear(c: Column) -> Column:
    """Gamma-coded 0..1 -> linear 0..1."""
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((F.greatest(c, F.lit(0.0)) + 0.055) / 1.055, F.lit(2.4)))


def rgb_to_oklab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """0..255 -> OKLab."""
    linear = [srgb_to_linear(x.cast("double") / 255.0) for x in (r, g, b)]
    cone = [F.cbrt(_dot(row, linear)) for row in LMS]
    return tuple(_dot(row, cone) for row in LAB)


def adjust_oklab(ok_l: Column, ok_a: Column, ok_b: Column, hue: Column, lightness: Column, chroma: Column) -> tuple[Column, Column, Column]:
    """Turn the hue by degrees, scale the chroma, shift the lightness within 0..1."""
    c = F.hypot(ok_a, ok_b) * chroma
    h = F.atan2(ok_b, ok_a) + F.radians(hue)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), ok_l + lightness)), c * F.cos(h), c * F.sin(h)


def rgb_to_lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """0..255 -> CIE Lab, D65."""
    linear = [srgb_to_linear(x.cast("double") / 255.0) for x in (r, g, b)]

    def curve(t: Column) -> Column:
        return F.when(t > (6.0 / 29.0) ** 3, F.cbrt(t)).otherwise(t * ((29.0 / 6.0) ** 2 / 3.0) + 4.0 / 29.0)

    x, y, z = (curve(_dot(row, linear) / w) for row, w in zip(XYZ, WHITE, strict=True))
    return 116.0 * y - 16.0, 500.0 * (x - y), 200.0 * (y - z)


_FAR = 25.0**7


def _chroma_share(c: Column) -> Column:
    p = F.pow(c, F.lit(7.0))
    return F.sqrt(p / (p + F.lit(_FAR)))


def _hue(a: Column, b: Column) -> Column:
    return F.when((a == 0) & (b == 0), 0.0).otherwise(F.pmod(F.degrees(F.atan2(b, a)) + 360.0, F.lit(360.0)))


def _cosine(v: dict[str, Column], scale: float, shift: float) -> Column:
    return F.cos(F.radians(scale * v["mid_h"] + shift))


def _turned(v: dict[str, Column], straight: Column, over: Column, under: Column, on: Column) -> Column:
    """By whether the hues are equal for want of chroma, near each other, or apart either way."""
    return F.when(v["c1"] * v["c2"] == 0, straight).when(F.abs(v["h2"] - v["h1"]) <= 180, over).when(on, under[0]).otherwise(under[1])


#: CIEDE2000 (Sharma, Wu and Dalal 2005) in stages; each takes the values so far and gives new ones by name.
_DE_STAGES = (
    lambda v: {"g": 0.5 * (1.0 - _chroma_share((F.hypot(v["a1"], v["b1"]) + F.hypot(v["a2"], v["b2"])) / 2.0))},
    lambda v: {"p1": v["a1"] * (1.0 + v["g"]), "p2": v["a2"] * (1.0 + v["g"])},
    lambda v: {"c1": F.hypot(v["p1"], v["b1"]), "c2": F.hypot(v["p2"], v["b2"]), "h1": _hue(v["p1"], v["b1"]), "h2": _hue(v["p2"], v["b2"])},
    lambda v: {
        "mid_l": (v["l1"] + v["l2"]) / 2.0,
        "mid_c": (v["c1"] + v["c2"]) / 2.0,
        "dh": _turned(v, F.lit(0.0), v["h2"] - v["h1"], (v["h2"] - v["h1"] - 360.0, v["h2"] - v["h1"] + 360.0), v["h2"] > v["h1"]),
        "mid_h": _turned(v, v["h1"] + v["h2"], (v["h1"] + v["h2"]) / 2.0, ((v["h1"] + v["h2"] + 360.0) / 2.0, (v["h1"] + v["h2"] - 360.0) / 2.0), v["h1"] + v["h2"] < 360),
    },
    lambda v: {
        "t": 1.0 - 0.17 * _cosine(v, 1, -30.0) + 0.24 * _cosine(v, 2, 0.0) + 0.32 * _cosine(v, 3, 6.0) - 0.20 * _cosine(v, 4, -63.0),
        "rotation": 2.0 * _chroma_share(v["mid_c"]) * F.sin(F.radians(60.0 * F.exp(-F.pow((v["mid_h"] - 275.0) / 25.0, F.lit(2.0))))),
        "off": F.pow(v["mid_l"] - 50.0, F.lit(2.0)),
    },
    lambda v: {
        "dl": (v["l2"] - v["l1"]) / (1.0 + 0.015 * v["off"] / F.sqrt(20.0 + v["off"])),
        "dc": (v["c2"] - v["c1"]) / (1.0 + 0.045 * v["mid_c"]),
        "dt": 2.0 * F.sqrt(v["c1"] * v["c2"]) * F.sin(F.radians(v["dh"] / 2.0)) / (1.0 + 0.015 * v["mid_c"] * v["t"]),
    },
    lambda v: {"de": F.sqrt(F.greatest(F.lit(0.0), v["dl"] * v["dl"] + v["dc"] * v["dc"] + v["dt"] * v["dt"] - v["rotation"] * v["dc"] * v["dt"]))},
)
_LABS = ("l1", "a1", "b1", "l2", "a2", "b2")


def ciede2000(lab1, lab2) -> Column:
    """CIEDE2000 colour difference, all weights one, as one expression. lab: three columns each."""
    v = dict(zip(_LABS, (*lab1, *lab2), strict=True))
    for stage in _DE_STAGES:
        v |= stage(v)
    return v["de"]


def with_ciede2000(df: DataFrame, lab1: tuple[str, ...], lab2: tuple[str, ...], name: str) -> DataFrame:
    """df plus the difference of two of its colours (three column names each), stage by stage in named columns, so that
    generated code computes each once: for many pairs."""
    v, made = {k: F.col(c) for k, c in zip(_LABS, (*lab1, *lab2), strict=True)}, []
    for stage in _DE_STAGES:
        new = {f"__de_{k}": c for k, c in stage(v).items()}
        df = df.withColumns(new)
        made += new
        v |= {k.removeprefix("__de_"): F.col(k) for k in new}
    return df.withColumn(name, v["de"]).drop(*made)


def pack_rgb(r: Column, g: Column, b: Column) -> Column:
    return F.shiftleft(r.cast("int"), 16).bitwiseOR(F.shiftleft(g.cast("int"), 8)).bitwiseOR(b.cast("int"))


def to_hex(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("#%02x%02x%02x", *(x.cast("int") for x in (r, g, b)))


def hex_to_rgb(text: Column) -> Column:
    """#rrggbb -> struct of ints; null for any other text."""
    parts = [F.conv(F.substring(text, at, 2), 16, 10).cast("int").alias(n) for at, n in ((2, "r"), (4, "g"), (6, "b"))]
    return F.when(text.rlike("^#[0-9A-Fa-f]{6}$"), F.struct(*parts))


def hue_family(notation: Column) -> Column:
    """Hue letters of a Munsell notation like '7.5YR 5/6'; null where there are none."""
    return F.nullif(F.regexp_extract(notation, r"^\s*[\d.]+([A-Z]{1,2})\s", 1), F.lit(""))


def color_bucket_name(family: Column, value: Column, chroma: Column) -> Column:
    """A coarse colour name: grays by value; else lightness, saturation and hue words. A null or N family is gray."""
    gray = F.when(value < 1, "Black").when(value < 3.5, "Dark gray").when(value < 6.5, "Medium gray").when(value < 8.5, "Light gray").otherwise("White")
    word = F.lit("gray")
    for name, hue in reversed(HUE_WORDS.items()):
        word = F.when(family == name, hue).otherwise(word)
    brown = ((chroma < 3) & (value < 6)) | ((value < 4) & (chroma >= 4))
    word = F.when((family == "YR") & brown, "brown").when((family == "YR") & (value >= 7), "orange yellow").otherwise(word)
    depth = F.when(chroma >= 12, "vivid").when(chroma >= 8, "strong").when(chroma >= 4, "moderate").when(chroma >= 2, "grayish").otherwise("near-neutral")
    light = F.when(value < 2, "very dark ").when(value < 3.5, "dark ").when(value < 6.5, "").when(value < 8.5, "light ").otherwise("very light ")
    name = F.concat(light, depth, F.lit(" "), word)
    return F.when(family.isNull() | (family == "N"), gray).otherwise(F.concat(F.upper(F.substring(name, 1, 1)), name.substr(F.lit(2), F.length(name))))


def inner_filter(name: Column) -> Column:
    """The preset's hue turn, lightness shift and chroma scale; an unknown or null name changes nothing."""
    out = F.struct(F.lit(0.0).alias("hue"), F.lit(0.0).alias("lightness"), F.lit(1.0).alias("chroma"))
    for key, (hue, lightness, chroma) in INNER_FILTERS.items():
        out = F.when(name == key, F.struct(F.lit(hue).alias("hue"), F.lit(lightness).alias("lightness"), F.lit(chroma).alias("chroma"))).otherwise(out)
    return out


def strength_to_n(strength: Column) -> Column:
    """Dither strength -> candidates of a cell: 2, 4, 8 or 16, split half-way between quarters."""
    return F.when(strength <= 0.375, 2).when(strength <= 0.625, 4).when(strength <= 0.875, 8).otherwise(16)

