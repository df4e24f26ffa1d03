"""Colour scalars (C1-C16) over the pixels of all images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color
from ..operators import palette as pal
from .inputs import PART_CHIPS, PIXELS, lin, oklab_sql, part_chips, pixels, table
from .registry import query

_P = ("image_id", "x", "y")
_RGB = ("r", "g", "b")


def _rgb():
    return [F.col(c) for c in _RGB]


def _r(c, name: str):
    return F.round(c, 6).alias(name)


LUMA = "(0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b)"


def _byte(x: str) -> str:
    return f"floor(round(greatest(0.0::DOUBLE, least(255.0::DOUBLE, {x})), 9))::INT"


HARD = _byte(f"(pow({LUMA} / 255.0::DOUBLE, 0.85::DOUBLE) * 255.0::DOUBLE - 128.0::DOUBLE) * 1.5::DOUBLE + 128.0::DOUBLE")
SOFT = _byte(f"pow({LUMA} / 255.0::DOUBLE, 1.1::DOUBLE) * 255.0::DOUBLE")
WARM = [_byte(f"{LUMA} * 1.05::DOUBLE"), _byte(LUMA), _byte(f"{LUMA} * 0.92::DOUBLE")]


@query(f"WITH {PIXELS} SELECT image_id, x, y, round({LUMA}, 6) AS luma FROM pixels")
def c1_luma709(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).select(*_P, _r(color.luma709(*_rgb()), "luma"))


@query(f"WITH {PIXELS} SELECT image_id, x, y, {HARD} AS v FROM pixels")
def c2_bw_hard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).select(*_P, color.bw_hard(*_rgb())["r"].alias("v"))


@query(f"WITH {PIXELS} SELECT image_id, x, y, {SOFT} AS v FROM pixels")
def c3_bw_soft(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).select(*_P, color.bw_soft(*_rgb())["r"].alias("v"))


@query(f"WITH {PIXELS} SELECT image_id, x, y, {WARM[0]} AS wr, {WARM[1]} AS wg, {WARM[2]} AS wb FROM pixels")
def c4_bw_warm(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = color.bw_warm(*_rgb())
    return pixels(spark, sf_dir).select(*_P, v["r"].alias("wr"), v["g"].alias("wg"), v["b"].alias("wb"))


def _filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter row for each image but every fifth; every fourth names one that does not exist."""
    kind = F.element_at(F.array(*map(F.lit, ("bw_hard", "bw_soft", "bw_warm", "sepia"))), (F.col("image_id") % 4 + 1).cast("int"))
    return pixels(spark, sf_dir).select("image_id").distinct().filter("image_id % 5 <> 4").withColumn("filter_type", kind)


@query(f"""WITH {PIXELS}, f AS (SELECT DISTINCT image_id, (['bw_hard','bw_soft','bw_warm'])[(image_id % 4 + 1)::INT] AS kind FROM pixels WHERE image_id % 5 <> 4 AND image_id % 4 <> 3)
SELECT image_id, x, y, CASE kind WHEN 'bw_hard' THEN {HARD} WHEN 'bw_soft' THEN {SOFT} WHEN 'bw_warm' THEN {WARM[0]} ELSE r END AS r,
  CASE kind WHEN 'bw_hard' THEN {HARD} WHEN 'bw_soft' THEN {SOFT} WHEN 'bw_warm' THEN {WARM[1]} ELSE g END AS g,
  CASE kind WHEN 'bw_hard' THEN {HARD} WHEN 'bw_soft' THEN {SOFT} WHEN 'bw_warm' THEN {WARM[2]} ELSE b END AS b
FROM pixels LEFT JOIN f USING (image_id) WHERE image_id % 5 = 4 OR image_id % 4 <> 3""")
def c5_apply_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pal.apply_filters(pixels(spark, sf_dir), _filters(spark, sf_dir))[0]


@query(f"WITH {PIXELS} SELECT image_id, x, y, round({lin('r')}, 6) AS lr, round({lin('g')}, 6) AS lg, round({lin('b')}, 6) AS lb FROM pixels")
def c6_srgb_to_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).select(*_P, *(_r(color.srgb_to_linear(F.col(c).cast("double") / 255.0), f"l{c}") for c in "rgb"))


_OK = oklab_sql("r", "g", "b")


@query(f"WITH {PIXELS} SELECT image_id, x, y, {', '.join(f'round({e}, 6) AS {n}' for e, n in zip(_OK, ('ok_l', 'ok_a', 'ok_b'), strict=True))} FROM pixels")
def c7_rgb_to_oklab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).select(*_P, *(_r(c, n) for c, n in zip(color.rgb_to_oklab(*_rgb()), ("ok_l", "ok_a", "ok_b"), strict=True)))


@query(f"""WITH {PIXELS}, o AS (SELECT image_id, x, y, {_OK[0]} AS l, {_OK[1]} AS a, {_OK[2]} AS b FROM pixels),
h AS (SELECT *, sqrt(a * a + b * b) * 1.5 AS c, atan2(b, a) + radians((image_id * 15)::DOUBLE) AS t FROM o)
SELECT image_id, x, y, round(greatest(0, least(1, l - 0.2::DOUBLE)), 6) AS ok_l, round(c * cos(t), 6) + 0.0 AS ok_a, round(c * sin(t), 6) + 0.0 AS ok_b FROM h""")
def c8_adjust_oklab(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = color.adjust_oklab(*color.rgb_to_oklab(*_rgb()), (F.col("image_id") * 15).cast("double"), F.lit(-0.2), F.lit(1.5))
    return pixels(spark, sf_dir).select(*_P, _r(lab[0], "ok_l"), (F.round(lab[1], 6) + 0.0).alias("ok_a"), (F.round(lab[2], 6) + 0.0).alias("ok_b"))


def lab_sql(r: str, g: str, b: str) -> tuple[str, str, str]:
    def f(row, w) -> str:
        t = "((" + " + ".join(f"{k}::DOUBLE * {lin(c)}" for k, c in zip(row, (r, g, b), strict=True)) + f") / {w}::DOUBLE)"
        return f"(CASE WHEN {t} > pow(6.0::DOUBLE / 29.0::DOUBLE, 3) THEN cbrt({t}) ELSE {t} * (pow(29.0::DOUBLE / 6.0::DOUBLE, 2) / 3.0::DOUBLE) + 4.0::DOUBLE / 29.0::DOUBLE END)"

    x, y, z = (f(row, w) for row, w in zip(color.XYZ, color.WHITE, strict=True))
    return f"(116.0 * {y} - 16.0)", f"(500.0 * ({x} - {y}))", f"(200.0 * ({y} - {z}))"


_LAB = lab_sql("r", "g", "b")


@query(f"WITH {PIXELS} SELECT image_id, x, y, {', '.join(f'round({e}, 6) + 0.0 AS {n}' for e, n in zip(_LAB, ('lab_l', 'lab_a', 'lab_b'), strict=True))} FROM pixels")
def c9_rgb_to_lab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).select(*_P, *((F.round(c, 6) + 0.0).alias(n) for c, n in zip(color.rgb_to_lab(*_rgb()), ("lab_l", "lab_a", "lab_b"), strict=True)))


def de00_sql(source: str, keep: str) -> str:
    """CTEs over a relation with l1, a1, b1, l2, a2, b2; the last, ``de``, keeps ``keep`` and adds de00."""
    return f"""d1 AS (SELECT *, 0.5::DOUBLE * (1 - sqrt(pow((sqrt(a1*a1+b1*b1)+sqrt(a2*a2+b2*b2))/2, 7) / (pow((sqrt(a1*a1+b1*b1)+sqrt(a2*a2+b2*b2))/2, 7) + pow(25.0::DOUBLE, 7)))) AS chroma_g FROM {source}),
d2 AS (SELECT *, a1*(1+chroma_g) AS p1, a2*(1+chroma_g) AS p2 FROM d1),
d3 AS (SELECT *, sqrt(p1*p1+b1*b1) AS c1, sqrt(p2*p2+b2*b2) AS c2,
  CASE WHEN p1=0 AND b1=0 THEN 0 ELSE degrees(atan2(b1,p1)) + CASE WHEN degrees(atan2(b1,p1)) < 0 THEN 360 ELSE 0 END END AS h1,
  CASE WHEN p2=0 AND b2=0 THEN 0 ELSE degrees(atan2(b2,p2)) + CASE WHEN degrees(atan2(b2,p2)) < 0 THEN 360 ELSE 0 END END AS h2 FROM d2),
d4 AS (SELECT *, (l1+l2)/2 AS ml, (c1+c2)/2 AS mc,
  CASE WHEN c1*c2=0 THEN 0 WHEN abs(h2-h1)<=180 THEN h2-h1 WHEN h2-h1>180 THEN h2-h1-360 ELSE h2-h1+360 END AS dh,
  CASE WHEN c1*c2=0 THEN h1+h2 WHEN abs(h2-h1)<=180 THEN (h1+h2)/2 WHEN h1+h2<360 THEN (h1+h2+360)/2 ELSE (h1+h2-360)/2 END AS mh FROM d3),
d5 AS (SELECT *, 2*sqrt(c1*c2)*sin(radians(dh/2)) AS turn,
  1 - 0.17::DOUBLE*cos(radians(mh-30)) + 0.24::DOUBLE*cos(radians(2*mh)) + 0.32::DOUBLE*cos(radians(3*mh+6)) - 0.20::DOUBLE*cos(radians(4*mh-63)) AS t,
  2*sqrt(pow(mc,7)/(pow(mc,7)+pow(25.0::DOUBLE,7)))*sin(radians(60*exp(-pow((mh-275)/25,2)))) AS rt FROM d4),
d6 AS (SELECT *, (l2-l1)/(1+0.015::DOUBLE*pow(ml-50,2)/sqrt(20+pow(ml-50,2))) AS dl, (c2-c1)/(1+0.045::DOUBLE*mc) AS dc, turn/(1+0.015::DOUBLE*mc*t) AS dt FROM d5),
de AS (SELECT {keep}, sqrt(greatest(0, dl*dl+dc*dc+dt*dt-rt*dc*dt)) AS de00 FROM d6)"""


_LAB2 = lab_sql("((r * 7 + 31) % 256)", "((g * 5 + 17) % 256)", "((b * 3 + 5) % 256)")


@query(f"""WITH {PIXELS}, pairs AS (SELECT image_id, x, y, {', '.join(f'{e} AS {n}' for e, n in zip(_LAB + _LAB2, ('l1', 'a1', 'b1', 'l2', 'a2', 'b2'), strict=True))} FROM pixels),
{de00_sql('pairs', 'image_id, x, y')} SELECT image_id, x, y, round(de00, 6) AS de00 FROM de""")
def c10_ciede2000(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pixel against a colour made from its own."""
    one = color.rgb_to_lab(*_rgb())
    other = color.rgb_to_lab((F.col("r") * 7 + 31) % 256, (F.col("g") * 5 + 17) % 256, (F.col("b") * 3 + 5) % 256)
    names = ("l1", "a1", "b1", "l2", "a2", "b2")
    pairs = pixels(spark, sf_dir).select(*_P, *(c.alias(n) for c, n in zip((*one, *other), names, strict=True)))
    de = color.ciede2000([F.col(n) for n in names[:3]], [F.col(n) for n in names[3:]])
    return pairs.select(*_P, _r(de, "de00"))


@query(f"WITH {PIXELS} SELECT image_id, x, y, r * 65536 + g * 256 + b AS packed, printf('#%02x%02x%02x', r, g, b) AS hex FROM pixels")
def c11_pack_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).select(*_P, color.pack_rgb(*_rgb()).alias("packed"), color.to_hex(*_rgb()).alias("hex"))


@query(f"""WITH {PIXELS}, h AS (SELECT image_id, x, y, CASE WHEN x = 3 THEN 'red' ELSE upper(printf('#%02x%02x%02x', r, g, b)) END AS hex, r, g, b FROM pixels)
SELECT image_id, x, y, CASE WHEN x <> 3 THEN r END AS r, CASE WHEN x <> 3 THEN g END AS g, CASE WHEN x <> 3 THEN b END AS b FROM h""")
def c12_hex_to_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("x") == 3, "red").otherwise(F.upper(color.to_hex(*_rgb())))
    v = color.hex_to_rgb(F.col("hex"))
    return pixels(spark, sf_dir).withColumn("hex", text).select(*_P, *(v[c].alias(c) for c in "rgb"))


@query(f"""WITH {PART_CHIPS} SELECT chip_idx, nullif(regexp_extract(CASE WHEN chip_idx % 7 = 0 THEN 'N5' ELSE notation END, '^\\s*[\\d.]+([A-Z]{{1,2}})\\s', 1), '') AS hue_family FROM part_chips""")
def c13_hue_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The family of every part's notation."""
    notation = F.when(F.col("chip_idx") % 7 == 0, "N5").otherwise(F.col("notation"))
    return part_chips(spark, sf_dir).select("chip_idx", color.hue_family(notation).alias("hue_family"))


BUCKET = """CASE WHEN f = 'N' OR f IS NULL THEN CASE WHEN v < 1 THEN 'Black' WHEN v < 3.5 THEN 'Dark gray' WHEN v < 6.5 THEN 'Medium gray' WHEN v < 8.5 THEN 'Light gray' ELSE 'White' END ELSE upper(n[1:1]) || n[2:] END"""
NAMED = f"""munsell AS (SELECT p_partkey AS id, (['R','YR','Y','GY','G','BG','B','PB','P','RP','N',NULL])[(p_partkey % 12 + 1)::INT] AS f, p_size AS hue_pct, (p_size % 20) / 2.0::DOUBLE AS v, ((p_partkey * 7) % 32) / 2.0::DOUBLE AS c FROM part),
worded AS (SELECT *, CASE WHEN v < 2 THEN 'very dark ' WHEN v < 3.5 THEN 'dark ' WHEN v < 6.5 THEN '' WHEN v < 8.5 THEN 'light ' ELSE 'very light ' END
  || CASE WHEN c >= 12 THEN 'vivid' WHEN c >= 8 THEN 'strong' WHEN c >= 4 THEN 'moderate' WHEN c >= 2 THEN 'grayish' ELSE 'near-neutral' END || ' '
  || CASE f WHEN 'R' THEN 'red' WHEN 'YR' THEN CASE WHEN (c < 3 AND v < 6) OR (v < 4 AND c >= 4) THEN 'brown' WHEN v >= 7 THEN 'orange yellow' ELSE 'orange' END WHEN 'Y' THEN 'yellow' WHEN 'GY' THEN 'yellow green'
     WHEN 'G' THEN 'green' WHEN 'BG' THEN 'bluish green' WHEN 'B' THEN 'blue' WHEN 'PB' THEN 'purplish blue' WHEN 'P' THEN 'purple' WHEN 'RP' THEN 'reddish purple' ELSE 'gray' END AS n FROM munsell),
named AS (SELECT id, f, hue_pct, v, c, {BUCKET} AS bucket FROM worded)"""


def munsell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, hue_family, hue_pct, value, chroma) for each part."""
    k = F.col("p_partkey")
    family = F.get(F.array(*map(F.lit, ("R", "YR", "Y", "GY", "G", "BG", "B", "PB", "P", "RP", "N", None))), (k % 12).cast("int"))
    return table(spark, sf_dir, "part").select(k.alias("id"), family.alias("hue_family"), F.col("p_size").alias("hue_pct"), ((F.col("p_size") % 20) / 2.0).alias("value"), ((k * 7 % 32) / 2.0).alias("chroma"))


@query(f"WITH {NAMED} SELECT id, bucket FROM named")
def c14_color_bucket_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return munsell(spark, sf_dir).select("id", color.color_bucket_name(F.col("hue_family"), F.col("value"), F.col("chroma")).alias("bucket"))


@query("""SELECT p_partkey AS id, CASE k WHEN 'complement' THEN 180.0::DOUBLE ELSE 0.0 END AS hue, CASE k WHEN 'darker' THEN -0.2::DOUBLE WHEN 'lighter' THEN 0.2 ELSE 0 END AS lightness,
  CASE k WHEN 'stronger' THEN 1.5::DOUBLE WHEN 'muted' THEN 0.5 ELSE 1 END AS chroma
FROM (SELECT p_partkey, (['none','darker','lighter','complement','stronger','muted','other'])[(p_partkey % 7 + 1)::INT] AS k FROM part)""")
def c15_inner_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.get(F.array(*map(F.lit, (*color.INNER_FILTERS, "other"))), (F.col("p_partkey") % 7).cast("int"))
    v = color.inner_filter(name)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), *(v[c].alias(c) for c in ("hue", "lightness", "chroma")))


@query("SELECT l_orderkey, l_linenumber, l_discount, CASE WHEN l_discount * 10 <= 0.375 THEN 2 WHEN l_discount * 10 <= 0.625 THEN 4 WHEN l_discount * 10 <= 0.875 THEN 8 ELSE 16 END AS n FROM lineitem")
def c16_strength_to_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", color.strength_to_n(F.col("l_discount") * 10).alias("n"))
