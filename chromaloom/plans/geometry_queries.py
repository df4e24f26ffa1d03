"""Print geometry (G1-G15), payloads (S3) and cell averages (A1) over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..operators import grid
from .inputs import CELLS, PIXELS, grids, pixels, table
from .registry import query

_UNITS = ("mm", "cm", "pt", "px", "in")
#: A decimal text for each supplier and a unit; some texts are bad.
SIZES = """sizes AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 11 = 0 THEN 'x' || s_suppkey WHEN s_suppkey % 13 = 0 THEN s_suppkey || ',5' WHEN s_suppkey % 7 = 0 THEN ' ' || s_suppkey || '. '
  ELSE (s_suppkey * 37 % 1000) || '.' || (s_suppkey * 7919 % 10000000) END AS value, (['mm','cm','pt','px','in'])[(s_suppkey % 5 + 1)::INT] AS unit FROM supplier)"""


def _scaled(t: str, n: int) -> str:
    return f"(split_part({t}, '.', 1) || left(split_part({t}, '.', 2) || '000000', {n}))::HUGEINT"


def _half(n: str, d: int) -> str:
    return f"((2 * ({n}) + {d}) // {2 * d})"


_T = "t"
PXU = f"""pxu AS (SELECT id, unit, (CASE WHEN regexp_full_match(t, '\\d+(\\.\\d*)?') THEN CASE unit WHEN 'px' THEN {_scaled(_T, 6)} WHEN 'mm' THEN {_half(_scaled(_T, 3) + ' * 72000000', 25400)}
    WHEN 'cm' THEN {_half(_scaled(_T, 4) + ' * 72000000', 25400)} WHEN 'pt' THEN {_scaled(_T, 6)} END END)::BIGINT AS pxu
  FROM (SELECT id, unit, replace(trim(value), ',', '.') AS t FROM sizes))"""


def _texts(u: str, unit: str) -> str:
    """Micro-pixels -> text with four decimals at most."""

    def text(n: str, dp: int) -> str:
        d = f"lpad(({n})::VARCHAR, greatest(length(({n})::VARCHAR), {dp + 1})::INT, '0')"
        return f"regexp_replace(regexp_replace(left({d}, length({d}) - {dp}) || '.' || right({d}, {dp}), '0+$', ''), '\\.$', '')"

    um = _half(f"({u})::HUGEINT * 25400", 72_000_000)
    return f"CASE {unit} WHEN 'px' THEN {text(_half(f'({u})::HUGEINT', 100), 4)} WHEN 'pt' THEN {text(_half(f'({u})::HUGEINT', 100), 4)} WHEN 'mm' THEN {text(um, 3)} WHEN 'cm' THEN {text(um, 4)} END"


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    text = (
        F.when(k % 11 == 0, F.concat(F.lit("x"), k.cast("string")))
        .when(k % 13 == 0, F.concat(k.cast("string"), F.lit(",5")))
        .when(k % 7 == 0, F.concat(F.lit(" "), k.cast("string"), F.lit(". ")))
        .otherwise(F.concat((k * 37 % 1000).cast("string"), F.lit("."), (k * 7919 % 10_000_000).cast("string")))
    )
    return table(spark, sf_dir, "supplier").select(k.alias("id"), text.alias("value"), F.get(F.array(*map(F.lit, _UNITS)), (k % 5).cast("int")).alias("unit"))


@query(f"WITH {SIZES}, {PXU} SELECT id, pxu FROM pxu")
def g1_unit_to_pxu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sizes(spark, sf_dir).select("id", geo.unit_to_pxu(F.col("value"), F.col("unit")).alias("pxu"))


@query(f"SELECT o_orderkey AS id, {_texts('(o_orderkey * 7919 + o_custkey) * 1009', 'u')} AS shown FROM (SELECT o_orderkey, o_custkey, (['mm','cm','pt','px','in'])[(o_orderkey % 5 + 1)::INT] AS u FROM orders)")
def g2_pxu_to_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.get(F.array(*map(F.lit, _UNITS)), (F.col("o_orderkey") % 5).cast("int"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), geo.pxu_to_unit((F.col("o_orderkey") * 7919 + F.col("o_custkey")) * 1009, unit).alias("shown"))


@query(f"WITH {SIZES}, {PXU} SELECT id, {_texts('pxu', 'u')} AS shown FROM (SELECT *, (['px','mm','cm','pt'])[(id % 4 + 1)::INT] AS u FROM pxu)")
def g3_convert_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = F.get(F.array(*map(F.lit, ("px", "mm", "cm", "pt"))), (F.col("id") % 4).cast("int"))
    return _sizes(spark, sf_dir).select("id", geo.convert_unit(F.col("value"), F.col("unit"), to).alias("shown"))


@query("SELECT o_orderkey AS id, greatest(1, (o_orderkey * 7919 * 101 + 500000) // 1000000)::BIGINT AS px FROM orders")
def g4_pxu_to_px(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), geo.pxu_to_px(F.col("o_orderkey") * 7919 * 101).alias("px"))


@query("""WITH s AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 19 = 0 THEN 'wide' ELSE (o_orderkey * 5000003)::VARCHAR END AS w, (o_custkey * 30000001)::VARCHAR AS h,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (-o_custkey * 40000007)::VARCHAR END AS x, o_orderkey % 10 <> 0 AS x_given FROM orders),
n AS (SELECT *, try_cast(w AS BIGINT) AS wn, try_cast(h AS BIGINT) AS hn, try_cast(x AS BIGINT) AS xn FROM s)
SELECT id, CASE WHEN wn IS NULL OR wn < 1000000 OR wn > 32768000000 THEN 'width' WHEN hn < 1000000 OR hn > 32768000000 THEN 'height'
  WHEN x_given AND (xn IS NULL OR abs(xn) > 32768000000) THEN 'x' END AS problem FROM n""")
def g5_validate_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    w = F.when(k % 17 == 0, None).when(k % 19 == 0, "wide").otherwise((k * 5000003).cast("string"))
    x = F.when(k % 5 != 0, (-c * 40000007).cast("string"))
    problem = geo.state_problem(w, (c * 30000001).cast("string"), x, F.lit("0"), k % 10 != 0, F.lit(False), F.lit("90"))
    return table(spark, sf_dir, "orders").select(k.alias("id"), problem.alias("problem"))


@query("""WITH i AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity * 20 AS w, l_partkey::DOUBLE AS h, CASE WHEN l_linenumber = 1 THEN 0 ELSE l_linenumber * 50.0 END AS dpi FROM lineitem),
p AS (SELECT *, 72.0::DOUBLE / CASE WHEN dpi > 0 THEN dpi ELSE 72 END AS s FROM i), f AS (SELECT *, least(1.0::DOUBLE, 595.0 / (w * s), 842.0 / (h * s)) AS fit FROM p)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN h > 0 THEN round(w * s * fit, 6) END AS width, CASE WHEN h > 0 THEN round(h * s * fit, 6) END AS height, CASE WHEN h > 0 THEN 297.5::DOUBLE END AS x FROM f""")
def g6_place_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    dpi = F.when(F.col("l_linenumber") == 1, 0.0).otherwise(F.col("l_linenumber") * 50.0)
    v = geo.place_image(F.lit(595.0), F.lit(842.0), F.col("l_quantity") * 20, F.col("l_partkey").cast("double"), dpi)
    items = table(spark, sf_dir, "lineitem").withColumn("v", v)
    return items.select("l_orderkey", "l_linenumber", "l_partkey", F.round("v.width", 6).alias("width"), F.round("v.height", 6).alias("height"), F.col("v.x").alias("x"))


REGION = """reg0 AS (SELECT o_orderkey AS id, 600.0::DOUBLE AS aw, 400.0::DOUBLE AS ah, (o_orderkey % 31 * 10)::DOUBLE AS padl, (o_custkey % 30 * 12)::DOUBLE AS padr, (o_orderkey % 17 * 14)::DOUBLE AS padt, (o_custkey % 13 * 16)::DOUBLE AS padb,
  (o_orderkey % 700 - 100)::DOUBLE AS il, (o_custkey % 500 - 80)::DOUBLE AS it, (o_orderkey % 97 * 10)::DOUBLE AS iw, (50 + o_custkey % 41 * 10)::DOUBLE AS ih, 800.0::DOUBLE AS w, 640.0::DOUBLE AS h FROM orders),
reg1 AS (SELECT *, greatest(0, least(padl, aw)) AS pl, greatest(0, least(padt, ah)) AS pt FROM reg0),
reg2 AS (SELECT *, aw - pl - greatest(0, least(padr, aw - pl)) AS cw, ah - pt - greatest(0, least(padb, ah - pt)) AS ch, w / nullif(iw, 0) AS sx, h / ih AS sy FROM reg1),
reg3 AS (SELECT *, CASE WHEN iw <= 0 THEN 'display size' WHEN NOT (cw > 0 AND ch > 0) THEN 'empty content area' END AS reason, greatest(1, floor(cw * sx + 0.5)) AS canvas_w, greatest(1, floor(ch * sy + 0.5)) AS canvas_h, (il - pl) * sx AS px, (it - pt) * sy AS py FROM reg2),
reg4 AS (SELECT *, greatest(0, px) AS le, greatest(0, py) AS tp, least(canvas_w, px + w) AS ri, least(canvas_h, py + h) AS bo FROM reg3),
reg AS (SELECT *, reason IS NULL AS ok, reason IS NULL AND ri > le AND bo > tp AS seen FROM reg4)"""


def _region(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    pad = {n: e.cast("double") for n, e in {"left": k % 31 * 10, "right": c % 30 * 12, "top": k % 17 * 14, "bottom": c % 13 * 16}.items()}
    image = {n: e.cast("double") for n, e in {"left": k % 700 - 100, "top": c % 500 - 80, "width": k % 97 * 10, "height": c % 41 * 10 + 50}.items()}
    plan = geo.content_region(F.lit(600.0), F.lit(400.0), pad, image, F.lit(800.0), F.lit(640.0))
    return table(spark, sf_dir, "orders").select(k.alias("id"), plan.alias("v"))


@query(f"""WITH {REGION} SELECT id, reason, CASE WHEN ok THEN canvas_w::BIGINT END AS canvas_w, CASE WHEN ok THEN canvas_h::BIGINT END AS canvas_h,
  CASE WHEN seen THEN greatest(0, floor(le - px + 0.5))::BIGINT END AS "left", CASE WHEN seen THEN greatest(0, floor(tp - py + 0.5))::BIGINT END AS top,
  CASE WHEN seen THEN greatest(1, floor(ri - le + 0.5))::BIGINT END AS width, CASE WHEN seen THEN greatest(1, floor(bo - tp + 0.5))::BIGINT END AS height,
  CASE WHEN seen THEN floor(le + 0.5)::BIGINT END AS at_x, CASE WHEN seen THEN floor(tp + 0.5)::BIGINT END AS at_y,
  CASE WHEN ok THEN CASE WHEN NOT seen THEN 'none' WHEN px <= 0 AND py <= 0 AND px + w >= canvas_w AND py + h >= canvas_h THEN 'full' ELSE 'partial' END END AS coverage FROM reg""")
def g7_content_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _region(spark, sf_dir).select("id", "v.*")


@query(f"""WITH {PIXELS}, p AS (SELECT DISTINCT image_id, (20 + image_id % 9) AS cw, (18 + image_id % 7) AS ch, image_id % 4 AS l, image_id % 3 AS t, 15 AS w, 12 AS h, image_id % 5 AS ax, image_id % 6 AS ay FROM pixels),
canvas AS (SELECT image_id, x, unnest(range(ch)) AS y FROM (SELECT *, unnest(range(cw)) AS x FROM p)),
moved AS (SELECT image_id, x - l + ax AS x, y - t + ay AS y, r, g, b FROM pixels JOIN p USING (image_id) WHERE x >= l AND x < l + w AND y >= t AND y < t + h)
SELECT c.image_id, c.x, c.y, coalesce(r, 255) AS r, coalesce(g, 255) AS g, coalesce(b, 255) AS b FROM canvas c LEFT JOIN moved m ON c.image_id = m.image_id AND c.x = m.x AND c.y = m.y""")
def g8_composite_white(spark: SparkSession, sf_dir: str) -> DataFrame:
    pix, k = pixels(spark, sf_dir), F.col("image_id")
    plan = pix.select("image_id").distinct().select(
        "image_id", (k % 9 + 20).alias("canvas_w"), (k % 7 + 18).alias("canvas_h"), (k % 4).alias("left"), (k % 3).alias("top"),
        F.lit(15).alias("width"), F.lit(12).alias("height"), (k % 5).alias("at_x"), (k % 6).alias("at_y"),
    )
    return grid.composite_white(pix, plan)


@query(f"""WITH {PIXELS}, s AS (SELECT image_id, max(x) + 1 AS width, max(y) + 1 AS height, image_id % 6 AS rx, image_id % 5 AS ry, 8 + image_id % 12 AS rw, 10 + image_id % 3 AS rh FROM pixels GROUP BY image_id)
SELECT image_id, (x - rx)::INT AS x, (y - ry)::INT AS y, r, g, b FROM pixels JOIN s USING (image_id) WHERE rw >= 10 AND rx + rw <= width AND ry + rh <= height AND x >= rx AND x < rx + rw AND y >= ry AND y < ry + rh""")
def g9_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    pix, k = pixels(spark, sf_dir), F.col("image_id")
    rects = pix.select("image_id").distinct().select("image_id", (k % 6).cast("int").alias("x"), (k % 5).cast("int").alias("y"), (k % 12 + 8).cast("int").alias("w"), (k % 3 + 10).cast("int").alias("h"))
    return grid.crop(pix, rects, grids(pix))[0]


DISPLAY = """disp AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity * 4.25 AS dw, l_quantity * 3.5 + l_linenumber AS dh, (l_linenumber - 1) * 0.75 AS a, l_tax * 100 AS b FROM lineitem)"""
_KEY = ("l_orderkey", "l_linenumber", "l_partkey")


def _display(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(*_KEY, (q * 4.25).alias("dw"), (q * 3.5 + n).alias("dh"), ((n - 1) * 0.75).alias("a"), (F.col("l_tax") * 100).alias("b"))


def _grid_out(df: DataFrame) -> DataFrame:
    return df.select(*_KEY, F.col("v.cells_x").alias("cells_x"), F.col("v.cells_y").alias("cells_y"), *(F.round(F.col(f"v.{c}"), 6).alias(c) for c in ("used_w", "used_h", "border_w", "border_h")), F.col("v.valid").alias("valid"))


def _grid_sql(pw: str, ph: str) -> str:
    return f"""g AS (SELECT *, {pw} AS pw, {ph} AS ph FROM disp), n AS (SELECT *, CASE WHEN pw > 0 THEN floor(dw / pw) ELSE 0 END AS nx, CASE WHEN ph > 0 THEN floor(dh / ph) ELSE 0 END AS ny FROM g)
SELECT l_orderkey, l_linenumber, l_partkey, nx::BIGINT AS cells_x, ny::BIGINT AS cells_y, round(nx * pw, 6) AS used_w, round(ny * ph, 6) AS used_h, round(dw - nx * pw, 6) AS border_w, round(dh - ny * ph, 6) AS border_h, nx >= 1 AND ny >= 1 AS valid FROM n"""


@query(f"WITH {DISPLAY}, {_grid_sql('greatest(0.0::DOUBLE, a)', 'greatest(0.0::DOUBLE, b)')}")
def g10_pixelate_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid_out(_display(spark, sf_dir).withColumn("v", geo.pixelate_grid(F.col("dw"), F.col("dh"), F.col("a"), F.col("b"))))


@query(f"WITH {DISPLAY}, {_grid_sql('0.5::DOUBLE + greatest(0.0::DOUBLE, a) + 0.25::DOUBLE', '0.0::DOUBLE + greatest(0.0::DOUBLE, b) + 1.5::DOUBLE')}")
def g11_circulate_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = geo.circulate_grid(F.col("dw"), F.col("dh"), (F.lit(0.5), F.lit(-1.0)), (F.col("a"), F.col("b")), (F.lit(0.25), F.lit(1.5)))
    return _grid_out(_display(spark, sf_dir).withColumn("v", v))


@query(f"""WITH {DISPLAY} SELECT l_orderkey, l_linenumber, l_partkey, round(least(0.85::DOUBLE, 1.0, a / 2.0), 6) AS outer_w, round(least(0.85::DOUBLE, 1.0, b / 3.0), 6) AS outer_h, round(least(1.0::DOUBLE, dw / 60.0), 6) AS inner_w, round(least(1.0::DOUBLE, dh / 60.0), 6) AS inner_h FROM disp""")
def g12_ellipse_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = geo.ellipse_fractions((F.lit(2.0), F.lit(3.0)), (F.col("a"), F.col("b")), (F.col("dw") / 30, F.col("dh") / 20))
    return _display(spark, sf_dir).withColumn("v", v).select(*_KEY, *(F.round(F.col(f"v.{c}"), 6).alias(c) for c in ("outer_w", "outer_h", "inner_w", "inner_h")))


@query(f"""WITH {DISPLAY}, g AS (SELECT *, floor(dw / 3.5) * 3.5 AS uw, floor(dh / 2.25) * 2.25 AS uh FROM disp),
p AS (SELECT *, floor((dw - uw) / 2 * (1000.0 / dw) + 0.5) AS x, floor((dh - uh) / 2 * (700.0 / dh) + 0.5) AS y, floor(uw * (1000.0 / dw) + 0.5) AS w, floor(uh * (700.0 / dh) + 0.5) AS h FROM g)
SELECT l_orderkey, l_linenumber, l_partkey, least(x, 999)::BIGINT AS x, least(y, 699)::BIGINT AS y, greatest(1, least(w, 1000 - least(x, 999)))::BIGINT AS w, greatest(1, least(h, 700 - least(y, 699)))::BIGINT AS h FROM p""")
def g13_centered_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _display(spark, sf_dir).withColumn("g", geo.pixelate_grid(F.col("dw"), F.col("dh"), F.lit(3.5), F.lit(2.25)))
    return d.withColumn("v", geo.centered_crop(F.lit(1000.0), F.lit(700.0), F.col("dw"), F.col("dh"), F.col("g"))).select(*_KEY, "v.*")


@query("""SELECT o_orderkey AS id, CASE WHEN o_custkey = 0 THEN 720 ELSE least(8192, greatest(256, least(greatest(o_orderkey + 100, o_custkey * 9), floor(sqrt((o_orderkey % 3 + 1) * 1e6::DOUBLE * (greatest(o_orderkey + 100, o_custkey * 9)::DOUBLE / least(o_orderkey + 100, o_custkey * 9))) + 0.5))))::BIGINT END AS edge FROM orders""")
def g14_work_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(k.alias("id"), geo.work_edge(k % 3 + 1, k + 100, c * 9).alias("edge"))


@query("""SELECT page_id, CASE WHEN length(html) * 5000 > 52428800 THEN 'too large' WHEN page_id % 9 = 0 OR page_id % 9 = 5 THEN 'unsupported type' WHEN page_id * 100 * length(html) > 100000000 THEN 'too many pixels' END AS problem,
  CASE page_id % 4 WHEN 0 THEN 72.0::DOUBLE WHEN 1 THEN 150 WHEN 2 THEN 301 ELSE 226 END AS dpi FROM pages""")
def g15_check_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("page_id"), F.length("html")
    mime = F.when(k % 9 == 0, None).when(k % 9 == 5, "image/tiff").otherwise(" image/png ")
    dpi = geo.image_dpi(F.when(k % 4 == 1, 150).when(k % 4 == 3, 150), F.when(k % 4 == 2, 301).when(k % 4 == 3, 301))
    return table(spark, sf_dir, "pages").select("page_id", geo.upload_problem(n * 5000, mime, k * 100, n, ("image/png", "image/jpeg")).alias("problem"), dpi.alias("dpi"))


@query(f"WITH {CELLS} SELECT image_id, cx, cy, r, g, b FROM cells")
def a1_cell_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    pix = pixels(spark, sf_dir)
    return grid.cell_means(pix, grids(pix))


@query(f"WITH {CELLS} SELECT image_id, cx, cy, r, g, b FROM cells WHERE image_id % 6 <> 5")
def s3_decode_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell grids through their wire form; every sixth payload has lost its end and is refused."""
    pix = pixels(spark, sf_dir)
    sent = grid.encode_cells(grid.cell_means(pix, grids(pix)))
    cut = F.when(F.col("image_id") % 6 == 5, F.expr("substr(cells_b64, 1, length(cells_b64) - 4)")).otherwise(F.col("cells_b64"))
    return grid.decode_cells(sent.withColumn("cells_b64", cut))[0]
