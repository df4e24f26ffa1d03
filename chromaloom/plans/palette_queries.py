"""Palette joins, histograms, reductions and labels over cells of all images, and the grid trace itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color
from ..operators import grid
from ..operators import palette as pal
from ..operators.iterate import checkpoint
from .color_queries import NAMED, de00_sql, lab_sql, munsell
from .inputs import CELLS, CHIPS, PALETTE, PART_CHIPS, grids, oklab_sql, palette, part_chips, pixels, table
from .registry import query


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    pix = pixels(spark, sf_dir)
    return grid.cell_means(pix, grids(pix))


def snapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pal.snap_oklab(cells(spark, sf_dir), palette(spark, sf_dir))


_L, _A, _B = oklab_sql("r", "g", "b")
#: Cells with their nearest chip, as CTEs.
SNAPPED = f"""{CELLS}, {PALETTE},
colors AS (SELECT r, g, b, {_L} AS l, {_A} AS a, {_B} AS bb FROM (SELECT DISTINCT r, g, b FROM cells)),
near AS (SELECT c.r, c.g, c.b, chip_idx, row_number() OVER (PARTITION BY c.r, c.g, c.b ORDER BY round(pow(l - ok_l, 2) + pow(a - ok_a, 2) + pow(bb - ok_b, 2), 12), chip_idx) AS n FROM colors c, palette),
snapped AS (SELECT image_id, cx, cy, r, g, b, chip_idx FROM cells JOIN (SELECT r, g, b, chip_idx FROM near WHERE n = 1) USING (r, g, b))"""
HIST = f"{SNAPPED}, hist AS (SELECT image_id, chip_idx, count(*) AS n FROM snapped GROUP BY ALL)"
TOP = f"{HIST}, kept AS (SELECT image_id, chip_idx, n FROM hist QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY n DESC, chip_idx) <= 8)"
MOVES = f"""{TOP}, moves AS (SELECT h.image_id, h.chip_idx, k.chip_idx AS new_idx FROM hist h JOIN palette p USING (chip_idx) JOIN kept k ON k.image_id = h.image_id JOIN palette q ON q.chip_idx = k.chip_idx
  QUALIFY row_number() OVER (PARTITION BY h.image_id, h.chip_idx ORDER BY CASE WHEN h.chip_idx = k.chip_idx THEN -1 ELSE round(pow(p.ok_l - q.ok_l, 2) + pow(p.ok_a - q.ok_a, 2) + pow(p.ok_b - q.ok_b, 2), 12) END, k.chip_idx) = 1)"""


@query(f"WITH {SNAPPED} SELECT * FROM snapped")
def j1_snap_oklab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapped(spark, sf_dir)


_CLAB = lab_sql("c.r", "c.g", "c.b")
_PLAB = lab_sql("p.r", "p.g", "p.b")


@query(f"""WITH {CELLS}, {PALETTE}, colors AS (SELECT DISTINCT r, g, b FROM cells),
pairs AS (SELECT c.r, c.g, c.b, chip_idx, {', '.join(f'{e} AS {n}' for e, n in zip(_CLAB + _PLAB, ('l1', 'a1', 'b1', 'l2', 'a2', 'b2'), strict=True))} FROM colors c, palette p),
{de00_sql('pairs', 'r, g, b, chip_idx')}, best AS (SELECT r, g, b, chip_idx FROM de QUALIFY row_number() OVER (PARTITION BY r, g, b ORDER BY round(de00, 9), chip_idx) = 1)
SELECT image_id, cx, cy, r, g, b, chip_idx FROM cells JOIN best USING (r, g, b)""")
def j2_snap_ciede2000(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pal.snap_ciede2000(cells(spark, sf_dir), palette(spark, sf_dir))


_MIXED = f"""{CELLS}, {PALETTE}, painted AS (SELECT image_id, cx, cy, CASE WHEN cx % 3 = 0 THEN cells.r ELSE p.r END AS r, CASE WHEN cx % 3 = 0 THEN cells.g ELSE p.g END AS g, CASE WHEN cx % 3 = 0 THEN cells.b ELSE p.b END AS b
  FROM cells JOIN palette p ON p.chip_idx = (cx * 7 + cy) % 64)"""


@query(f"WITH {_MIXED} SELECT image_id, cx, cy, r, g, b, min(chip_idx) AS chip_idx FROM painted JOIN palette USING (r, g, b) GROUP BY ALL")
def j3_lookup_chip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells painted with chips but for every third column; only exact colours are found."""
    chips = palette(spark, sf_dir)
    paint = chips.select(F.col("chip_idx").alias("k"), *(F.col(c).alias(f"p{c}") for c in "rgb"))
    painted = cells(spark, sf_dir).join(paint, F.col("k") == (F.col("cx") * 7 + F.col("cy")) % 64)
    painted = painted.select("image_id", "cx", "cy", *(F.when(F.col("cx") % 3 == 0, F.col(c)).otherwise(F.col(f"p{c}")).alias(c) for c in "rgb"))
    return pal.lookup_chip(painted, chips)[0]


@query(f"WITH {MOVES} SELECT image_id, chip_idx, new_idx FROM moves")
def j4_resnap(spark: SparkSession, sf_dir: str) -> DataFrame:
    hist = pal.chip_histogram(snapped(spark, sf_dir))
    return pal.resnap(hist, pal.top_n_chips(hist, 8), palette(spark, sf_dir))


@query(f"""WITH {CELLS}, {PALETTE}, colors AS (SELECT r, g, b, greatest(0, least(1, {_L} - 0.2::DOUBLE)) AS l, {_A} AS a, {_B} AS bb FROM (SELECT DISTINCT r, g, b FROM cells)),
near AS (SELECT c.r, c.g, c.b, chip_idx FROM colors c, palette QUALIFY row_number() OVER (PARTITION BY c.r, c.g, c.b ORDER BY round(pow(l - ok_l, 2) + pow(a - ok_a, 2) + pow(bb - ok_b, 2), 10), chip_idx) = 1)
SELECT image_id, cx, cy, r, g, b, chip_idx AS inner_idx FROM cells JOIN near USING (r, g, b)""")
def j5_inner_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pal.inner_colors(cells(spark, sf_dir), palette(spark, sf_dir), "darker")


@query(f"""WITH {TOP}, lists AS (SELECT image_id, chip_idx AS full_idx, row_number() OVER (PARTITION BY image_id ORDER BY chip_idx) - 1 AS pos FROM kept)
SELECT image_id, cx, cy, full_idx AS chip_idx FROM cells JOIN lists USING (image_id) WHERE pos = (cx + cy) % 8""")
def j6_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hist = pal.chip_histogram(snapped(spark, sf_dir))
    at = cells(spark, sf_dir).select("image_id", "cx", "cy", ((F.col("cx") + F.col("cy")) % 8).alias("chip_idx"))
    return pal.translate(at, pal.top_n_chips(hist, 8)).select("image_id", "cx", "cy", "chip_idx")


@query(f"""WITH {HIST}, used AS (SELECT image_id, chip_idx, chip_idx AS at_ FROM (SELECT DISTINCT image_id, chip_idx FROM hist))
SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY at_)::INT AS number, chip_idx, notation, color_name FROM used JOIN palette USING (chip_idx)""")
def j7_legend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legend of each image's used chips; the list also names a chip that does not exist."""
    traces = grid.trace_summary(snapped(spark, sf_dir)).select("image_id", F.concat("used", F.array(F.lit(9999))).alias("used"))
    return pal.legend(traces, palette(spark, sf_dir))


@query(f"WITH {CELLS} SELECT image_id, r, g, b, count(*) AS n FROM cells GROUP BY ALL")
def a2_color_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pal.color_histogram(cells(spark, sf_dir))


@query(f"WITH {SNAPPED} SELECT image_id, count(DISTINCT chip_idx) AS n_chips, count(*) AS n_cells, array_to_string(list_sort(list(DISTINCT chip_idx)), ',') AS used FROM snapped GROUP BY image_id")
def a3_trace_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.trace_summary(snapped(spark, sf_dir)).withColumn("used", F.array_join(F.col("used").cast("array<string>"), ","))


@query(f"WITH {SNAPPED} SELECT image_id, cx, cy, r, g, b, chip_idx, dense_rank() OVER (PARTITION BY image_id ORDER BY chip_idx)::INT AS label FROM snapped")
def w1_number_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.number_labels(snapped(spark, sf_dir))


@query(f"WITH {TOP} SELECT * FROM kept")
def w2_top_n_chips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pal.top_n_chips(pal.chip_histogram(snapped(spark, sf_dir)), 8)


GRAYS = "grays AS (SELECT s_suppkey AS id, (s_suppkey * 37 % 100) / 10.0::DOUBLE AS value, 'N' || s_suppkey AS notation FROM supplier)"


def _grays(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("id"), (k * 37 % 100 / 10.0).alias("value"), F.concat(F.lit("N"), k.cast("string")).alias("notation"))


@query(f"WITH {GRAYS} SELECT id, value, notation, 'System Gray ' || CASE WHEN n < 10 THEN '0' ELSE '' END || n AS color_name FROM (SELECT *, row_number() OVER (ORDER BY value, notation) AS n FROM grays)")
def w3_name_grays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pal.name_grays(_grays(spark, sf_dir))


@query(f"WITH {NAMED} SELECT id, bucket || ' ' || row_number() OVER (PARTITION BY bucket ORDER BY hue_pct, v, c, id) AS color_name FROM named")
def w4_name_chips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pal.name_chips(munsell(spark, sf_dir)).select("id", "color_name")


@query(f"WITH {MOVES} SELECT image_id, cx, cy, r, g, b, new_idx AS chip_idx, (SELECT count(*) FROM hist h WHERE h.image_id = snapped.image_id) > 8 AS reduced FROM snapped JOIN moves USING (image_id, chip_idx)")
def d1_reduce_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pal.reduce_top_n(snapped(spark, sf_dir), palette(spark, sf_dir), 8)


@query(f"""WITH {PALETTE}, {GRAYS}, all_ AS (SELECT 0 AS part, chip_idx AS at_, notation FROM palette WHERE chip_idx < 48 UNION ALL SELECT 1, id, notation FROM grays)
SELECT (row_number() OVER (ORDER BY part, at_) - 1)::INT AS chip_idx, notation FROM all_""")
def s4_load_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    grays = _grays(spark, sf_dir).select(F.col("id").cast("int").alias("chip_idx"), "notation")
    return pal.load_palette(palette(spark, sf_dir).select("chip_idx", "notation"), grays, "color", 48)


@query(f"""WITH RECURSIVE {PART_CHIPS}, c AS (SELECT *, chip_idx // {CHIPS} AS palette_id, row_number() OVER (PARTITION BY chip_idx // {CHIPS} ORDER BY chip_idx) AS n FROM part_chips),
polar AS (SELECT palette_id, chip_idx AS name_idx, greatest(0, least(1, ok_l + 0.05::DOUBLE)) AS l, sqrt(ok_a * ok_a + ok_b * ok_b) * 0.9::DOUBLE AS ch, atan2(ok_b, ok_a) + radians(40.0::DOUBLE) AS t FROM c),
names AS (SELECT palette_id, name_idx, l, ch * cos(t) AS a, ch * sin(t) AS b FROM polar),
walk AS (SELECT DISTINCT palette_id, 0::BIGINT AS n, []::INT[] AS taken, NULL::INT AS chip_idx, NULL::INT AS name_idx FROM c
  UNION ALL SELECT w.palette_id, w.n + 1, list_append(w.taken, best.name_idx), c.chip_idx, best.name_idx FROM walk w JOIN c ON c.palette_id = w.palette_id AND c.n = w.n + 1,
    LATERAL (SELECT m.name_idx FROM names m WHERE m.palette_id = w.palette_id AND NOT list_contains(w.taken, m.name_idx) ORDER BY round(pow(m.l - c.ok_l, 2) + pow(m.a - c.ok_a, 2) + pow(m.b - c.ok_b, 2), 12), m.name_idx LIMIT 1) best)
SELECT palette_id::BIGINT AS palette_id, chip_idx, name_idx FROM walk WHERE n > 0""")
def d9_assign_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A palette for every CHIPS parts: each chip takes a name from the list of its palette's colours, turned about."""
    chips = part_chips(spark, sf_dir).withColumn("palette_id", F.floor(F.col("chip_idx") / CHIPS).cast("int"))
    turned = color.adjust_oklab(F.col("ok_l"), F.col("ok_a"), F.col("ok_b"), F.lit(40.0), F.lit(0.05), F.lit(0.9))
    names = chips.select("palette_id", F.col("chip_idx").alias("name_idx"), *(c.alias(n) for c, n in zip(turned, ("ok_l", "ok_a", "ok_b"), strict=True)))
    return pal.assign_names_by(chips, names, "palette_id")


@query(f"""WITH {MOVES}, done AS (SELECT image_id, cx, cy, new_idx AS chip_idx FROM snapped JOIN moves USING (image_id, chip_idx)),
labels AS (SELECT image_id, chip_idx, dense_rank() OVER (PARTITION BY image_id ORDER BY chip_idx)::INT AS label FROM (SELECT DISTINCT image_id, chip_idx FROM done))
SELECT image_id, chip_idx, label, count(*) AS n_cells, min(cx) AS min_cx, max(cx) AS max_cx FROM done JOIN labels USING (image_id, chip_idx) GROUP BY ALL""")
def trace_pixelate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid trace end to end: cell means, nearest chips, at most 8 of them an image, labels; cells of each."""
    done = checkpoint(pal.reduce_top_n(checkpoint(snapped(spark, sf_dir)), palette(spark, sf_dir), 8).select("image_id", "cx", "cy", "chip_idx"))
    return grid.number_labels(done).groupBy("image_id", "chip_idx", "label").agg(F.count("*").alias("n_cells"), F.min("cx").alias("min_cx"), F.max("cx").alias("max_cx"))
