"""Inputs of the queries, derived from the given tables by unique keys; and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pixels of an image (more orders make more images), pixels of a row, pixels of a cell's side, chips of the palette.
IMAGE, WIDTH, CELL, CHIPS = 600, 24, 4, 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, x, y, r, g, b): one pixel for each order."""
    k = F.col("o_orderkey")
    n = k % IMAGE
    return table(spark, sf_dir, "orders").select(
        F.floor(k / IMAGE).alias("image_id"),
        (n % WIDTH).cast("int").alias("x"),
        F.floor(n / WIDTH).cast("int").alias("y"),
        ((F.col("o_custkey") * 37) % 256).cast("int").alias("r"),
        (F.floor("o_totalprice").cast("long") % 256).cast("int").alias("g"),
        ((k * 17) % 256).cast("int").alias("b"),
    )


PIXELS = f"""pixels AS (SELECT o_orderkey // {IMAGE} AS image_id, ((o_orderkey % {IMAGE}) % {WIDTH})::INT AS x, ((o_orderkey % {IMAGE}) // {WIDTH})::INT AS y,
  ((o_custkey * 37) % 256)::INT AS r, (floor(o_totalprice)::BIGINT % 256)::INT AS g, ((o_orderkey * 17) % 256)::INT AS b FROM orders)"""


def grids(pix: DataFrame) -> DataFrame:
    """(image_id, width, height, cells_x, cells_y) of each image: whole cells of CELL pixels."""
    size = pix.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    return size.select("image_id", "width", "height", *(F.greatest(F.lit(1), F.floor(F.col(c) / CELL)).cast("int").alias(n) for c, n in (("width", "cells_x"), ("height", "cells_y"))))


CELLS = f"""{PIXELS},
grids AS (SELECT image_id, max(x) + 1 AS width, max(y) + 1 AS height, greatest(1, (max(x) + 1) // {CELL})::INT AS cells_x, greatest(1, (max(y) + 1) // {CELL})::INT AS cells_y FROM pixels GROUP BY image_id),
cells AS (SELECT image_id, least(cells_x - 1, (x * cells_x) // width)::INT AS cx, least(cells_y - 1, (y * cells_y) // height)::INT AS cy,
  floor(avg(r) + 0.5)::INT AS r, floor(avg(g) + 0.5)::INT AS g, floor(avg(b) + 0.5)::INT AS b FROM pixels JOIN grids USING (image_id) GROUP BY ALL)"""


_HUES = ("R", "YR", "Y", "GY", "G", "BG", "B", "PB", "P", "RP")


def palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chip_idx, r, g, b, ok_l, ok_a, ok_b, notation, color_name): CHIPS chips, each made from all parts of its share."""
    from ..operators.palette import held_palette, with_oklab

    k = F.col("chip_idx")
    own = table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % CHIPS).cast("int").alias("chip_idx"))
    own = own.agg(F.sum(F.col("p_size").cast("long")).alias("sizes"), F.count("*").alias("parts"), F.min("p_size").alias("p_size"), F.min("p_name").alias("color_name"))
    chips = own.select(
        "chip_idx",
        ((k * 53) % 256).cast("int").alias("r"),
        ((k * 101 + 40 + F.col("sizes")) % 256).cast("int").alias("g"),
        ((k * 197 + 90 + F.col("parts")) % 256).cast("int").alias("b"),
        _notation("p_size", k).alias("notation"),
        "color_name",
    )
    return held_palette(with_oklab(chips))


def _notation(size: str, k: Column) -> Column:
    return F.concat(F.col(size).cast("string"), F.element_at(F.array(*map(F.lit, _HUES)), (k % 10 + 1).cast("int")), F.lit(" 5/6"))


def part_chips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chip_idx, r, g, b, ok_l, ok_a, ok_b, notation, color_name): a chip for every part."""
    from ..operators.palette import with_oklab

    k = F.col("p_partkey")
    chips = table(spark, sf_dir, "part").select(
        k.cast("int").alias("chip_idx"),
        ((k * 53) % 256).cast("int").alias("r"),
        ((k * 101 + 40) % 256).cast("int").alias("g"),
        ((k * 197 + 90) % 256).cast("int").alias("b"),
        _notation("p_size", k).alias("notation"),
        F.col("p_name").alias("color_name"),
    )
    return with_oklab(chips)


def lin(c: str) -> str:
    return f"(CASE WHEN ({c}) / 255.0::DOUBLE <= 0.04045 THEN (({c}) / 255.0::DOUBLE) / 12.92::DOUBLE ELSE pow((({c}) / 255.0::DOUBLE + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END)"


def oklab_sql(r: str, g: str, b: str) -> tuple[str, str, str]:
    from ..functions.color import LAB, LMS

    cone = [f"cbrt({' + '.join(f'{k}::DOUBLE * {lin(c)}' for k, c in zip(row, (r, g, b), strict=True))})" for row in LMS]
    return tuple("(" + " + ".join(f"({k})::DOUBLE * {c}" for k, c in zip(row, cone, strict=True)) + ")" for row in LAB)


_L, _A, _B = oklab_sql("r", "g", "b")
_HUE = f"({list(_HUES)})[(k % 10 + 1)::INT] || ' 5/6'"
PALETTE = f"""own AS (SELECT (p_partkey % {CHIPS})::INT AS k, sum(p_size)::BIGINT AS sizes, count(*) AS parts, min(p_size) AS p_size, min(p_name) AS color_name FROM part GROUP BY ALL),
chips AS (SELECT k AS chip_idx, ((k * 53) % 256)::INT AS r, ((k * 101 + 40 + sizes) % 256)::INT AS g, ((k * 197 + 90 + parts) % 256)::INT AS b, p_size || {_HUE} AS notation, color_name FROM own),
palette AS (SELECT *, {_L} AS ok_l, {_A} AS ok_a, {_B} AS ok_b FROM chips)"""
#: A chip for every part.
PART_CHIPS = f"""keyed AS (SELECT *, p_partkey AS k FROM part), part_rgb AS (SELECT k::INT AS chip_idx, ((k * 53) % 256)::INT AS r, ((k * 101 + 40) % 256)::INT AS g, ((k * 197 + 90) % 256)::INT AS b, p_size || {_HUE} AS notation, p_name AS color_name FROM keyed),
part_chips AS (SELECT *, {_L} AS ok_l, {_A} AS ok_a, {_B} AS ok_b FROM part_rgb)"""


def derived(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    """An input whose SQL both engines read: {name} stands for a given table."""
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})


def plain(sql: str, *names: str) -> str:
    """The same SQL for a view of each table's own name."""
    return sql.format(**{n: n for n in names})


def _up(k: str) -> str:
    """The ancestor under 10 that dividing by four leads to."""
    steps = " ".join(f"WHEN {k} < {10 * 4**i} THEN cast(floor({k} / {4**i}) AS bigint)" for i in range(14))
    return f"(CASE {steps} END)"


#: Image lineage: parent = key / 4 below a project's master, with lost, foreign and circular links.
_IMAGES = f"""SELECT cast(c_custkey AS string) AS id,
  'p' || cast(CASE WHEN c_custkey % 89 = 0 AND c_custkey > 9 THEN ({_up('c_custkey')} + 1) % 10 ELSE {_up('c_custkey')} END AS string) AS project_id,
  cast(CASE WHEN c_custkey < 10 THEN NULL WHEN c_custkey % 97 = 0 THEN c_custkey + 100000000 WHEN c_custkey % 211 = 0 THEN c_custkey + 1 WHEN c_custkey % 211 = 1 THEN c_custkey - 1
    ELSE cast(floor(c_custkey / 4) AS bigint) END AS string) AS source_image_id,
  CASE WHEN c_custkey = 3 THEN 'working_copy' WHEN c_custkey < 10 THEN 'master' WHEN c_custkey < 40 THEN 'working_copy' WHEN c_custkey % 3 = 0 THEN 'filter_working_copy' WHEN c_custkey % 3 = 1 THEN 'trace_base' ELSE 'trace_output' END AS kind,
  (c_custkey % 50 = 7 OR c_custkey < 5) AS is_active, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'bucket' || cast(c_custkey % 3 AS string) END AS storage_bucket,
  'path/' || cast(c_custkey AS string) AS storage_path, c_name AS name,
  CASE WHEN c_custkey % 23 = 0 AND c_custkey > 9 THEN timestamp '2024-06-01 00:00:00' END AS deleted_at, timestamp '2024-01-01 00:00:00' + interval '1' minute * cast(c_custkey * 7 % 5000 AS int) AS created_at,
  CASE WHEN c_custkey % 4 <> 0 THEN timestamp '2024-02-01 00:00:00' + interval '1' minute * cast(c_custkey * 13 % 4000 AS int) END AS updated_at,
  cast(c_nationkey * 100 AS int) AS width_px, cast((c_nationkey + 1) * 80 AS int) AS height_px, cast(floor(c_acctbal * 1000) AS bigint) AS file_size_bytes,
  CASE WHEN c_custkey % 6 = 1 THEN '{{{{"x":1,"y":2,"w":' || cast(c_custkey % 40 AS string) || ',"h":20}}}}' WHEN c_custkey % 6 = 2 THEN '{{{{"x":1.5,"y":2,"w":30,"h":20}}}}' WHEN c_custkey % 6 = 3 THEN '{{{{"x":1,"y":2,"w":30}}}}' END AS crop_rect_px
  FROM {{customer}}"""
IMAGES_SQL = f"images AS ({plain(_IMAGES, 'customer')}), own AS (SELECT * FROM images WHERE deleted_at IS NULL)"


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, _IMAGES, "customer")


_PROJECTS = """SELECT 'p' || cast(n_nationkey AS string) AS id, n_name AS name, CASE WHEN n_nationkey % 3 = 0 THEN 'completed' ELSE 'draft' END AS status,
  timestamp '2024-03-01 00:00:00' + interval '1' minute * cast(n_nationkey * 7 % 11 AS int) AS updated_at FROM {nation}"""
PROJECTS_SQL = f"projects AS ({plain(_PROJECTS, 'nation')})"


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, _PROJECTS, "nation")


_FILTERS = """SELECT 'f' || cast(s_suppkey AS string) AS id, 'p' || cast(s_suppkey % 12 AS string) AS project_id,
  cast(CASE WHEN s_suppkey % 10 < 4 THEN s_suppkey % 12 * 4 + s_suppkey % 4 ELSE s_suppkey + 7 END AS string) AS input_image_id,
  CASE WHEN s_suppkey % 17 = 0 THEN NULL ELSE cast(s_suppkey + 19 AS string) END AS output_image_id,
  CASE s_suppkey % 5 WHEN 0 THEN 'bw_hard' WHEN 1 THEN 'bw_soft' WHEN 2 THEN 'bw_warm' WHEN 3 THEN 'sepia' END AS filter_type FROM {supplier}"""
FILTERS_SQL = f"filters AS ({plain(_FILTERS, 'supplier')})"


def filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, _FILTERS, "supplier")


_STATES = """SELECT 'p' || cast(s_suppkey % 15 AS string) AS project_id, cast(CASE WHEN s_suppkey % 9 = 8 THEN s_suppkey + 50000000 ELSE s_suppkey END AS string) AS image_id,
  CASE WHEN s_suppkey % 4 <> 0 THEN cast(s_suppkey * 1000 AS string) END AS x_px_u, CASE WHEN s_suppkey % 6 <> 0 THEN cast(s_suppkey * 2000 AS string) END AS y_px_u,
  cast(s_suppkey * 1000000 AS string) AS width_px_u, cast(s_suppkey * 1500000 AS string) AS height_px_u, cast(s_suppkey % 360 AS int) AS rotation_deg FROM {supplier}"""
STATES_SQL = f"states AS ({plain(_STATES, 'supplier')})"


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, _STATES, "supplier")


_WORKSPACES = """SELECT 'p' || cast(s_suppkey AS string) AS project_id, cast(CASE WHEN s_suppkey % 8 = 0 THEN 500000 ELSE s_suppkey * 1234567 END AS string) AS width_px_u, cast(s_suppkey * 7654321 + 1000000 AS string) AS height_px_u,
  cast(s_suppkey * 1000 - 5000 AS string) AS padding_top_px_u, '0' AS padding_right_px_u, '1000000' AS padding_bottom_px_u, CASE WHEN s_suppkey = 4 THEN '-1' ELSE '0' END AS padding_left_px_u,
  cast(greatest(1, floor((s_suppkey * 1234567 + 500000) / 1000000)) AS int) AS width_px, cast(floor((s_suppkey * 7654321 + 1500000) / 1000000) + CASE WHEN s_suppkey % 13 = 0 THEN 1 ELSE 0 END AS int) AS height_px,
  CASE WHEN s_suppkey % 7 = 0 THEN 'white' ELSE '#ffFF00' END AS page_bg_color, cast(s_suppkey * 3 % 120 AS int) AS page_bg_opacity, s_acctbal AS width_value, 10.5 AS height_value FROM {supplier}"""
WORKSPACES_SQL = f"workspaces AS ({plain(_WORKSPACES, 'supplier')})"


def workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, _WORKSPACES, "supplier")
