"""Catalogue joins, audits and upkeep over image lineages made from the customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audits, catalog
from .inputs import FILTERS_SQL, IMAGES_SQL, PALETTE, PROJECTS_SQL, STATES_SQL, WORKSPACES_SQL, derived, filters, images, palette, plain, projects, states, table, workspaces
from .registry import query


@query(f"""WITH {IMAGES_SQL}, {PROJECTS_SQL}, {STATES_SQL}, {WORKSPACES_SQL},
top AS (SELECT * FROM projects ORDER BY updated_at DESC, id LIMIT 100), m AS (SELECT project_id, min(id) AS mid, arg_min(file_size_bytes, id) AS bytes FROM images WHERE kind = 'master' GROUP BY project_id)
SELECT t.id, t.name AS title, t.updated_at, CASE WHEN t.status = 'completed' THEN 'Completed' END AS status_label, CASE WHEN mid IS NOT NULL THEN floor(coalesce(bytes, 0) / 1024 + 0.5)::BIGINT || ' kb' END AS size_label,
  mid IS NOT NULL AS has_thumbnail, w.width_px AS artboard_w, w.height_px AS artboard_h, s.rotation_deg
FROM top t LEFT JOIN m ON m.project_id = t.id LEFT JOIN workspaces w ON w.project_id = t.id LEFT JOIN states s ON s.project_id = t.id AND s.image_id = mid""")
def j10_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.dashboard(projects(spark, sf_dir), images(spark, sf_dir), workspaces(spark, sf_dir), states(spark, sf_dir))


NEWEST = f"{IMAGES_SQL}, newest AS (SELECT * FROM own WHERE kind IN ('filter_working_copy', 'working_copy') QUALIFY row_number() OVER (PARTITION BY project_id, kind ORDER BY coalesce(updated_at, created_at) DESC, id) = 1)"


@query(f"""WITH {NEWEST}, {PROJECTS_SQL}, {FILTERS_SQL}, asked AS (SELECT 'p' || (s_suppkey % 10) AS project_id, (s_suppkey * 4)::VARCHAR AS image_id FROM supplier WHERE s_suppkey % 10 < 3),
a AS (SELECT o.project_id, min(o.id) AS i FROM asked JOIN own o ON o.project_id = asked.project_id AND o.id = asked.image_id GROUP BY ALL), f AS (SELECT o.project_id, min(o.id) AS i FROM filters x JOIN own o ON o.project_id = x.project_id AND o.id = x.output_image_id GROUP BY ALL),
m AS (SELECT project_id, min(id) AS i FROM own WHERE kind = 'master' AND is_active GROUP BY ALL)
SELECT p.id AS project_id, coalesce(a.i, f.i, w.id, m.i) AS source_id FROM projects p LEFT JOIN a ON a.project_id = p.id LEFT JOIN f ON f.project_id = p.id LEFT JOIN newest w ON w.project_id = p.id AND w.kind = 'working_copy' LEFT JOIN m ON m.project_id = p.id""")
def j11_trace_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "supplier").filter("s_suppkey % 10 < 3").selectExpr("'p' || cast(s_suppkey % 10 AS string) AS project_id", "cast(s_suppkey * 4 AS string) AS image_id")
    return catalog.trace_source(projects(spark, sf_dir), images(spark, sf_dir), filters(spark, sf_dir), asked)


@query(f"WITH {NEWEST} SELECT project_id, coalesce(max(id) FILTER (kind = 'filter_working_copy'), max(id) FILTER (kind = 'working_copy')) AS target_id, max(id) FILTER (kind = 'working_copy') AS working_id FROM newest GROUP BY project_id")
def w5_display_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.display_target(images(spark, sf_dir))


_COMPONENTS = """SELECT o_custkey AS recipe_id, o_orderkey % 97 AS paint_id, o_orderkey AS position, cast(CASE WHEN o_orderkey % 3 = 0 THEN 25 WHEN o_orderkey % 3 = 1 THEN 50 ELSE 12.5 END AS decimal(6,2)) AS share_pct FROM {orders}"""
_RECIPES = "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 <> 1 THEN c_custkey % 64 END AS lab_munsell_id, CASE WHEN c_custkey % 3 = 1 OR c_custkey % 7 = 0 THEN c_custkey % 100 END AS lab_custom_id FROM {customer}"


def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, _COMPONENTS, "orders")


@query(f"""WITH {PALETTE}, components AS ({plain(_COMPONENTS, 'orders')}), recipes AS ({plain(_RECIPES, 'customer')}),
lists AS (SELECT recipe_id, string_agg(share_pct::INT::VARCHAR || '% ' || p_name, ', ' ORDER BY position, share_pct::INT::VARCHAR || '% ' || p_name) AS parts FROM (SELECT *, floor(share_pct) AS share FROM components) JOIN part ON p_partkey = paint_id GROUP BY recipe_id)
SELECT r.id AS recipe_id, coalesce(m.notation, 'C' || r.lab_custom_id) AS target, parts FROM recipes r LEFT JOIN palette m ON m.chip_idx = lab_munsell_id LEFT JOIN lists l ON l.recipe_id = r.id WHERE (lab_munsell_id IS NULL) <> (lab_custom_id IS NULL)""".replace("share_pct::INT", "floor(share_pct)::INT"))
def j12_recipe_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    recipes = derived(spark, sf_dir, _RECIPES, "customer")
    munsell = palette(spark, sf_dir).select(F.col("chip_idx").alias("id"), "notation")
    custom = spark.range(100).select("id", F.concat(F.lit("C"), F.col("id").cast("string")).alias("notation"))
    paints = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return catalog.recipe_book(recipes, _components(spark, sf_dir), paints, munsell, custom)


_OTHER = "SELECT s_suppkey, CASE WHEN s_suppkey % 9 = 0 THEN s_name || '!' ELSE s_name END AS s_name, CASE WHEN s_suppkey % 12 = 0 THEN NULL ELSE s_nationkey END AS s_nationkey FROM {supplier} WHERE s_suppkey % 10 <> 0 UNION ALL SELECT s_suppkey + 1000000, s_name, s_nationkey FROM {supplier} WHERE s_suppkey % 25 = 3"


@query(f"""WITH o AS ({plain(_OTHER, 'supplier')}), j AS (SELECT coalesce(a.s_suppkey, b.s_suppkey) AS s_suppkey, CASE WHEN b.s_suppkey IS NULL THEN 'left' WHEN a.s_suppkey IS NULL THEN 'right' ELSE 'both' END AS side,
  CASE WHEN a.s_suppkey IS NULL OR b.s_suppkey IS NULL THEN '' ELSE concat_ws(',', CASE WHEN a.s_name IS DISTINCT FROM b.s_name THEN 's_name' END, CASE WHEN a.s_nationkey IS DISTINCT FROM b.s_nationkey THEN 's_nationkey' END) END AS changed
FROM supplier a FULL JOIN o b ON a.s_suppkey = b.s_suppkey) SELECT * FROM j WHERE side <> 'both' OR changed <> ''""")
def j13_keyed_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.keyed_diff(table(spark, sf_dir, "supplier"), derived(spark, sf_dir, _OTHER, "supplier"), "s_suppkey", ["s_name", "s_nationkey"])


@query(f"WITH {IMAGES_SQL}, {PROJECTS_SQL} SELECT id FROM projects p WHERE EXISTS (SELECT 1 FROM own WHERE project_id = p.id) AND NOT EXISTS (SELECT 1 FROM own WHERE project_id = p.id AND kind = 'master')")
def q1_no_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.no_master(projects(spark, sf_dir), images(spark, sf_dir))


@query(f"WITH {IMAGES_SQL} SELECT project_id, count(*) AS n FROM own WHERE is_active GROUP BY ALL HAVING count(*) > 1")
def q2_multi_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.multi_active(images(spark, sf_dir))


@query(f"WITH {IMAGES_SQL} SELECT project_id, id, source_image_id FROM own WHERE source_image_id IS NOT NULL AND source_image_id NOT IN (SELECT id FROM images)")
def q3_dangling_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.dangling_source(images(spark, sf_dir))


@query(f"WITH {IMAGES_SQL} SELECT a.id, a.project_id, b.project_id AS source_project_id FROM own a JOIN own b ON b.id = a.source_image_id WHERE a.project_id <> b.project_id")
def q4_cross_project_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.cross_project_source(images(spark, sf_dir))


@query(f"""WITH RECURSIVE {IMAGES_SQL}, walk AS (SELECT project_id, id AS start, source_image_id AS cur, [id] AS seen FROM own
  UNION ALL SELECT w.project_id, w.start, o.source_image_id, list_append(w.seen, o.id) FROM walk w JOIN own o ON o.id = w.cur WHERE NOT list_contains(w.seen, o.id))
SELECT DISTINCT project_id, start AS id FROM walk WHERE list_contains(seen, cur)""")
def q5_source_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.source_cycles(images(spark, sf_dir))


@query(f"""WITH RECURSIVE {IMAGES_SQL}, chain AS (SELECT project_id, id FROM own WHERE kind = 'master' UNION SELECT c.project_id, o.id FROM chain c JOIN own o ON o.source_image_id = c.id)
SELECT project_id, id FROM own a WHERE is_active AND NOT EXISTS (SELECT 1 FROM chain c WHERE c.project_id = a.project_id AND c.id = a.id)""")
def q6_unreachable_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.unreachable_active(images(spark, sf_dir))


@query(f"""WITH {IMAGES_SQL}, {STATES_SQL}, m AS (SELECT * FROM own WHERE kind = 'master' AND is_active)
SELECT 'several_active_masters' AS rule, project_id, NULL::VARCHAR AS image_id FROM m GROUP BY project_id HAVING count(*) > 1
UNION ALL SELECT 'master_without_state', project_id, id FROM m WHERE NOT EXISTS (SELECT 1 FROM states s WHERE s.project_id = m.project_id AND s.image_id = m.id)
UNION ALL SELECT 'orphan_state', project_id, image_id FROM states WHERE image_id NOT IN (SELECT id FROM images)""")
def q7_state_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.state_binding(images(spark, sf_dir), states(spark, sf_dir))


@query(f"""WITH {IMAGES_SQL}, {FILTERS_SQL}, j AS (SELECT f.*, i.project_id AS ip, i.id AS ii, o.project_id AS op, o.id AS oi FROM filters f LEFT JOIN images i ON i.id = input_image_id LEFT JOIN images o ON o.id = output_image_id)
SELECT 'bad_type' AS rule, id, project_id FROM j WHERE coalesce(filter_type NOT IN ('bw_hard', 'bw_soft', 'bw_warm'), true) UNION ALL SELECT 'missing_image', id, project_id FROM j WHERE ii IS NULL OR oi IS NULL
UNION ALL SELECT 'cross_project', id, project_id FROM j WHERE ip <> project_id AND oi IS NOT NULL OR op <> project_id AND ii IS NOT NULL
UNION ALL SELECT 'several_filters', NULL, project_id FROM filters GROUP BY project_id HAVING count(*) > 1""")
def q8_filter_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.filter_binding(filters(spark, sf_dir), images(spark, sf_dir))


@query(f"WITH components AS ({plain(_COMPONENTS, 'orders')}) SELECT recipe_id, sum(share_pct)::DOUBLE AS total FROM components GROUP BY recipe_id HAVING sum(share_pct) <> 0 AND (sum(share_pct) < 99.5 OR sum(share_pct) > 100.5)")
def q9_recipe_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.recipe_sums(_components(spark, sf_dir)).withColumn("total", F.col("total").cast("double"))


@query(f"""WITH {IMAGES_SQL}, r AS (SELECT *, crop_rect_px IS NULL AS none, id::BIGINT % 6 AS s, id::BIGINT % 40 AS w FROM images)
SELECT id, 'crop_shape' AS rule FROM r WHERE s = 3 UNION ALL SELECT id, 'crop_whole' FROM r WHERE s IN (2, 3) UNION ALL SELECT id, 'crop_least' FROM r WHERE s = 3 OR s = 1 AND w < 10
UNION ALL SELECT id, 'crop_needs_source' FROM r WHERE NOT none AND source_image_id IS NULL UNION ALL SELECT id, 'master_has_source' FROM r WHERE kind = 'master' AND source_image_id IS NOT NULL
UNION ALL SELECT id, 'needs_source' FROM r WHERE kind <> 'master' AND source_image_id IS NULL UNION ALL SELECT id, 'size' FROM r WHERE width_px <= 0 OR height_px <= 0 UNION ALL SELECT id, 'bytes' FROM r WHERE file_size_bytes < 0""")
def q10_check_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.check_rows(images(spark, sf_dir), audits.image_rules(), "id")


@query(f"""WITH {WORKSPACES_SQL}, {STATES_SQL}, w AS (SELECT *, width_px_u::BIGINT AS wu, height_px_u::BIGINT AS hu FROM workspaces)
SELECT project_id AS key, 'size_range' AS rule FROM w WHERE wu < 1000000 OR wu > 32768000000 OR hu < 1000000 OR hu > 32768000000 UNION ALL SELECT project_id, 'padding_range' FROM w WHERE least(padding_top_px_u::BIGINT, padding_left_px_u::BIGINT) < 0
UNION ALL SELECT project_id, 'cached_px' FROM w WHERE width_px <> greatest(1, (wu + 500000) // 1000000) OR height_px <> greatest(1, (hu + 500000) // 1000000) UNION ALL SELECT project_id, 'page_color' FROM w WHERE page_bg_color = 'white'
UNION ALL SELECT project_id, 'page_opacity' FROM w WHERE page_bg_opacity > 100 UNION ALL SELECT project_id, 'value' FROM w WHERE width_value <= 0
UNION ALL SELECT image_id, 'axis_pair' FROM states WHERE (x_px_u IS NULL) <> (y_px_u IS NULL)""")
def q11_check_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = audits.check_rows(workspaces(spark, sf_dir), audits.workspace_rules(), "project_id").withColumnRenamed("project_id", "key")
    return ws.unionByName(audits.check_rows(states(spark, sf_dir), audits.state_rules(), "image_id").withColumnRenamed("image_id", "key"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def q12_check_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.check_unique(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(f"""WITH RECURSIVE {NEWEST}, {FILTERS_SQL}, w AS (SELECT project_id, id AS start FROM newest WHERE kind = 'working_copy'),
f AS (SELECT f.*, start, row_number() OVER (PARTITION BY f.project_id ORDER BY f.id) AS n FROM filters f LEFT JOIN w ON w.project_id = f.project_id),
walk AS (SELECT project_id, 0::BIGINT AS n, start AS cur, NULL::VARCHAR AS fid, 0 AS step FROM f WHERE n = 1
  UNION ALL SELECT walk.project_id, f.n, CASE WHEN f.input_image_id = cur AND f.output_image_id IS NOT NULL THEN f.output_image_id ELSE cur END, CASE WHEN f.input_image_id = cur AND f.output_image_id IS NOT NULL THEN f.id END,
    walk.step + CASE WHEN f.input_image_id = cur AND f.output_image_id IS NOT NULL THEN 1 ELSE 0 END FROM walk JOIN f ON f.project_id = walk.project_id AND f.n = walk.n + 1)
SELECT f.project_id, f.id AS filter_id, CASE WHEN fid IS NOT NULL THEN step END AS step, (fid IS NOT NULL AND step = max(step) OVER (PARTITION BY f.project_id)) AS tip,
  o.id IS NULL AS output_missing FROM walk JOIN f ON f.project_id = walk.project_id AND f.n = walk.n LEFT JOIN own o ON o.project_id = f.project_id AND o.id = f.output_image_id AND o.kind = 'filter_working_copy'""")
def w11_filter_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.filter_chain(filters(spark, sf_dir), images(spark, sf_dir))


@query(f"""WITH RECURSIVE {IMAGES_SQL}, walk AS (SELECT project_id, id AS root_id, id, 0 AS depth FROM own
  UNION ALL SELECT w.project_id, w.root_id, o.id, w.depth + 1 FROM walk w JOIN own o ON o.source_image_id = w.id AND o.project_id = w.project_id WHERE w.depth < 40)
SELECT project_id, root_id, id, min(depth) AS depth, any_value(storage_bucket) AS storage_bucket, any_value(storage_path) AS storage_path FROM walk JOIN own USING (project_id, id) GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY project_id, root_id, id"))
def l1_delete_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = images(spark, sf_dir)
    return catalog.delete_closure(own, own.select("project_id", F.col("id").alias("image_id")))


_DOOMED = "d AS (SELECT DISTINCT project_id FROM own WHERE kind = 'master')"
_STEP = "list_position(['trace_output', 'trace_base', 'filter_working_copy', 'working_copy', 'master'], kind)"


@query(f"""WITH {IMAGES_SQL}, {FILTERS_SQL}, {_DOOMED} SELECT project_id, 0 AS step, 'filters' AS what, count(*) AS n_rows, NULL::VARCHAR AS bucket FROM filters JOIN d USING (project_id) GROUP BY project_id
UNION ALL SELECT project_id, {_STEP}, kind, count(*), coalesce(storage_bucket, 'project_images') FROM images JOIN d USING (project_id) GROUP BY project_id, kind, coalesce(storage_bucket, 'project_images')""")
def l2_delete_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.delete_plan(images(spark, sf_dir), filters(spark, sf_dir))


@query(f"WITH {IMAGES_SQL}, {_DOOMED} SELECT project_id, {_STEP} AS step, kind AS what, coalesce(storage_bucket, 'project_images') AS bucket, storage_path AS path FROM images JOIN d USING (project_id)")
def l2_delete_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.delete_paths(images(spark, sf_dir))


_WC = f"""{IMAGES_SQL}, nw AS (SELECT id || ':wc' AS id, project_id, 'working_copy' AS kind, false AS is_active, deleted_at, coalesce(name, 'image') || ' (working copy)' AS name, id AS source_image_id FROM own WHERE kind = 'master' AND project_id NOT IN (SELECT project_id FROM own WHERE kind = 'working_copy')),
ev AS (SELECT id, project_id, kind, is_active, deleted_at, name, source_image_id FROM images UNION ALL SELECT * FROM nw), copies AS (SELECT project_id, min(id) AS copy FROM ev WHERE kind = 'working_copy' AND deleted_at IS NULL GROUP BY project_id),
tips AS (SELECT DISTINCT project_id FROM ev WHERE deleted_at IS NULL AND is_active AND kind IN ('filter_working_copy', 'trace_output'))"""


@query(f"""WITH {_WC} SELECT id, e.project_id, kind, name, source_image_id, CASE WHEN deleted_at IS NULL AND copy IS NOT NULL AND kind = 'master' THEN false WHEN deleted_at IS NULL AND id = copy AND e.project_id NOT IN (SELECT project_id FROM tips) THEN true ELSE is_active END AS is_active
FROM ev e LEFT JOIN copies c ON c.project_id = e.project_id""")
def l3_backfill_working_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.backfill_working_copies(images(spark, sf_dir), states(spark, sf_dir))[0].select("id", "project_id", "kind", "name", "source_image_id", "is_active")


@query(f"""WITH {_WC}, {STATES_SQL}, m AS (SELECT s.*, o.id AS mid, c.copy FROM states s LEFT JOIN own o ON o.id = s.image_id AND o.kind = 'master' LEFT JOIN copies c ON c.project_id = s.project_id),
n AS (SELECT project_id, CASE WHEN mid IS NOT NULL AND copy IS NOT NULL THEN copy ELSE image_id END AS image_id, x_px_u, y_px_u, width_px_u, height_px_u, rotation_deg, (mid IS NOT NULL AND copy IS NOT NULL) AS moved, mid FROM m)
SELECT project_id, image_id, x_px_u, y_px_u, width_px_u, height_px_u, rotation_deg FROM n QUALIFY row_number() OVER (PARTITION BY project_id, image_id ORDER BY moved, mid NULLS FIRST) = 1""")
def l3_reanchored_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.backfill_working_copies(images(spark, sf_dir), states(spark, sf_dir))[1]


_ACTIVATIONS = "SELECT 'p' || cast(o_custkey % 12 AS string) AS project_id, cast(o_custkey AS string) AS image_id, o_orderdate AS at FROM {orders}"


@query(f"""WITH {IMAGES_SQL}, act AS ({plain(_ACTIVATIONS, 'orders').replace(' AS at ', ' AS ts ')}), l AS (SELECT a.project_id, image_id FROM act a JOIN own o ON o.project_id = a.project_id AND o.id = a.image_id QUALIFY row_number() OVER (PARTITION BY a.project_id ORDER BY ts DESC, image_id DESC) = 1)
SELECT id, i.project_id, CASE WHEN l.image_id IS NOT NULL AND deleted_at IS NULL THEN id = l.image_id ELSE is_active END AS is_active FROM images i LEFT JOIN l ON l.project_id = i.project_id""")
def l4_rebuild_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.rebuild_active(images(spark, sf_dir), derived(spark, sf_dir, _ACTIVATIONS, "orders")).select("id", "project_id", "is_active")


_UPDATES = """SELECT 'p' || cast(o_custkey % 15 AS string) AS project_id, cast(o_custkey AS string) AS image_id, CASE WHEN o_orderkey % 3 = 0 THEN cast(o_orderkey AS string) END AS x_px_u, CASE WHEN o_orderkey % 2 = 0 THEN cast(o_orderkey * 2 AS string) END AS y_px_u,
  cast(o_orderkey + 1000000 AS string) AS width_px_u, cast(o_orderkey + 2000000 AS string) AS height_px_u, cast(o_orderkey % 360 AS int) AS rotation_deg, o_orderkey AS at FROM {orders}"""


@query(f"""WITH {STATES_SQL}, u AS ({plain(_UPDATES, 'orders').replace(' AS at ', ' AS seq ')}), b AS (SELECT *, -1 AS seq FROM states UNION ALL SELECT * FROM u)
SELECT project_id, image_id, arg_max(x_px_u, seq) AS x_px_u, arg_max(y_px_u, seq) AS y_px_u, last(width_px_u ORDER BY seq) AS width_px_u, last(height_px_u ORDER BY seq) AS height_px_u, last(rotation_deg ORDER BY seq) AS rotation_deg FROM b GROUP BY project_id, image_id""")
def l5_upsert_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.upsert_state(states(spark, sf_dir), derived(spark, sf_dir, _UPDATES, "orders"))
