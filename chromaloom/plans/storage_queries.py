"""Stored objects made from the pages, and reports over events and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import reports, storage
from .inputs import IMAGES_SQL, derived, images, plain, table
from .registry import query

_OBJECTS = """SELECT 'bucket' || cast(page_id % 3 AS string) AS bucket_id, CASE WHEN page_id % 4 = 0 THEN 'path/' || cast(page_id * 3 AS string) ELSE substr(url, instr(url, '://') + 3) END AS name,
  CASE WHEN page_id % 10 <> 0 THEN '{{"size": ' || cast(length(html) AS string) || ', "mimetype": "text/html"}}' ELSE '{{}}' END AS metadata, timestamp '2024-01-01 00:00:00' + interval '1' minute * cast(page_id * 37 % 9000 AS int) AS created_at,
  timestamp '2024-05-01 00:00:00' + interval '1' minute * cast(page_id * 11 % 9000 AS int) AS updated_at, page_id AS id FROM {pages}"""
OBJECTS = f"objects AS ({plain(_OBJECTS, 'pages')})"


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, _OBJECTS, "pages")


_FOLDED = "CASE WHEN instr(substr(name, {n} + 1), '/') > 0 THEN left(name, {n} + instr(substr(name, {n} + 1), '/')) END"


@query(f"""WITH {OBJECTS}, o AS (SELECT name, {_FOLDED.format(n=0)} AS p FROM objects WHERE bucket_id = 'bucket1'),
r AS (SELECT DISTINCT left(p, length(p) - 1) AS name, true AS is_folder, p AS k FROM o WHERE p IS NOT NULL UNION ALL SELECT name, false, name FROM o WHERE p IS NULL)
SELECT name, is_folder FROM r WHERE name > 'm' ORDER BY k LIMIT 100""")
def u1_list_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.list_objects(objects(spark, sf_dir), "bucket1", after="m")


@query(f"""WITH {OBJECTS}, o AS (SELECT *, {_FOLDED.format(n=5)} AS p FROM objects WHERE bucket_id = 'bucket0' AND starts_with(name, 'path/')),
r AS (SELECT left(p, length(p) - 1) AS name, min(created_at) AS created_at, min(created_at) AS updated_at, true AS is_folder FROM o WHERE p IS NOT NULL GROUP BY p UNION ALL SELECT name, created_at, updated_at, false FROM o WHERE p IS NULL)
SELECT name, created_at, updated_at, is_folder FROM r WHERE created_at < timestamp '2024-01-05 00:00:00' OR created_at = timestamp '2024-01-05 00:00:00' AND name < 'path/5' ORDER BY created_at DESC, name DESC LIMIT 50""")
def u2_list_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    import datetime

    return storage.list_by_time(objects(spark, sf_dir), "bucket0", "path/", "created_at", False, (datetime.datetime(2024, 1, 5), "path/5"), 50)


@query(f"""WITH {OBJECTS}, o AS (SELECT coalesce({_FOLDED.format(n=0)}, name) AS key, id, created_at FROM objects WHERE bucket_id = 'bucket2')
SELECT key, id, created_at FROM o WHERE key > 'b' QUALIFY row_number() OVER (PARTITION BY key ORDER BY created_at, id) = 1 ORDER BY key LIMIT 100""")
def u3_list_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.list_uploads(objects(spark, sf_dir).withColumnRenamed("name", "key"), "bucket2", after="b")


@query("""WITH a AS (SELECT DISTINCT p_name AS name FROM part WHERE p_partkey % 3 <> 0), b AS (SELECT DISTINCT CASE WHEN p_partkey % 50 = 0 THEN NULL ELSE p_name || CASE WHEN p_size > 40 THEN '*' ELSE '' END END AS name FROM part WHERE p_partkey % 2 = 0)
SELECT name, 'left' AS side FROM (SELECT name FROM a EXCEPT SELECT name FROM b) UNION ALL SELECT name, 'right' FROM (SELECT name FROM b EXCEPT SELECT name FROM a)""")
def u4_set_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    other = F.when(F.col("p_partkey") % 50 != 0, F.concat("p_name", F.when(F.col("p_size") > 40, "*").otherwise("")))
    return storage.set_diff(part.filter("p_partkey % 3 <> 0"), part.filter("p_partkey % 2 = 0").withColumn("p_name", other), "p_name")


_LINES = """SELECT s_suppkey AS pos, CASE WHEN s_suppkey % 10 = 1 THEN 'CREATE INDEX "ix' || cast(s_suppkey AS string) || '" ON t (a)' WHEN s_suppkey % 10 = 2 THEN 'ADD CONSTRAINT "ck' || cast(s_suppkey AS string) || '" CHECK (a)' ELSE '  ' || s_name END AS line FROM {supplier}"""
_FRESH = """SELECT s_suppkey AS pos, CASE WHEN s_suppkey % 10 = 1 AND s_suppkey % 3 = 0 THEN 'CREATE UNIQUE INDEX ix' || cast(s_suppkey AS string) || ' ON t (b)' WHEN s_suppkey % 10 = 1 THEN 'CREATE INDEX "ix' || cast(s_suppkey AS string) || '" ON t (a)'
  WHEN s_suppkey % 10 = 2 THEN 'ADD CONSTRAINT "ck' || cast(s_suppkey AS string) || '" CHECK (b)' WHEN s_suppkey % 10 = 3 THEN '  ' || s_name || ',' WHEN s_suppkey % 40 = 7 THEN 'new ' || s_name ELSE '  ' || s_name END AS line FROM {supplier} WHERE s_suppkey % 10 <> 5"""


@query(f"""WITH c0 AS ({plain(_LINES, 'supplier')}), f0 AS ({plain(_FRESH, 'supplier')}),
nf AS (SELECT *, coalesce('constraint:' || nullif(regexp_extract(line, 'ADD CONSTRAINT "([^"]+)"', 1), ''), 'index:' || nullif(regexp_extract(line, 'CREATE (?:UNIQUE )?INDEX (?:IF NOT EXISTS )?"?([A-Za-z0-9_]+)"?', 1), '')) AS nm, regexp_replace(line, ',\\s*$', '') AS bare FROM f0 WHERE line NOT IN (SELECT line FROM c0)),
nc AS (SELECT *, coalesce('constraint:' || nullif(regexp_extract(line, 'ADD CONSTRAINT "([^"]+)"', 1), ''), 'index:' || nullif(regexp_extract(line, 'CREATE (?:UNIQUE )?INDEX (?:IF NOT EXISTS )?"?([A-Za-z0-9_]+)"?', 1), '')) AS nm, regexp_replace(line, ',\\s*$', '') AS bare FROM c0 WHERE line NOT IN (SELECT line FROM f0)),
a AS (SELECT *, row_number() OVER (PARTITION BY nm ORDER BY pos) AS n FROM nf), b AS (SELECT nm, row_number() OVER (PARTITION BY nm ORDER BY pos) AS n FROM nc WHERE nm IS NOT NULL),
u AS (SELECT * FROM a WHERE nm IS NULL OR NOT EXISTS (SELECT 1 FROM b WHERE b.nm = a.nm AND b.n = a.n)), v AS (SELECT bare, row_number() OVER (PARTITION BY bare ORDER BY pos) AS m FROM u), w AS (SELECT bare, row_number() OVER (PARTITION BY bare ORDER BY pos) AS m FROM nc),
x AS (SELECT * FROM v WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.bare = v.bare AND w.m = v.m)),
k AS (SELECT (SELECT count(*) FROM nf) AS fresh_only, (SELECT count(*) FROM nc) AS committed_only, (SELECT count(*) FROM x) AS unexplained)
SELECT CASE WHEN fresh_only = 0 AND committed_only = 0 THEN 'match' WHEN fresh_only = 0 THEN 'pending_addition' WHEN unexplained = 0 THEN 'pending_redefinition' ELSE 'drift' END AS kind, * FROM k""")
def u5_classify_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.classify_drift(derived(spark, sf_dir, _LINES, "supplier"), derived(spark, sf_dir, _FRESH, "supplier"))


@query(f"""WITH {OBJECTS}, {IMAGES_SQL}, i AS (SELECT DISTINCT coalesce(storage_bucket, 'project_images') AS bucket_id, storage_path AS name FROM own)
SELECT 'orphan_object' AS rule, bucket_id, name FROM objects o WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.bucket_id = o.bucket_id AND i.name = o.name)
UNION ALL SELECT 'missing_object', bucket_id, name FROM i WHERE NOT EXISTS (SELECT 1 FROM objects o WHERE i.bucket_id = o.bucket_id AND i.name = o.name)""")
def u6_orphan_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.orphan_objects(objects(spark, sf_dir), images(spark, sf_dir))


@query(f"WITH {OBJECTS} SELECT bucket_id, sum(json_extract_string(metadata, '$.size')::BIGINT)::BIGINT AS size FROM objects GROUP BY bucket_id")
def a9_size_by_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.size_by_bucket(objects(spark, sf_dir))


_HEADERS = """SELECT o_orderkey AS run_id, 'decode=' || cast(o_orderkey % 91 AS string) || '.5, mean =' || cast(o_custkey % 53 AS string) || ',bad,' || CASE WHEN o_orderkey % 4 = 0 THEN 'encode=x' ELSE 'encode=' || cast(o_orderkey * 7 % 67 AS string) END AS header FROM {orders}"""


@query(f"""WITH h AS ({plain(_HEADERS, 'orders')}), p AS (SELECT run_id, trim(split_part(x, '=', 1)) AS phase, try_cast(split_part(x, '=', 2) AS DOUBLE) AS ms FROM (SELECT run_id, unnest(string_split(header, ',')) AS x FROM h)),
a AS (SELECT phase, ms FROM p WHERE ms IS NOT NULL UNION ALL SELECT 'total', sum(ms) FROM p WHERE ms IS NOT NULL GROUP BY run_id) SELECT phase, list_sort(list(ms))[count(*) // 2 + 1] AS median FROM a GROUP BY phase""")
def a10_phase_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.phase_medians(derived(spark, sf_dir, _HEADERS, "orders"))


_RESULTS = "SELECT cast(event_id % 500 AS string) AS spec_id, CASE WHEN event_type IN ('view', 'click') THEN 'passed' ELSE 'failed' END AS status, cast(CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END AS int) AS retry FROM {events}"


@query(f"""WITH r AS ({plain(_RESULTS, 'events')}), s AS (SELECT spec_id, bool_or(status = 'passed' AND retry > 0) AS flaky FROM r GROUP BY ALL)
SELECT count(*) AS n_specs, count(*) FILTER (flaky) AS n_flaky, count(*) FILTER (flaky) / count(*) AS rate, count(*) FILTER (flaky) > 20 OR count(*) FILTER (flaky) / count(*) > 0.1 AS breach FROM s""")
def a11_flaky_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.flaky_summary(derived(spark, sf_dir, _RESULTS, "events"), 20, 0.1)


#: Old and new trace parameters as JSON text, by order.
_TRACES = """SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'pixelate' WHEN 1 THEN 'circulate' WHEN 2 THEN 'pixelate' ELSE 'linerate' END AS kind,
  CASE o_orderkey % 6 WHEN 0 THEN '{{"texture_enabled":true,"texture_strength":0.25,"dither_mode":"floyd_steinberg"}}' WHEN 1 THEN '{{"dither_mode":"knoll_yliluoma","dither_pattern_size":' || cast(o_orderkey % 5 * 4 AS string) || ',"note":"a b"}}'
   WHEN 2 THEN '{{"texture_enabled":false,"num_colors":' || cast(o_orderkey % 700 AS string) || '}}' WHEN 3 THEN '{{"dither_mode":"none","resolution":"high","detail":1.5}}' WHEN 4 THEN '{{}}' ELSE '{{"num_colors":12.5,"color_mode":"sepia","flatten":0.5}}' END AS params FROM {orders}"""
TRACES = f"traces AS ({plain(_TRACES, 'orders')})"


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, _TRACES, "orders")


@query(f"""WITH {TRACES}, g AS (SELECT id % 6 AS c FROM traces WHERE kind <> 'linerate') SELECT count(*) FILTER (c = 0) AS texture_legacy, count(*) FILTER (c = 1) AS ky_legacy, count(*) FILTER (c = 0) AS double_state FROM g""")
def a12_params_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.params_census(traces(spark, sf_dir))


@query(f"""WITH {TRACES} SELECT id, kind <> 'linerate' AND id % 6 IN (0, 1, 2) AS touched, CASE WHEN kind = 'linerate' THEN params ELSE CASE id % 6 WHEN 0 THEN '{{"dither_mode":"texture","dither_strength":0.25}}'
  WHEN 1 THEN '{{"dither_mode":"knoll_yliluoma","dither_strength":' || CASE id % 5 * 4 WHEN 4 THEN '0.5' WHEN 8 THEN '0.75' WHEN 16 THEN '1.0' ELSE '0.5' END || ',"note":"a b"}}'
  WHEN 2 THEN '{{"dither_mode":"knoll_yliluoma","dither_strength":0.5,"num_colors":' || (id % 700) || '}}' ELSE params END END AS params FROM traces""")
def x9_migrate_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.migrate_params(traces(spark, sf_dir)).select("id", "touched", "params")


@query(f"""WITH {TRACES}, l AS (SELECT id, id % 6 AS c FROM traces WHERE kind = 'linerate') SELECT id, CASE c WHEN 3 THEN 'detail' WHEN 5 THEN 'num_colors,color_mode' ELSE '' END AS problems_text, CASE WHEN c = 5 THEN NULL ELSE 32 END AS num_colors,
  CASE WHEN c = 3 THEN 4 ELSE 2 END AS resolution, CASE WHEN c = 5 THEN 0.5 ELSE 0.25 END AS flatten, CASE WHEN c = 5 THEN NULL ELSE 'color' END AS color_mode FROM l""")
def x10_validate_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reports.validate_params(traces(spark, sf_dir), "linerate")
    return out.select("id", F.array_join(F.sort_array("problems", asc=False), ",").alias("problems_text"), "num_colors", "resolution", "flatten", "color_mode")


@query(f"""WITH {OBJECTS}, s AS (SELECT id, name, string_split(name, '/') AS p FROM objects) SELECT id, p[-1] AS filename, string_split(p[-1], '.')[-1] AS extension, array_to_string(p[:-2], '|') AS folders, {_FOLDED.format(n=2)} AS common FROM s""")
def x11_path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = text.path_parts(F.col("name"))
    return objects(spark, sf_dir).select("id", v["filename"].alias("filename"), v["extension"].alias("extension"), F.array_join(v["folders"], "|").alias("folders"), text.common_prefix(F.col("name"), "ab").alias("common"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 4 IN (0, 3) THEN p_name WHEN p_partkey % 4 = 1 THEN p_name || ' (draft)' ELSE p_name END AS name FROM part""")
def x12_strip_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.get(F.array(*map(F.lit, (" (pixelate)", " (draft)", " (circulate) (B&W warm)", ""))), (F.col("p_partkey") % 4).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.strip_suffix(F.concat("p_name", tail)).alias("name"))


_ERRORS = """SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'auth' END AS stage, CASE event_id % 5 WHEN 0 THEN 'Save (HTTP 500, stage=storage_upload code=x-1): disk full' WHEN 1 THEN 'Load (HTTP 404): gone' WHEN 2 THEN 'stage=Other thing' WHEN 3 THEN '' ELSE event_type END AS message FROM {events}"""


@query(f"""WITH e AS ({plain(_ERRORS, 'events')}), s AS (SELECT *, coalesce(stage, CASE id % 5 WHEN 0 THEN 'storage_upload' WHEN 2 THEN 'other' ELSE 'unknown' END) AS st, CASE id % 5 WHEN 0 THEN 'Save: disk full' WHEN 1 THEN 'Load: gone' WHEN 3 THEN 'Unknown error' ELSE message END AS ms FROM e)
SELECT id, st AS norm_stage, ms AS norm_message, CASE st WHEN 'auth' THEN 'You''re signed out' WHEN 'storage_upload' THEN 'Upload failed' ELSE ms END AS title, st = 'storage_upload' AS retriable FROM s""")
def x13_normalize_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.normalize_errors(derived(spark, sf_dir, _ERRORS, "events")).select("id", "norm_stage", "norm_message", "title", "retriable")
