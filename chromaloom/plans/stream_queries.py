"""Streams over the events, and sources and sinks through the session's shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reports
from ..operators.iterate import shared_dir
from ..sources import catalogue, events, images
from ..streaming import errors, srs
from .inputs import IMAGE, PIXELS, WIDTH, derived, pixels, plain, table
from .learning_queries import SRS
from .registry import query


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/chromaloom-{uuid.uuid4().hex}"


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of its files."""
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")


_HITS = "SELECT user_id AS key, {ms} AS t, event_id AS seq FROM {events}"
LIMITED = f"""hits AS ({_HITS.format(ms="epoch_us(ts) // 1000", events="events")}), h AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t, seq) AS n FROM hits),
walk AS (SELECT key, n, t, seq, t AS begun, 1 AS c FROM h WHERE n = 1 UNION ALL SELECT h.key, h.n, h.t, h.seq, CASE WHEN h.t - w.begun > 3600000 THEN h.t ELSE w.begun END, CASE WHEN h.t - w.begun > 3600000 THEN 1 ELSE w.c + 1 END FROM walk w JOIN h ON h.key = w.key AND h.n = w.n + 1)"""


@query(f"WITH RECURSIVE {LIMITED} SELECT key, t, seq, c > 2 AS limited FROM walk")
def w10_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return errors.rate_limit(derived(spark, sf_dir, _HITS.replace("{ms}", "unix_millis(cast(ts AS timestamp))"), "events"), 2, 3_600_000)


@query(f"WITH RECURSIVE {LIMITED} SELECT key, t, seq, c > 2 AS limited FROM walk")
def t2_rate_limit_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _event_stream(spark, sf_dir).select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"))
    return errors.run_to_table(errors.rate_limit_stream(hits, 2, 3_600_000), _folder(spark)).drop("batch")


def _bodies(df: DataFrame) -> DataFrame:
    """A JSON body for each event; some are broken, too long, or lack their message."""
    k = F.col("event_id")
    message = F.when(k % 8 == 0, "7").when(k % 50 == 1, F.concat(F.lit('"'), F.repeat(F.lit("m"), 5000), F.lit('"'))).otherwise(F.concat(F.lit('"m'), k.cast("string"), F.lit('"')))
    digest = F.when(k % 3 == 0, "0123abcd-0123-4567-89ab-0123456789ab").otherwise("short")
    severity = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "warn").otherwise("info")
    text = F.concat(F.lit('{"message":'), message, F.lit(',"digest":"'), digest, F.lit('","severity":"'), severity, F.lit('","code":"c'), (k % 7).cast("string"), F.lit('","stage":5,"context":{"k":'), k.cast("string"), F.lit("}}"))
    text = F.when(k % 31 == 5, "not json").when(k % 101 == 7, F.concat(F.lit('{"message":"'), F.repeat(F.lit("x"), 40_000), F.lit('"}'))).otherwise(text)
    return df.select(k.alias("event_id"), F.col("user_id").cast("string").alias("client"), text.alias("body"))


BODIES = """b AS (SELECT event_id AS k, user_id::VARCHAR AS client, CASE WHEN event_id % 8 = 0 THEN NULL WHEN event_id % 50 = 1 THEN repeat('m', 4000) ELSE 'm' || event_id END AS message,
  CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'view' THEN 'warn' ELSE 'info' END AS severity, event_id % 31 = 5 AS broken, event_id % 101 = 7 AND event_id % 31 <> 5 AS big FROM events),
c AS (SELECT *, CASE WHEN big THEN 'too_large' WHEN broken THEN 'invalid_json' WHEN message IS NULL THEN 'missing_message' END AS problem FROM b)"""


@query(f"""WITH {BODIES} SELECT k AS event_id, client, problem, CASE WHEN big THEN 4000 WHEN NOT broken THEN length(message) END AS n_message, CASE WHEN NOT big AND NOT broken AND k % 3 = 0 THEN '0123abcd-0123-4567-89ab-0123456789ab' END AS digest,
  CASE WHEN NOT big AND NOT broken THEN severity END AS severity, CASE WHEN NOT big AND NOT broken THEN 'c' || (k % 7) END AS code, NULL::VARCHAR AS stage, CASE WHEN NOT big AND NOT broken THEN '{{"k":' || k || '}}' END AS context FROM c""")
def t1_sanitize_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = errors.run_to_table(errors.sanitize_events(_bodies(_event_stream(spark, sf_dir))).drop("body"), _folder(spark))
    return out.select("event_id", "client", "problem", F.length("message").alias("n_message"), "digest", "severity", "code", "stage", "context")


@query(f"""WITH {BODIES} SELECT client, CASE severity WHEN 'error' THEN '🔴' ELSE '🟡' END || ' *' || upper(severity) || '* — ? / c' || (k % 7) || chr(10) || '> ' || left(message, 600) || chr(10) || '```json' || chr(10) || '{{"k":' || k || '}}' || chr(10) || '```' AS text
FROM c WHERE problem IS NULL AND severity <> 'info'""")
def t3_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return errors.run_to_table(errors.alerts(errors.sanitize_events(_bodies(_event_stream(spark, sf_dir)))), _folder(spark)).drop("batch")


@query(f"WITH RECURSIVE {SRS} SELECT * FROM srs")
def t4_srs_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = F.when(F.col("event_type").isin("purchase", "signup"), "correct").when(F.col("event_type") == "view", "almost").otherwise("wrong")
    answers = _event_stream(spark, sf_dir).select(F.col("user_id").alias("user"), F.get_json_object("props", "$.k").cast("int").alias("item_id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), result.alias("result"))
    return srs.latest(errors.run_to_table(srs.srs_stream(answers), _folder(spark), "update"))


_FULL = f"WITH {PIXELS} SELECT image_id, x, y, r, g, b FROM pixels QUALIFY count(*) OVER (PARTITION BY image_id, y) = {WIDTH}"


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    pix = pixels(spark, sf_dir)
    return images.pack_images(pix.join(pix.groupBy("image_id", "y").count().filter(F.col("count") == WIDTH).drop("count"), ["image_id", "y"]))


@query(f"{_FULL} AND count(*) OVER (PARTITION BY image_id) = {IMAGE}")
def s1_read_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full images, written as PNG files to the shared folder and read back."""
    folder = _folder(spark)
    images.write_images(_packed(spark, sf_dir).filter(F.col("height") * F.col("width") == IMAGE), folder)
    return images.to_pixels(images.read_images(spark, folder).withColumn("image_id", F.regexp_extract("image_id", "([0-9]+)[.]png$", 1).cast("long")))


@query(_FULL)
def s2_to_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full rows of each image, packed as the image source packs them and unpacked again."""
    return images.to_pixels(_packed(spark, sf_dir))


_PAINTS = "SELECT 'n' || cast(p_partkey AS string) AS paint_no, p_name || ', \"' || p_type || '\"' AS name, 'PB' || cast(p_size AS string) || ', PW4' AS pigments, CASE WHEN p_partkey % 3 > 0 THEN cast(p_partkey % 90 AS string) || '.5' END AS weight_g FROM {part}"
_VARIANTS = "SELECT 'n' || cast(p_partkey - p_partkey % 4 AS string) AS paint_no, CASE p_partkey % 3 WHEN 0 THEN '35' WHEN 1 THEN '120' ELSE '200' END AS size_ml, 's' || cast(p_partkey AS string) AS sku, CASE WHEN p_partkey % 5 = 0 THEN cast(p_size AS string) END AS weight_g, CASE WHEN p_partkey % 4 = 0 THEN '9.90' END AS price_eur FROM {part}"


@query(f"""WITH p AS ({plain(_PAINTS, 'part')}), v AS ({plain(_VARIANTS, 'part')}), f AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY paint_no, size_ml::INT ORDER BY sku) = 1)
SELECT f.paint_no, size_ml::INT AS size_ml, sku, coalesce(f.weight_g::DOUBLE, CASE WHEN size_ml = '35' THEN p.weight_g::DOUBLE END) AS weight_g, price_eur::DOUBLE AS price_eur, array_to_string(list_transform(string_split(p.pigments, ','), lambda x: trim(x)), '+') AS pigments, p.name FROM f JOIN p ON p.paint_no = f.paint_no""")
def s5_load_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paints and variants of the parts through CSV files."""
    folder = _folder(spark)
    for name, sql in (("paints", _PAINTS), ("variants", _VARIANTS)):
        derived(spark, sf_dir, sql, "part").write.csv(f"{folder}/{name}", header=True, quote='"', escape='"')
    paints, variants = catalogue.load_catalogue(catalogue.read_csv(spark, f"{folder}/paints", catalogue.PAINTS), catalogue.read_csv(spark, f"{folder}/variants", catalogue.VARIANTS))
    out = variants.join(paints.select("paint_no", "pigments", "name"), "paint_no")
    return out.select("paint_no", "size_ml", "sku", F.col("weight_g").cast("double").alias("weight_g"), F.col("price_eur").cast("double").alias("price_eur"), F.array_join("pigments", "+").alias("pigments"), "name")


@query("SELECT user_id::VARCHAR AS client, date_trunc('millisecond', ts) AS at_time, (length(event_type) + 2)::INT AS n FROM events WHERE event_type = 'error'")
def s6_read_error_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error events written as JSON lines and read as a stream."""
    folder = _folder(spark)
    own = table(spark, sf_dir, "events").filter("event_type = 'error'")
    own.select(F.col("user_id").cast("string").alias("client"), F.col("ts").cast("timestamp").alias("at"), F.concat(F.lit('"'), F.col("event_type"), F.lit('"')).alias("body")).write.json(f"{folder}/in")
    read = errors.run_to_table(events.read_error_events(spark, f"{folder}/in", streaming=True), f"{folder}/out")
    return read.select("client", F.date_trunc("millisecond", F.col("at")).cast("timestamp_ntz").alias("at_time"), F.length("body").alias("n"))


@query("""SELECT user_id AS report_id, (event_id % 2) || CASE WHEN event_id % 4 >= 2 THEN '.0' ELSE '' END || '#' || (row_number() OVER (PARTITION BY user_id, event_id % 4 ORDER BY event_id) - 1) AS spec_id,
  's' || (event_id % 2) || CASE WHEN event_id % 4 >= 2 THEN ' > inner' ELSE '' END || ' > t' || event_id AS title, event_type AS status, (event_id % 3)::INT AS retry FROM events""")
def s7_read_test_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as a report of two suites, each with specs of its own and in an inner suite."""
    k = F.col("event_id")
    spec = F.struct(k.alias("k"), F.concat(F.lit("t"), k.cast("string")).alias("title"), F.array(F.struct(F.array(F.struct(F.col("event_type").alias("status"), (k % 3).cast("int").alias("retry"))).alias("results"))).alias("tests"))
    lists = table(spark, sf_dir, "events").groupBy("user_id").agg(*(F.sort_array(F.collect_list(F.when(k % 4 == i, spec))).alias(f"l{i}") for i in range(4)))
    suites = F.array(*(F.struct(F.lit(f"s{i}").alias("title"), F.col(f"l{i}").alias("specs"), F.array(F.struct(F.lit("inner").alias("title"), F.col(f"l{i + 2}").alias("specs"))).alias("suites")) for i in (0, 1)))
    bodies = lists.select(F.col("user_id").alias("report_id"), F.to_json(F.struct(suites.alias("suites"))).alias("body"))
    return events.read_test_report(bodies)


_TRACES = "SELECT o_custkey AS project_id, CASE o_orderkey % 3 WHEN 0 THEN 'pixelate' WHEN 1 THEN 'circulate' ELSE 'linerate' END AS kind, o_orderkey AS at, cast(floor(o_totalprice) AS bigint) AS n_shapes FROM {orders}"


@query("""WITH t AS (SELECT o_custkey AS project_id, CASE o_orderkey % 3 WHEN 0 THEN 'pixelate' WHEN 1 THEN 'circulate' ELSE 'linerate' END AS kind, o_orderkey AS seq, floor(o_totalprice)::BIGINT AS n_shapes FROM orders)
SELECT project_id, kind, seq, n_shapes FROM t QUALIFY row_number() OVER (PARTITION BY project_id, kind ORDER BY seq % 2 DESC, seq DESC) = 1""")
def s8_write_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs, the even orders and then the odd ones, upserted into one table."""
    own, folder = derived(spark, sf_dir, _TRACES, "orders"), _folder(spark)
    catalogue.write_traces(own.filter("at % 2 = 0"), folder)
    return catalogue.write_traces(own.filter("at % 2 = 1"), folder).withColumnRenamed("at", "seq")


@query("""WITH s AS (SELECT user_id, event_id, bool_or(event_type = 'view' AND event_id % 3 > 0) AS flaky FROM events GROUP BY ALL) SELECT count(*) AS n_specs, count(*) FILTER (flaky) AS n_flaky, count(*) FILTER (flaky) / count(*) AS rate, count(*) FILTER (flaky) > 5 OR count(*) FILTER (flaky) / count(*) > 0.5 AS breach FROM s""")
def flaky_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flaky specs of the nested reports; a viewed event counts as passed."""
    own = s7_read_test_report(spark, sf_dir)
    status = F.when(F.col("status") == "view", "passed").otherwise("failed")
    return reports.flaky_summary(own.select(F.concat_ws("/", F.col("report_id").cast("string"), "spec_id").alias("spec_id"), status.alias("status"), "retry"), 5, 0.5)
