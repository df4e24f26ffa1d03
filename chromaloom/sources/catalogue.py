"""Paint catalogues from CSV, trace results as partitioned tables."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAINTS = "paint_no string, name string, pigments string, weight_g string"
VARIANTS = "paint_no string, size_ml string, sku string, weight_g string, price_eur string"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Quoted CSV with a header; empty fields are null."""
    return spark.read.csv(path, schema=schema, header=True, quote='"', escape='"', nullValue="", emptyValue="", mode="FAILFAST")


def load_catalogue(paints: DataFrame, variants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(paints, variants) as typed tables: (paint_no, name, pigments array, weight_g) and (paint_no, size_ml, sku,
    weight_g, price_eur).

    A variant has its own weight; a 35 ml one without takes the paint's. Of rows with one paint_no, or one paint_no
    and size, the first by sku (name) counts. A variant of an unknown paint is an error when the rows are read."""
    weight = F.col("weight_g").try_cast("decimal(10,2)")
    first = F.row_number().over(Window.partitionBy("paint_no").orderBy("name"))
    own = paints.withColumn("__n", first).filter("__n = 1").select("paint_no", "name", F.transform(F.split("pigments", ","), lambda p: F.trim(p)).alias("pigments"), weight.alias("weight_g"))
    v = variants.select("paint_no", F.col("size_ml").try_cast("int").alias("size_ml"), "sku", weight.alias("own_weight"), F.col("price_eur").try_cast("decimal(10,2)").alias("price_eur"))
    first = F.row_number().over(Window.partitionBy("paint_no", "size_ml").orderBy(F.asc_nulls_last("sku")))
    v = v.withColumn("__n", first).filter("__n = 1").join(own.select("paint_no", F.col("weight_g").alias("paint_weight"), F.lit(True).alias("known")), "paint_no", "left")
    number = F.when(F.col("known"), F.col("paint_no")).otherwise(F.raise_error(F.concat(F.lit("unknown paint: "), F.col("paint_no"))))
    kept = F.coalesce("own_weight", F.when(F.col("size_ml") == 35, F.col("paint_weight")))
    return own, v.select(number.alias("paint_no"), "size_ml", "sku", kept.alias("weight_g"), "price_eur")


#: Buckets of project_id in a trace table, and how often a run is tried again when another one was first.
TRACE_BUCKETS, TRIES = 64, 5


class Lost(Exception):
    """Another run has written the same version."""


def _files(spark: SparkSession, path: str):
    """(file system, a maker of paths) of a folder in any store that Spark reaches."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def _manifest(spark: SparkSession, path: str) -> tuple[int, dict[str, str]]:
    """(version, folder of each bucket) of a trace table; version 0 has none. A manifest that is not whole yet does not
    count."""
    fs, make = _files(spark, path)
    if not fs.exists(make(f"{path}/manifest")):
        return 0, {}
    names = sorted((s.getPath().getName() for s in fs.listStatus(make(f"{path}/manifest")) if not s.getPath().getName().startswith(".")), reverse=True)
    for name in names:
        stream = fs.open(make(f"{path}/manifest/{name}"))
        try:
            text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        if text.endswith("\n"):
            return int(name), json.loads(text)
    return 0, {}


def _commit(spark: SparkSession, path: str, version: int, buckets: dict[str, str]) -> None:
    """Make a version what readers see. The file is made only where there is none, so of two runs one wins."""
    fs, make = _files(spark, path)
    try:
        stream = fs.create(make(f"{path}/manifest/{version:012}"), False)
    except Py4JJavaError as e:
        if fs.exists(make(f"{path}/manifest/{version:012}")):
            raise Lost(f"version {version} is another run's") from e
        raise
    stream.write(bytearray((json.dumps(buckets, sort_keys=True) + "\n").encode()))
    stream.close()


def _rows_of(spark: SparkSession, path: str, schema: T.StructType, folders: list[str]) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{path}/data").parquet(*(f"{path}/data/{f}" for f in folders)).select(*schema.fieldNames())


def read_traces(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table that write_traces keeps at a path, as its last whole version has it; later runs do not change it."""
    return _rows_of(spark, path, schema, sorted(_manifest(spark, path)[1].values()))


def write_traces(traces: DataFrame, path: str, buckets: int = TRACE_BUCKETS) -> DataFrame:
    """Put trace results into the table at a path, a folder for each bucket of projects and each kind, and return the
    table as it then is.

    A run replaces earlier rows of its (project_id, kind); of rows of one run the last by ``at`` counts, and of those with
    one ``at`` the one with the greatest hash of all its columns. Only buckets of the run's projects are written, into
    folders of their own; a manifest that names the folder of each bucket is written last and makes them the table. So a
    reader sees the table before a run or after it, and what an ended or lost run has left is never read. Where two
    runs meet, the second is made again on what the first has left. A table keeps the number of buckets it began with.
    Folders of earlier versions stay, for readers that still use them. A run of no rows changes nothing."""
    spark, schema = traces.sparkSession, traces.schema
    bucket = lambda n: F.pmod(F.xxhash64("project_id"), F.lit(n)).cast("int")
    for tried in range(TRIES):
        version, held = _manifest(spark, path)
        n = int(next(iter(held)).split("/")[1]) if held else buckets  # keys are bucket/buckets
        rows = traces.withColumn("bucket", bucket(n))
        touched = [r[0] for r in rows.select("bucket").distinct().collect()]  # at most n
        if not touched:
            break
        run = f"run={uuid.uuid4().hex}"
        old = _rows_of(spark, path, schema, [held[f"{b}/{n}"] for b in touched if f"{b}/{n}" in held]).withColumn("bucket", bucket(n))
        both = old.withColumn("__run", F.lit(0)).unionByName(rows.withColumn("__run", F.lit(1)))
        place = F.row_number().over(Window.partitionBy("bucket", "project_id", "kind").orderBy(F.desc("__run"), F.desc("at"), F.desc(F.xxhash64(*schema.fieldNames()))))
        kept = both.withColumn("__n", place).filter("__n = 1").select(*schema.fieldNames(), "bucket")
        kept.write.partitionBy("bucket", "kind").parquet(f"{path}/data/{run}")
        try:
            _commit(spark, path, version + 1, held | {f"{b}/{n}": f"{run}/bucket={b}" for b in touched})
            break
        except Lost:
            if tried + 1 == TRIES:
                raise
    return read_traces(spark, path, schema)
