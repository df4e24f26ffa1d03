"""Shared helpers: shared-folder checkpoints, null-safe text, Arrow batch access."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a folder of our own on a local
    master (tests), and an error on a cluster, whose executors would not see it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="chromaloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of a small or medium table with a reliable checkpoint."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder as Parquet and read it back: columnar, prunable, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/chromaloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_key(ident: Column, digest: Column) -> Column:
    """One binary key for an id, null or not, and a hexadecimal digest."""
    return F.unhex(F.sha2(F.concat(digest, F.coalesce(F.concat(F.lit("="), ident.cast("string")), F.lit(""))), 256))


def rows_that_stay(docs: DataFrame, key: Column, stay: DataFrame) -> DataFrame:
    """Of docs' rows with a key in stay (__stay), one for each key. Each task keeps one of a key before the shuffle, and
    the join goes by the same key as the ranking, so docs are shuffled once."""
    place = F.row_number().over(Window.partitionBy("__key").orderBy("__key"))
    rows = docs.withColumn("__key", key).withColumn("__place", place).filter("__place = 1").drop("__place")
    return rows.join(stay.withColumnRenamed("__stay", "__key"), "__key", "left_semi").drop("__key")


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an Arrow string or binary column and its n + 1 offsets; nulls are empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    at = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]] if len(at) else whole, at - at[0] if len(at) else np.zeros(1, np.int64)


def text_bytes(column: pa.Array):
    """Each value of an Arrow string column as UTF-8 bytes, one at a time; nulls are empty."""
    data, at = text_buffer(column)
    view = memoryview(data)
    for i in range(len(at) - 1):
        yield bytes(view[at[i] : at[i + 1]])
