"""Stored objects: folder listings, sizes, orphans, set differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import common_prefix
from .catalog import DEFAULT_BUCKET, live


def _under(objects: DataFrame, bucket: str, prefix: str) -> DataFrame:
    return objects.filter((F.col("bucket_id") == bucket) & F.col("name").startswith(prefix))


def list_objects(objects: DataFrame, bucket: str, prefix: str = "", delimiter: str = "/", after: str = "", limit: int = 100, ascending: bool = True) -> DataFrame:
    """(name, is_folder): first-level folders below a prefix, without their delimiter, and the objects there.

    In bytewise order (descending on request), past the cursor ``after``, at most ``limit`` entries. A cursor
    that is a folder skips what is in it."""
    own = _under(objects, bucket, prefix).withColumn("__p", common_prefix(F.col("name"), prefix, delimiter))
    folders = own.filter("__p is not null").select(F.expr(f"substr(__p, 1, length(__p) - {len(delimiter)})").alias("name"), F.lit(True).alias("is_folder")).distinct()
    leaves = own.filter("__p is null").select("name", F.lit(False).alias("is_folder"))
    rows = folders.unionByName(leaves)
    key = F.when(F.col("is_folder"), F.concat("name", F.lit(delimiter))).otherwise(F.col("name"))
    if after:
        past = (F.col("name") > after) if ascending else (F.col("name") < after)
        rows = rows.filter(past)
    return rows.withColumn("__k", key).orderBy(F.col("__k").asc() if ascending else F.col("__k").desc()).limit(limit).drop("__k")


def list_by_time(objects: DataFrame, bucket: str, prefix: str = "", column: str = "created_at", ascending: bool = True, after: tuple | None = None, limit: int = 100) -> DataFrame:
    """As list_objects by time: (name, created_at, updated_at, is_folder). A folder's times are its first creation.

    Time counts in whole milliseconds; after: (time, name) of the last entry seen; a null time sorts as 1970."""
    own = _under(objects, bucket, prefix).withColumn("__p", common_prefix(F.col("name"), prefix))
    folders = own.filter("__p is not null").groupBy(F.expr("substr(__p, 1, length(__p) - 1)").alias("name")).agg(F.min("created_at").alias("created_at"))
    folders = folders.select("name", "created_at", F.col("created_at").alias("updated_at"), F.lit(True).alias("is_folder"))
    leaves = own.filter("__p is null").select("name", "created_at", "updated_at", F.lit(False).alias("is_folder"))
    at = F.coalesce(F.date_trunc("millisecond", F.col(column)), F.timestamp_seconds(F.lit(0)))
    rows = folders.unionByName(leaves).withColumn("__at", at)
    if after is not None:
        t, name = F.lit(after[0]), F.lit(after[1])
        same = (F.col("__at") == t) & ((F.col("name") > name) if ascending else (F.col("name") < name))
        rows = rows.filter(((F.col("__at") > t) if ascending else (F.col("__at") < t)) | same)
    order = [F.col(c).asc() if ascending else F.col(c).desc() for c in ("__at", "name")]
    return rows.orderBy(*order).limit(limit).drop("__at")


def list_uploads(uploads: DataFrame, bucket: str, prefix: str = "", delimiter: str = "/", after: str = "", limit: int = 100) -> DataFrame:
    """(key, id, created_at): unfinished uploads, folded to folders, the earliest of each key (ties: least id).
    The prefix is matched without case."""
    own = uploads.filter((F.col("bucket_id") == bucket) & F.lower("key").startswith(prefix.lower()))
    own = own.withColumn("key", F.coalesce(common_prefix(F.col("key"), prefix, delimiter), F.col("key")))
    if after:
        own = own.filter(F.col("key") > after)
    first = own.groupBy("key").agg(F.min(F.struct("created_at", "id")).alias("x"))
    return first.orderBy("key").limit(limit).select("key", "x.id", "x.created_at")


def size_by_bucket(objects: DataFrame) -> DataFrame:
    """(bucket_id, size): bytes by metadata.size; objects without a size count as none."""
    size = F.get_json_object("metadata", "$.size").try_cast("bigint")
    return objects.groupBy("bucket_id").agg(F.sum(size).alias("size"))


def set_diff(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """(name, side): distinct names only in a (left) or only in b (right); null is a name like any other."""
    x, y = a.select(F.col(column).alias("name")), b.select(F.col(column).alias("name"))
    return x.subtract(y).withColumn("side", F.lit("left")).unionByName(y.subtract(x).withColumn("side", F.lit("right")))


def orphan_objects(objects: DataFrame, images: DataFrame) -> DataFrame:
    """(rule, bucket_id, name): objects that no live image names, and live images whose object is missing."""
    rows = live(images).filter("storage_path is not null").select(F.coalesce("storage_bucket", F.lit(DEFAULT_BUCKET)).alias("bucket_id"), F.col("storage_path").alias("name")).distinct()
    kept = objects.select("bucket_id", "name")
    lost = rows.join(kept, ["bucket_id", "name"], "left_anti").select(F.lit("missing_object").alias("rule"), "bucket_id", "name")
    return kept.join(rows, ["bucket_id", "name"], "left_anti").select(F.lit("orphan_object").alias("rule"), "bucket_id", "name").unionByName(lost)


def classify_drift(committed: DataFrame, fresh: DataFrame) -> DataFrame:
    """(kind, fresh_only, committed_only, unexplained): how a fresh snapshot of lines differs from the committed one.

    match; pending_addition: nothing is only in the fresh one; pending_redefinition: each fresh line pairs with a
    committed one of the same constraint or index name, else of the same text but for a last comma; drift.
    Lines: (line, pos). Pairs are made one to one, in order, within each name and each text.
    """
    def only(x: DataFrame, y: DataFrame) -> DataFrame:
        return x.join(y.select("line").distinct(), "line", "left_anti")

    def name(c):
        constraint = F.nullif(F.regexp_extract(c, 'ADD CONSTRAINT "([^"]+)"', 1), F.lit(""))
        index = F.nullif(F.regexp_extract(c, 'CREATE (?:UNIQUE )?INDEX (?:IF NOT EXISTS )?"?([A-Za-z0-9_]+)"?', 1), F.lit(""))
        return F.coalesce(F.concat(F.lit("constraint:"), constraint), F.concat(F.lit("index:"), index))

    def paired(x: DataFrame, y: DataFrame, key: str) -> DataFrame:
        """Rows of x without a partner of the same key and place in y."""
        place = F.row_number().over(Window.partitionBy(key).orderBy("pos"))
        return x.withColumn("__n", place).join(y.filter(F.col(key).isNotNull()).withColumn("__n", place).select(key, "__n"), [key, "__n"], "left_anti").drop("__n")

    bare = F.regexp_replace("line", r",\s*$", "")
    f = only(fresh, committed).withColumns({"__name": name(F.col("line")), "__bare": bare})
    c = only(committed, fresh).withColumns({"__name": name(F.col("line")), "__bare": bare})
    named = f.filter("__name is null").unionByName(paired(f.filter("__name is not null"), c, "__name").select(*f.columns))
    rest = paired(named, c, "__bare")
    counts = [df.agg(F.count("*").alias(n)) for df, n in ((f, "fresh_only"), (c, "committed_only"), (rest, "unexplained"))]
    out = counts[0].crossJoin(counts[1]).crossJoin(counts[2])
    kind = F.when((F.col("fresh_only") == 0) & (F.col("committed_only") == 0), "match").when(F.col("fresh_only") == 0, "pending_addition").when(F.col("unexplained") == 0, "pending_redefinition").otherwise("drift")
    return out.select(kind.alias("kind"), "fresh_only", "committed_only", "unexplained")
