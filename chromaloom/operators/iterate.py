"""Loops over tables with reliable checkpoints: ways up a forest by doubled links; places over a whole table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a folder of our own on a local
    master, and an error on a cluster, whose executors would not see it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="chromaloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The table as Parquet in the shared folder: read by columns, so cheaper than a checkpoint where it is read often."""
    path = f"{shared_dir(df.sparkSession)}/chromaloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def above(links: DataFrame, stops: DataFrame) -> DataFrame:
    """(id, stop, depth): for each id all stops on its way up, itself included, and the least steps to each. links: (id, up);
    stops: (id).

    Ways are doubled: after a round each reaches twice as far or has met a stop. A round in which no way ended leaves only
    ways that go round for ever. So a chain of n links takes log2(n) rounds of two joins, whatever hangs on it; then the
    stops, each with the next one above it, are paired with all above them in the same manner."""
    links = checkpoint(links.select("id", "up").filter("up is not null").distinct())
    stops = checkpoint(stops.select("id").distinct())
    marked = links.join(stops.select(F.col("id").alias("up"), F.lit(True).alias("stop")), "up", "left")
    met = checkpoint(marked.filter("stop").select("id", F.col("up").alias("stop"), F.lit(1).cast("long").alias("depth")))
    ways = checkpoint(marked.filter("stop is null").select("id", F.col("up").alias("at"), F.lit(1).cast("long").alias("depth")))
    before, n = -1, ways.count()
    while n not in (0, before):
        far = ways.select(F.col("id").alias("at"), F.col("at").alias("further"), F.col("depth").alias("more"))
        end = met.select(F.col("id").alias("at"), "stop", F.col("depth").alias("more"))
        met = checkpoint(met.union(ways.join(end, "at").select("id", "stop", (F.col("depth") + F.col("more")).alias("depth"))))
        ways = checkpoint(ways.join(far, "at").select("id", F.col("further").alias("at"), (F.col("depth") + F.col("more")).alias("depth")))
        before, n = n, ways.count()
    own = stops.select("id", F.col("id").alias("stop"), F.lit(0).cast("long").alias("depth"))
    pairs, before = checkpoint(own.union(met.join(stops, "id", "left_semi"))), -1
    while (n := pairs.count()) != before:
        far = pairs.select(F.col("id").alias("stop"), F.col("stop").alias("further"), F.col("depth").alias("more"))
        longer = pairs.join(far, "stop").select("id", F.col("further").alias("stop"), (F.col("depth") + F.col("more")).alias("depth"))
        pairs, before = checkpoint(longer.groupBy("id", "stop").agg(F.min("depth").alias("depth"))), n
    first = met.join(stops, "id", "left_anti").withColumnRenamed("stop", "first").withColumnRenamed("depth", "more")
    rest = first.join(pairs.withColumnRenamed("id", "first"), "first").select("id", "stop", (F.col("depth") + F.col("more")).alias("depth"))
    return pairs.union(rest.groupBy("id", "stop").agg(F.min("depth").alias("depth")))


def numbered(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """df plus ``name``: each row's place from 1 in the order of the columns ``by``, which should tell rows apart.

    Rows are dealt into ranges, stored, and ranked range by range; ranges begin where the ones before them end. No task
    holds more than its range."""
    dealt = checkpoint(df.repartitionByRange(*by).withColumn("__range", F.spark_partition_id()))
    sizes = dealt.groupBy("__range").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("__range", before.alias("__before"))  # one row a range
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*by)) + F.col("__before")
    return dealt.join(F.broadcast(sizes), "__range").withColumn(name, place).drop("__range", "__before")
