"""Error events and nested test reports from JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Levels of suites within suites that are read in one parse; deeper ones are parsed again from their text.
SUITE_LEVELS = 4


def read_error_events(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """(client, at, body): one JSON text a line, with the event as text in body. streaming: as new files come."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema("client string, at timestamp, body string").json(path)


def report_schema(levels: int = SUITE_LEVELS) -> T.StructType:
    """A report's schema; the suites below the last level are JSON text."""
    results = T.ArrayType(T.StructType().add("status", "string").add("retry", "integer"))
    tests = T.ArrayType(T.StructType().add("results", results))
    specs = T.ArrayType(T.StructType().add("title", "string").add("tests", tests))
    suite = T.StructType().add("title", "string").add("specs", specs).add("suites", "string")
    for _ in range(levels - 1):
        suite = T.StructType().add("title", "string").add("specs", specs).add("suites", T.ArrayType(suite))
    return T.StructType().add("suites", T.ArrayType(suite))


def read_test_report(reports: DataFrame, levels: int = SUITE_LEVELS) -> DataFrame:
    """(report_id, spec_id, title, status, retry): the results in reports (report_id, body), walked level by level.

    title: the suites' titles and the spec's, joined by ' > '; spec_id: its place in the report. A spec without results
    has one row with null status. Suites are read to any depth, ``levels`` at a time; whether there are more is counted."""
    def under(path: Column, title: Column) -> Column:
        return F.concat_ws(" > ", F.nullif(path, F.lit("")), F.nullif(title, F.lit("")))

    def inside(path: Column, at: Column, suites: Column) -> Column:
        """The suites of a list, each with its path of titles and its place."""
        return F.transform(suites, lambda s, i: F.struct(under(path, s["title"]).alias("path"), F.concat_ws(".", F.nullif(at, F.lit("")), i.cast("string")).alias("at"), s.alias("s")))

    def walked(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Of (report_id, path, at, body): the lists of specs of the first ``levels`` levels, and the texts of those below. A
        text is parsed once and its levels are one list, so that a report is read once, not once for each level."""
        here, lists = inside(F.col("path"), F.col("at"), F.col("suites")), []
        for level in range(1, levels + 1):
            lists.append(F.coalesce(F.transform(here, lambda h: F.struct(h["path"].alias("path"), h["at"].alias("at"), h["s"]["specs"].alias("specs"))), F.array()))
            if level < levels:
                here = F.flatten(F.filter(F.transform(here, lambda h: inside(h["path"], h["at"], h["s"]["suites"])), lambda x: x.isNotNull()))
        below = F.filter(F.transform(here, lambda h: F.struct(h["path"].alias("path"), h["at"].alias("at"), h["s"]["suites"].alias("suites"))), lambda h: h["suites"].isNotNull() & (h["suites"] != "[]"))
        parsed = texts.select("report_id", "path", "at", F.from_json("body", report_schema(levels))["suites"].alias("suites"))
        deeper = parsed.select("report_id", F.explode(below).alias("b")).select("report_id", "b.path", "b.at", F.concat(F.lit('{"suites":'), F.col("b.suites"), F.lit("}")).alias("body"))
        return parsed.select("report_id", F.explode(F.concat(*lists)).alias("l")).select("report_id", "l.*"), deeper

    texts, found = reports.select("report_id", F.lit("").alias("path"), F.lit("").alias("at"), "body"), None
    while True:
        lists, deeper = walked(texts)
        specs = lists.select("report_id", "path", "at", F.posexplode("specs").alias("j", "spec"))
        results = F.flatten(F.transform("spec.tests", lambda t: F.coalesce(t["results"], F.array().cast("array<struct<status:string,retry:int>>"))))
        rows = specs.select("report_id", F.concat("at", F.lit("#"), F.col("j").cast("string")).alias("spec_id"), under(F.col("path"), F.col("spec.title")).alias("title"), F.explode_outer(results).alias("x"))
        rows = rows.select("report_id", "spec_id", "title", "x.status", "x.retry")
        found = rows if found is None else found.unionByName(rows)
        if deeper.isEmpty():
            return found
        texts = deeper
