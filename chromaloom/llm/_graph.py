"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import checkpoint

#: A chain of n links needs about log2(n) ** 2 steps; beyond this something is wrong.
MOST_STEPS = 60


def component_roots(links: DataFrame) -> DataFrame:
    """Links (a, b) -> (node, root): the least node of its component for every node that has a link.

    Both steps aggregate by node before they join, so a hub with many links is pre-aggregated and its join
    can be split by adaptive execution. Each step is checkpointed; links never reach the driver.
    """
    edges = checkpoint(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    mark = _mark(edges)
    for _ in range(MOST_STEPS):
        if not mark[0]:
            break
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = checkpoint(small.union(least.select("a", F.col("m").alias("b"))).distinct())
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {MOST_STEPS} steps")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _mark(edges: DataFrame) -> tuple:
    """A count and an order-free checksum: two tables with the same mark are taken as equal."""
    mixed = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.bit_xor(mixed), F.sum(F.shiftright(mixed, 16))).first())
