"""Connected components of a table of links, as rounds of Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut_lineage


def _to_least(links: DataFrame, larger: bool) -> DataFrame:
    """Point the neighbours of each node that are larger (or the node and those that
    are not) at the least of its neighbours and itself."""
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if larger else both.filter("v < u")
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    moved = near.join(least, "u")
    if larger:
        out = moved.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v: long) that isn't its own root;
    the root is the smallest node within reach. Each round first moves larger
    neighbours, then smaller ones, to the least; a star around every root is the only
    state that stays, so the loop ends when a round changes nothing. Nodes with very
    many links are only ever aggregated or joined, never gathered."""
    now = cut_lineage(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if seen == mark or not seen["n"]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = seen
        now = cut_lineage(_to_least(_to_least(now, True), False))
