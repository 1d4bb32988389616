"""Connected components of an edge list, by alternating large and small stars; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import dealt_join, stored


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges u > v: hang the larger (or all smaller) neighbours of each node below its least one."""
    both = edges if not large else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("least"), F.count("*").alias("n")).select("u", F.least("u", "least").alias("least"), "n")
    joined = dealt_join(both, least, "u", count="n") if large else both.join(least.drop("n"), "u")
    if large:
        hung = joined.filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
    else:
        hung = joined.select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(least.select("u", F.col("least").alias("v")))
    return hung.filter("u > v").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of all nodes with an edge; component is the least node. Self loops and repeated edges do no harm.

    Each round is written to the shared folder, so a lost executor costs a round at most; a graph of stars takes two.
    """
    now = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct(), "edges")
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()  # noqa: E731  two numbers
    was = mark(now)
    while was[0]:
        now = stored(_stars(_stars(now, True), False), "stars")
        then = mark(now)
        if then == was:
            break
        was = then
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
