"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import written


def _least(edges: DataFrame) -> DataFrame:
    """u, m: the smallest of u and its neighbours. The aggregation runs in the map tasks first, so a vertex with many edges is
    not gathered anywhere."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.where(F.col("v") > F.col("u")).join(_least(both), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    moved = down.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """id, component (the smallest id of its component) of every vertex of edges a, b; a vertex without edges is not listed.

    Each round keeps at most as many edges as before and is written to the shared folder; rounds grow with the logarithm of the
    longest path. Loops and repeated edges do no harm. Ids may be of any type that has an order.
    """
    now = written(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where(F.col("u") != F.col("v")).distinct(), "edges")
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        now = written(_small_star(_large_star(now).where(F.col("u") != F.col("v")).distinct()).where(F.col("u") != F.col("v")).distinct(), "edges")
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
