"""Distances between surfaces: by distance transforms on a common grid, and of any points by cells that double until every point
is settled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import INDEX, Grid, Grids
from ..shared import written
from .morphology import contour
from .planes import squared_distances, step_weights

P = ("px", "py", "pz")


def nearest(a: DataFrame, b: DataFrame, by: Sequence[str], start_mm: float = 4.0) -> DataFrame:
    """by, px, py, pz, d: the distance of every point of a to the nearest of b in the same case; NULL where b has none.

    With cells of side h, a point whose nearest neighbour in the 27 cells around it is within h is settled, since no other can be
    nearer. The rest is tried with cells twice as large; each round joins on a cell, never all points with all.
    """
    todo = written(a.select(*by, *P), "points")
    there = written(b.select(*by, *[F.col(c).alias(f"q{c}") for c in P]), "points")
    todo = todo.join(there.select(*by).distinct(), list(by), "left_semi")
    out = a.select(*by, *P).join(there.select(*by).distinct(), list(by), "left_anti").withColumn("d", F.lit(None).cast("double"))
    h = start_mm
    steps = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip((i, j, k), "ijk", strict=True)]) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    while True:
        cell = lambda c: F.floor(F.col(c) / h)  # noqa: B023, E731
        cells = there.select(*by, *[cell(f"q{c}").alias(f"c{n}") for c, n in zip(P, "ijk", strict=True)], *[f"q{c}" for c in P])
        around = todo.select(*by, *P, F.explode(steps).alias("s")).select(*by, *P, *[(cell(c) + F.col(f"s.{n}")).alias(f"c{n}") for c, n in zip(P, "ijk", strict=True)])
        gap = sum(((F.col(c) - F.col(f"q{c}")) * (F.col(c) - F.col(f"q{c}")) for c in P), F.lit(0.0))
        best = around.join(cells, [*by, "ci", "cj", "ck"], "left").groupBy(*by, *P).agg(F.sqrt(F.min(gap)).alias("d"))
        best = written(best, "nearest")
        sure = F.coalesce(F.col("d") <= h, F.lit(False))
        out = out.unionByName(best.where(sure))
        todo = best.where(~sure).select(*by, *P)
        if not todo.limit(1).count():
            return out
        h *= 2


def surface_points(mask: DataFrame, by: Sequence[str], grid: Grid) -> DataFrame:
    edge = contour(mask, by, grid)
    return edge.select(*by, *[c.alias(n) for c, n in zip(grid.position(*[F.col(c) for c in reversed(INDEX)]), P, strict=True)])


def surface_distances(fixed: DataFrame, moving: DataFrame, by: Sequence[str], grid: Grid | Grids) -> DataFrame:
    """by, hd95, msd in mm (2 digits): the larger of both 95th percentiles, and the mean of both means. NULL if a side is empty.

    Both contours lie on one grid, so the distance to the other one is read off its distance transform."""
    f, m = written(contour(fixed, by, grid), "contour"), written(contour(moving, by, grid), "contour")

    def figures(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
        d = squared_distances(b, by, grid, step_weights, wanted=a)
        d = d.select(*by, F.when(F.col("d2") < float("inf"), F.sqrt("d2")).alias("d"))
        return d.groupBy(*by).agg(F.percentile("d", F.lit(0.95)).alias(f"p{k}"), F.avg("d").alias(f"m{k}"))

    rows = figures(f, m, 1).join(figures(m, f, 2), list(by), "full")
    both = F.col("p1").isNotNull() & F.col("p2").isNotNull()
    return rows.select(*by, F.when(both, F.round(F.greatest("p1", "p2"), 2)).alias("hd95"), F.when(both, F.round((F.col("m1") + F.col("m2")) / 2, 2)).alias("msd"))
