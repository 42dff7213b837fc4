"""Masks as sets of voxels: thresholds, dilation, erosion, closing, contours, components, holes and the body mask."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.statistics import histogram
from ..model import INDEX, Grid, Grids, keys_of, with_grid
from ..shared import written
from .components import components
from .planes import ball_weights, squared_distances

FACES = ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))


#: What a sum of squared fractions of a radius may be above 1 by rounding.
EDGE = 1e-12


def ball(radius_mm: float, grid: Grid) -> list[tuple[int, int, int]]:
    """Offsets (z, y, x) of an ellipsoid of this radius, at least one voxel along each axis; only the voxel itself for 0 or less."""
    if radius_mm <= 0:
        return [(0, 0, 0)]
    rx, ry, rz = (max(1, round(radius_mm / s)) for s in grid.spacing)
    return [(z, y, x) for z in range(-rz, rz + 1) for y in range(-ry, ry + 1) for x in range(-rx, rx + 1) if (x / rx) ** 2 + (y / ry) ** 2 + (z / rz) ** 2 <= 1 + EDGE]


def shifted(mask: DataFrame, by: Sequence[str], offsets: Sequence[tuple[int, int, int]], grid: Grid | Grids) -> DataFrame:
    """The mask moved by each of a few offsets, within the grid, one row for every mask voxel and offset."""
    keys_of(grid, by)
    moves = F.array(*[F.struct(*[F.lit(v).alias(c) for v, c in zip(o, INDEX, strict=True)]) for o in offsets])
    rows, g = with_grid(mask.select(*by, *INDEX), grid)
    rows = rows.select(*by, *INDEX, "_grid", F.explode(moves).alias("_o"))
    rows = rows.select(*by, *[(F.col(c) + F.col(f"_o.{c}")).alias(c) for c in INDEX], "_grid")
    inside = [F.col(c).between(0, g.size(2 - k) - 1) for k, c in enumerate(INDEX)]
    return rows.where(inside[0] & inside[1] & inside[2]).drop("_grid")


def dilated(mask: DataFrame, by: Sequence[str], radius_mm: float, grid: Grid | Grids) -> DataFrame:
    """Voxels with a mask voxel in the ellipsoid of this radius around them, by a distance transform: what is shuffled does not
    depend on the radius."""
    if radius_mm <= 0:
        return mask.select(*by, *INDEX).distinct()
    return squared_distances(mask, by, grid, ball_weights(radius_mm), most=1 + EDGE).drop("d2")


def eroded(mask: DataFrame, by: Sequence[str], radius_mm: float, grid: Grid | Grids) -> DataFrame:
    """Mask voxels without a voxel of the grid in the ellipsoid around them that is not in the mask; beyond the grid counts as mask."""
    if radius_mm <= 0:
        return mask.select(*by, *INDEX).distinct()
    return squared_distances(mask, by, grid, ball_weights(radius_mm), least=1 + EDGE, outside=True).drop("d2")


def closed(mask: DataFrame, by: Sequence[str], radius_mm: float, grid: Grid | Grids) -> DataFrame:
    return eroded(dilated(mask, by, radius_mm, grid), by, radius_mm, grid)


def contour(mask: DataFrame, by: Sequence[str], grid: Grid | Grids) -> DataFrame:
    """Mask voxels with a face neighbour outside of the mask or of the grid."""
    near = shifted(mask, by, FACES, grid).groupBy(*by, *INDEX).agg(F.count("*").alias("_n"))
    return mask.select(*by, *INDEX).distinct().join(near, [*by, *INDEX], "left").where(F.coalesce(F.col("_n"), F.lit(0)) < 6).select(*by, *INDEX)


def runs(mask: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, z, y, low, high, run: maximal runs along x, each with an id of its own."""
    line = Window.partitionBy(*by, "z", "y")
    rows = mask.select(*by, *INDEX).distinct().withColumn("_g", F.col("x") - F.row_number().over(line.orderBy("x")))
    out = rows.groupBy(*by, "z", "y", "_g").agg(F.min("x").alias("low"), F.max("x").alias("high")).drop("_g")
    return out.withColumn("run", F.struct(*by, "z", "y", "low"))


def labelled(mask: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, z, y, x, component: face-connected components, named by their first run.

    Runs along x are the vertices, far fewer than voxels; two runs of neighbouring lines are joined where they touch.
    """
    r = runs(mask, by)
    lines = r.withColumn("_n", F.explode(F.array(F.struct((F.col("z") + 1).alias("z"), F.col("y").alias("y")), F.struct(F.col("z").alias("z"), (F.col("y") + 1).alias("y")))))
    other = lines.select(*by, F.col("_n.z").alias("z"), F.col("_n.y").alias("y"), F.col("low").alias("l2"), F.col("high").alias("h2"), F.col("run").alias("b"))
    touching = r.join(other, [*by, "z", "y"]).where((F.col("low") <= F.col("h2")) & (F.col("l2") <= F.col("high")))
    found = components(touching.select(F.col("run").alias("a"), "b"))
    rows = r.join(found, r["run"] == found["id"], "left").withColumn("component", F.coalesce("component", "run"))
    return rows.select(*by, "z", "y", F.explode(F.sequence("low", "high")).alias("x"), "component")


def largest_component(mask: DataFrame, by: Sequence[str]) -> DataFrame:
    """Voxels of each case's largest component; of equally large ones the first."""
    rows = labelled(mask, by)
    sizes = rows.groupBy(*by, "component").agg(F.count("*").alias("n"))
    best = sizes.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("n"), "component")).alias("b")).select(*by, F.col("b.component").alias("component"))
    return rows.join(best, [*by, "component"]).select(*by, *INDEX)


def grid_voxels(cases: DataFrame, by: Sequence[str], grid: Grid | Grids) -> DataFrame:
    """All voxels of the grid for every case."""
    rows = cases.select(*by).distinct()
    if isinstance(grid, Grid):
        for k, c in enumerate(INDEX):
            rows = rows.withColumn(c, F.explode(F.sequence(F.lit(0), F.lit(grid.size[2 - k] - 1))))
        return rows
    keys_of(grid, by)
    rows, g = with_grid(rows, grid)
    for k, c in enumerate(INDEX):
        rows = rows.withColumn(c, F.explode(F.sequence(F.lit(0), g.size(2 - k) - 1)))
    return rows.drop("_grid")


def filled(mask: DataFrame, by: Sequence[str], grid: Grid | Grids) -> DataFrame:
    """The mask with its holes: background components that do not touch the border of the grid."""
    outside = labelled(grid_voxels(mask, by, grid).join(mask, [*by, *INDEX], "left_anti"), by)
    outside, g = with_grid(outside, grid)
    border = F.lit(False)
    for k, c in enumerate(INDEX):
        border = border | (F.col(c) == 0) | (F.col(c) == g.size(2 - k) - 1)
    holes = outside.groupBy(*by, "component").agg(F.bool_or(border).alias("open")).where(~F.col("open"))
    return mask.select(*by, *INDEX).unionByName(outside.join(holes, [*by, "component"], "left_semi").select(*by, *INDEX))


def otsu(df: DataFrame, by: Sequence[str], value: str = "v", bins: int = 128) -> DataFrame:
    """by, threshold: the bin centre whose split has the largest variance between classes, the first of equal ones."""
    h = histogram(df, by, value, bins)
    upto, whole = Window.partitionBy(*by).orderBy("bin"), Window.partitionBy(*by)
    s = F.col("n") * F.col("centre")
    rows = h.select(*by, "bin", "centre", F.sum("n").over(upto).alias("n0"), F.sum(s).over(upto).alias("s0"), F.sum("n").over(whole).alias("n"), F.sum(s).over(whole).alias("s"))
    n1 = F.col("n") - F.col("n0")
    gap = F.try_divide("s0", "n0") - F.try_divide(F.col("s") - F.col("s0"), n1)
    rows = rows.withColumn("between", F.round(F.col("n0") * n1 * gap * gap / (F.col("n") * F.col("n")), 9))
    best = F.struct((-F.coalesce(F.col("between"), F.lit(-1.0))).alias("b"), "bin", "centre")
    return rows.groupBy(*by).agg(F.min(best).alias("_b")).select(*by, F.col("_b.centre").alias("threshold"))


def body_mask(voxels: DataFrame, by: Sequence[str], grid: Grid | Grids, modality: str, close_mm: float = 5.0) -> DataFrame:
    """The body: tissue by a fixed range for CT that has air in it and by Otsu's threshold otherwise, closed, the largest
    component, filled."""
    split = otsu(voxels, by).join(voxels.groupBy(*by).agg(F.min("v").alias("_min")), list(by))
    fixed = F.lit(modality.upper() in ("CT", "CBCT")) & (F.col("_min") < -200)
    tissue = F.when(fixed, F.col("v").between(-300, 4000)).otherwise(F.col("v") > F.col("threshold"))
    mask = voxels.join(split, list(by)).where(tissue).select(*by, *INDEX)
    # Components read their mask several times, so each step is written once.
    tissue = written(closed(mask, by, close_mm, grid), "tissue")
    return filled(written(largest_component(tissue, by), "body"), by, grid)
