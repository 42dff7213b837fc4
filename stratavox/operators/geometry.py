"""Geometry of masks and volumes: boxes, centres, axes, fields of view, crops and orientation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import INDEX, Grid, Grids, affine, placed, with_grid


def bounding_box(mask: DataFrame, by: Sequence[str], grid: Grid | Grids, margin_mm: float = 0.0) -> DataFrame:
    """by, low and high index of each axis with a margin in mm, within the grid."""
    rows = mask.groupBy(*by).agg(*[f(c).alias(f"{c}_{n}") for c in INDEX for f, n in ((F.min, "low"), (F.max, "high"))])
    rows, g = with_grid(rows, grid)
    for axis, c in enumerate(("x", "y", "z")):
        margin = F.rint(margin_mm / g.spacing(axis)).cast("int")
        rows = rows.withColumn(f"{c}_low", F.greatest(F.lit(0), F.col(f"{c}_low") - margin)).withColumn(f"{c}_high", F.least(g.size(axis) - 1, F.col(f"{c}_high") + margin))
    return rows.drop("_grid")


def cropped(voxels: DataFrame, boxes: DataFrame, by: Sequence[str]) -> DataFrame:
    """Voxels inside the box of their case, with indices from the box's corner. Boxes are one row a case."""
    rows = voxels.join(boxes, list(by))
    inside = [F.col(c).between(F.col(f"{c}_low"), F.col(f"{c}_high")) for c in INDEX]
    rows = rows.where(inside[0] & inside[1] & inside[2])
    return rows.select(*[(F.col(c) - F.col(f"{c}_low")).alias(c) if c in INDEX else F.col(c) for c in voxels.columns])


def centre_of_mass(voxels: DataFrame, by: Sequence[str], grid: Grid | Grids, value: str = "v", threshold: float | None = None, mask: bool = False) -> DataFrame:
    """by, cx, cy, cz in mm: of a mask without regard to values, else weighted by them.

    Values below the threshold weigh nothing, negative ones are shifted to 0; without weight it is the centre of the grid.
    """
    if mask:
        weight: Column = F.lit(1.0)
        rows = voxels
    else:
        low = voxels.groupBy(*by).agg(F.least(F.lit(0.0), F.min(value)).alias("_low"))
        rows = voxels.join(low, list(by))
        weight = F.col(value) - F.col("_low")
        weight = F.when(F.col(value) < threshold, 0.0).otherwise(weight) if threshold is not None else weight
    total = F.sum("_w")
    mean = rows.withColumn("_w", weight).groupBy(*by).agg(*[F.when(total > 0, F.try_divide(F.sum(F.col("_w") * F.col(c)), total)).alias(c) for c in INDEX])
    mean, g = with_grid(mean, grid)
    mean = mean.withColumns({c: F.coalesce(F.col(c), (g.size(2 - k) - 1) / 2) for k, c in enumerate(INDEX)}).drop("_grid")
    return placed(mean, grid, ("cx", "cy", "cz")).select(*by, "cx", "cy", "cz")


def covariance(mask: DataFrame, by: Sequence[str], grid: Grid | Grids) -> DataFrame:
    """by, n, centre and the six sample covariances of voxel positions in mm: sums in one pass."""
    rows = placed(mask.select(*by, *INDEX), grid).select(*by, "px", "py", "pz")
    pairs = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *[F.avg(f"p{n}").alias(f"c{n}") for n in "xyz"], *[F.covar_samp(f"p{a}", f"p{b}").alias(f"c{a}{b}") for a, b in pairs])


def principal_axes(mask: DataFrame, by: Sequence[str], grid: Grid | Grids) -> DataFrame:
    """covariance with lengths (roots of the eigenvalues, largest first) and axes (three unit vectors in that order).

    The covariance is one row a case; eigenvectors of 3 by 3 matrices are taken in batches.
    """

    def solved(xx: pd.Series, xy: pd.Series, xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series) -> pd.DataFrame:
        m = np.stack([np.stack([xx, xy, xz], 1), np.stack([xy, yy, yz], 1), np.stack([xz, yz, zz], 1)], 1)
        values, vectors = np.linalg.eigh(np.nan_to_num(m))
        return pd.DataFrame({"lengths": list(np.sqrt(np.maximum(values[:, ::-1], 0))), "axes": [v.T[::-1].ravel() for v in vectors]})

    axes = F.pandas_udf(solved, "lengths array<double>, axes array<double>")
    rows = covariance(mask, by, grid)
    return rows.withColumn("_e", axes("cxx", "cxy", "cxz", "cyy", "cyz", "czz")).select(*rows.columns, "_e.lengths", "_e.axes")


def box_of_grid(size: Sequence[Column], spacing: Sequence[Column], origin: Sequence[Column], direction: Sequence[Column] | None = None) -> dict[str, Column]:
    """Columns low_x .. high_z of the axis-aligned box around the eight corner voxel centres."""
    d = direction or [F.lit(v) for v in (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)]
    out = {}
    for r, name in enumerate("xyz"):
        ends = [d[3 * r + c] * spacing[c] * (size[c] - 1) for c in range(3)]
        out[f"low_{name}"] = origin[r] + sum((F.least(F.lit(0.0), e) for e in ends[1:]), F.least(F.lit(0.0), ends[0]))
        out[f"high_{name}"] = origin[r] + sum((F.greatest(F.lit(0.0), e) for e in ends[1:]), F.greatest(F.lit(0.0), ends[0]))
    return out


def fov_overlap(pairs: DataFrame, a: str = "f_", b: str = "m_") -> DataFrame:
    """pairs with the volume of the common box over that of either side (3 digits), and a warning flag below a quarter."""
    length = lambda p, n: F.col(f"{p}high_{n}") - F.col(f"{p}low_{n}")
    common = [F.greatest(F.lit(0.0), F.least(F.col(f"{a}high_{n}"), F.col(f"{b}high_{n}")) - F.greatest(F.col(f"{a}low_{n}"), F.col(f"{b}low_{n}"))) for n in "xyz"]
    volume = lambda p: length(p, "x") * length(p, "y") * length(p, "z")
    rows = pairs.withColumn("_c", common[0] * common[1] * common[2])
    rows = rows.withColumn("fixed_fraction", F.round(F.try_divide("_c", volume(a)), 3)).withColumn("moving_fraction", F.round(F.try_divide("_c", volume(b)), 3)).drop("_c")
    return rows.withColumn("low_overlap", F.least("fixed_fraction", "moving_fraction") < 0.25)


def reoriented(voxels: DataFrame, grid: Grid, code: str = "LPS") -> tuple[DataFrame, Grid]:
    """Voxels and grid with axes permuted and flipped to a code; no value is interpolated."""
    now = grid.orientation()
    opposite = dict(zip("LRPASI", "RLAPIS", strict=True))
    source = [next(i for i, n in enumerate(now) if n in (c, opposite[c])) for c in code]
    flip = [now[s] != c for s, c in zip(source, code, strict=True)]
    names = "xyz"
    moved = {names[k]: (F.lit(grid.size[s] - 1) - F.col(names[s]) if f else F.col(names[s])) for k, (s, f) in enumerate(zip(source, flip, strict=True))}
    d = np.array(grid.direction).reshape(3, 3)[:, source] * np.where(flip, -1.0, 1.0)
    corner = [grid.size[i] - 1 if f else 0 for i, f in sorted(zip(source, flip, strict=True))]
    origin = tuple(map(float, (grid.matrix @ [*corner, 1.0])[:3]))
    new = Grid(tuple(grid.size[s] for s in source), tuple(grid.spacing[s] for s in source), origin, tuple(map(float, d.ravel())))
    return voxels.select(*[moved[c].alias(c) if c in moved else F.col(c) for c in voxels.columns]), new


def padded(voxels: DataFrame, grid: Grid, multiple: int) -> tuple[DataFrame, Grid]:
    """Voxels and grid grown on both sides to sizes that are multiples, by repeating the edges. No shuffle: edge voxels are copied."""
    size = tuple(-(-n // multiple) * multiple for n in grid.size)
    low = tuple((t - n) // 2 for t, n in zip(size, grid.size, strict=True))
    for axis, n, t, before in zip("xyz", grid.size, size, low, strict=True):
        at = F.col(axis) + before
        first, last = F.when(F.col(axis) == 0, 0).otherwise(at), F.when(F.col(axis) == n - 1, t - 1).otherwise(at)
        voxels = voxels.withColumn(axis, F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    return voxels, grid.cropped(tuple(-v for v in low), size)


def unpadded(voxels: DataFrame, grid: Grid, multiple: int) -> DataFrame:
    """The voxels of a padded volume that the grid had before."""
    for axis, n in zip("xyz", grid.size, strict=True):
        before = (-(-n // multiple) * multiple - n) // 2
        voxels = voxels.where(F.col(axis).between(before, before + n - 1)).withColumn(axis, (F.col(axis) - before).cast("int"))
    return voxels


def moved_points(points: DataFrame, matrix: np.ndarray, columns: Sequence[str], into: Sequence[str]) -> DataFrame:
    """points with the images of three columns under a 4 by 4 matrix."""
    out = affine(matrix, *[F.col(c) for c in columns])
    return points.withColumns(dict(zip(into, out, strict=True)))


def checkerboard(tile: int) -> Column:
    """0 or 1 by tile."""
    return (F.floor(F.col("z") / tile) + F.floor(F.col("y") / tile) + F.floor(F.col("x") / tile)) % 2
