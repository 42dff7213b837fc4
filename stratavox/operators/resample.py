"""Resampling: volumes, labels and fields at the transformed positions of another grid's voxels, or at given points."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..model import INDEX, Grid, Grids, affine, placed
from ..shared import written
from . import bricks
from .morphology import grid_voxels


def applied(matrix: Column, x: Column, y: Column, z: Column) -> list[Column]:
    """A row-major 4 by 4 matrix column over a position."""
    at = lambda r, c: F.get(matrix, F.lit(4 * r + c))
    return [at(r, 0) * x + at(r, 1) * y + at(r, 2) * z + at(r, 3) for r in range(3)]


def resampled(voxels: DataFrame, cases: DataFrame, by: Sequence[str], target: Grid | Grids, source: Grid | Grids, matrix: str | None = None, interpolation: str = "linear", default: float | None = 0.0, value: str = "v", on: Sequence[str] | None = None) -> DataFrame:
    """by, z, y, x, value on the target grid for every case. Positions outside of the source take the default, or the least value of
    the source volume where the default is None, which is background whatever the modality.

    cases has one row a case, with a matrix (fixed to moving, 16 doubles, row-major) where transforms differ by case. ``on`` are the
    key columns that voxels and cases share, if one volume serves several cases. The work is done in bricks.
    """
    on = list(on or by)
    out = bricks.resampled(voxels, cases, by, target, source, matrix, interpolation, value, on)
    kind = voxels.schema[value].dataType
    if default is not None:
        return out.withColumn(value, F.coalesce(F.col(value), F.lit(default)).cast(kind) if isinstance(kind, IntegralType) else F.coalesce(F.col(value), F.lit(default)))
    least = voxels.groupBy(*on).agg(F.min(value).alias("_least"))  # one row a volume
    return out.join(least, on, "left").withColumn(value, F.coalesce(value, "_least").cast(kind)).drop("_least")


def to_spacing(voxels: DataFrame, by: Sequence[str], grid: Grid | Grids, spacing: tuple[float, float, float], interpolation: str = "linear", default: float | None = None) -> tuple[DataFrame, Grid | Grids]:
    """Volume and grid at another spacing over the same extent; unchanged if it has that spacing. What the last voxels of the new grid
    reach beyond the old one takes the default, the volume's least value if None."""
    target = grid.resampled(spacing)
    if target is grid:
        return voxels, grid
    if isinstance(target, Grids):  # one row a case; written, so that what is derived from it stays a short expression
        target = Grids(written(target.table, "grids"), target.by)
    return resampled(voxels, voxels.select(*by).distinct(), by, target, grid, None, interpolation, default), target


def warped_labels(labels: DataFrame, cases: DataFrame, by: Sequence[str], target: Grid | Grids, source: Grid | Grids, matrix: str) -> DataFrame:
    """Labels moved to the target grid by nearest neighbour; only non-zero ones are rows."""
    return resampled(labels, cases, by, target, source, matrix, "nearest", 0, "label").where(F.col("label") != 0)


def displacement_field(cases: DataFrame, by: Sequence[str], grid: Grid | Grids, matrix: str) -> DataFrame:
    """by, z, y, x, dx, dy, dz in mm: where a transform moves every voxel, less where it is."""
    rows = placed(grid_voxels(cases, by, grid), grid).join(cases.select(*by, matrix), list(by))
    q = applied(F.col(matrix), F.col("px"), F.col("py"), F.col("pz"))
    return rows.select(*by, *INDEX, *[(b - F.col(a)).alias(n) for a, b, n in zip(("px", "py", "pz"), q, ("dx", "dy", "dz"), strict=True)])


#: The three parts of a displacement.
FIELD = ("dx", "dy", "dz")


def regridded(field: DataFrame, cases: DataFrame, by: Sequence[str], target: Grid | Grids, source: Grid | Grids) -> DataFrame:
    """A field on another grid, interpolated linearly; nothing moves beyond the field's own grid."""
    out = bricks.resampled(field, cases, by, target, source, None, "linear", FIELD)
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in FIELD})


def through_field(voxels: DataFrame, field: DataFrame, by: Sequence[str], target: Grid | Grids, source: Grid | Grids, cases: DataFrame | None = None, matrix: str | None = None, interpolation: str = "linear", value: str = "v", on: Sequence[str] | None = None) -> DataFrame:
    """by, z, y, x, value on the target grid: the source at p + u(p), or at what a matrix of cases makes of it, for each voxel p of the
    field, which lies on the target grid; NULL outside of the source."""
    # Three indices below 2**20 are one number, which tells the voxels of a case apart.
    packed = F.shiftleft(F.col("z").cast("long"), 40).bitwiseOR(F.shiftleft(F.col("y").cast("long"), 20)).bitwiseOR(F.col("x").cast("long"))
    rows = placed(field.select(*by, *INDEX, *FIELD), target).withColumn("_at", packed)
    p = [F.col(c) + F.col(d) for c, d in zip(("px", "py", "pz"), FIELD, strict=True)]
    if matrix:
        rows = rows.withColumns(dict(zip(("px", "py", "pz"), p, strict=True))).join(cases.select(*by, matrix), list(by))
        p = applied(F.col(matrix), F.col("px"), F.col("py"), F.col("pz"))
    points = rows.select(*by, "_at", *[c.alias(n) for c, n in zip(p, ("qx", "qy", "qz"), strict=True)])
    out = bricks.sampled(points, voxels, by, source, [value], ("qx", "qy", "qz"), "_at", interpolation, on=on)
    index = [F.shiftright("_at", 40), F.shiftright("_at", 20).bitwiseAND((1 << 20) - 1), F.col("_at").bitwiseAND((1 << 20) - 1)]
    return out.select(*by, *[c.cast("int").alias(n) for c, n in zip(index, INDEX, strict=True)], value)


def composed_fields(first: DataFrame, then: DataFrame, by: Sequence[str], grid: Grid | Grids, then_grid: Grid | Grids | None = None) -> DataFrame:
    """by, z, y, x, dx, dy, dz on the first field's grid: where a point goes that is moved by the first field and then by the other.
    NULL where the first one leaves the grid of the other."""
    u = [F.col(c) for c in FIELD]
    packed = F.shiftleft(F.col("z").cast("long"), 40).bitwiseOR(F.shiftleft(F.col("y").cast("long"), 20)).bitwiseOR(F.col("x").cast("long"))
    rows = placed(first.select(*by, *INDEX, *FIELD), grid).withColumn("_at", packed)
    points = rows.select(*by, "_at", *[(F.col(p) + d).alias(q) for p, d, q in zip(("px", "py", "pz"), u, ("qx", "qy", "qz"), strict=True)])
    more = bricks.sampled(points, then, by, then_grid or grid, FIELD, ("qx", "qy", "qz"), "_at").withColumnsRenamed({c: f"_{c}" for c in FIELD})
    out = rows.select(*by, *INDEX, "_at", *FIELD).join(more, [*by, "_at"])
    return out.select(*by, *INDEX, *[(F.col(c) + F.col(f"_{c}")).alias(c) for c in FIELD])


def inverted_field(field: DataFrame, by: Sequence[str], grid: Grid | Grids, tolerance_mm: float = 0.01, most: int = 40) -> DataFrame:
    """by, z, y, x, dx, dy, dz, residual: the field that undoes another one on the same grid, by the fixed point w(p) = -u(p + w(p)).

    Iterated until no voxel that stays within the grid changes by more than the tolerance in mm, or until what is above it no longer
    shrinks; ``residual`` is |w(p) + u(p + w(p))|. NULL where a point leaves the grid, and where the residual stays above the tolerance, as where the field folds. Each round is
    written, so the plan stays short.
    """
    w, before = field.select(*by, *INDEX, *[(-F.col(c)).alias(c) for c in FIELD]), float("inf")
    for _ in range(most):
        there = composed_fields(w, field, by, grid).withColumnsRenamed({c: f"_{c}" for c in FIELD})  # w + u(p + w)
        rows = w.join(there, [*by, *INDEX])
        gap = F.sqrt(sum((F.col(f"_{c}") * F.col(f"_{c}") for c in FIELD[1:]), F.col("_dx") * F.col("_dx")))
        rows = written(rows.select(*by, *INDEX, *FIELD, gap.alias("residual"), *[(F.col(c) - F.col(f"_{c}")).alias(f"_{c}") for c in FIELD]), "inverse")
        left = rows.agg(F.sum(F.when(F.col("residual") > tolerance_mm, F.col("residual")))).first()[0] or 0.0
        if not left or left > 0.99 * before:  # done, or only folded places are left
            break
        before = left
        # A point that has left the grid stays where it left it.
        w = rows.select(*by, *INDEX, *[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) for c in FIELD])
    fine = F.col("residual") <= tolerance_mm
    return rows.select(*by, *INDEX, *[F.when(fine, F.col(c)).alias(c) for c in FIELD], "residual")


def matrix_after_field(field: DataFrame, cases: DataFrame, by: Sequence[str], grid: Grid | Grids, matrix: str) -> DataFrame:
    """by, z, y, x, dx, dy, dz: a field followed by the matrix of its case, as one field."""
    rows = placed(field.select(*by, *INDEX, *FIELD), grid).join(cases.select(*by, matrix), list(by))
    rows = rows.withColumns({f"_{c}": F.col(p) + F.col(c) for c, p in zip(FIELD, ("px", "py", "pz"), strict=True)})
    q = applied(F.col(matrix), *[F.col(f"_{c}") for c in FIELD])
    return rows.select(*by, *INDEX, *[(b - F.col(p)).alias(c) for b, p, c in zip(q, ("px", "py", "pz"), FIELD, strict=True)])


def world_field(field: DataFrame, grid: Grid) -> DataFrame:
    """A field in normalised coordinates (-1 to 1 over the voxel centres) in mm along the world's axes."""
    scaled = [F.col(c) * ((n - 1) / 2 * s) for c, n, s in zip(("dx", "dy", "dz"), grid.size, grid.spacing, strict=True)]
    m = np.eye(4)
    m[:3, :3] = np.array(grid.direction).reshape(3, 3)
    return field.withColumns(dict(zip(("dx", "dy", "dz"), affine(m, *scaled), strict=True)))


def field_at(points: DataFrame, field: DataFrame, by: Sequence[str], grid: Grid | Grids, columns: Sequence[str] = ("px", "py", "pz")) -> DataFrame:
    """points moved by a field, interpolated linearly: mx, my, mz; NULL outside of the grid. points: by, idx and a position."""
    u = FIELD
    moved = bricks.sampled(points, field, by, grid, u, columns)
    out = points.join(moved, [*by, "idx"], "left")
    return out.select(*points.columns, *[(F.col(c) + F.col(d)).alias(m) for c, d, m in zip(columns, u, ("mx", "my", "mz"), strict=True)])
