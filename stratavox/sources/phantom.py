"""A closed-form phantom: a body with three organs, generated by Spark for any number of cases and any grid size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import INDEX, Grid
from ..operators.morphology import grid_voxels

# Label, centre and radii as fractions of the size in z, y, x, values in CT and MR; later parts lie over earlier ones.
PARTS = (
    (100, (0.50, 0.50, 0.50), (0.42, 0.40, 0.44), 30.0, 420.0),
    (1, (0.45, 0.42, 0.36), (0.20, 0.17, 0.15), 90.0, 120.0),
    (2, (0.50, 0.45, 0.66), (0.11, 0.10, 0.08), 55.0, 610.0),
    (3, (0.62, 0.62, 0.60), (0.09, 0.08, 0.07), 130.0, 250.0),
)
ORGANS = {1: "liver", 2: "spleen", 3: "kidney_left"}
OUTSIDE = {"CT": -1000.0, "MR": 0.0}
BODY = 100


def part_column(grid: Grid, shift: Sequence[Column | float] = (0, 0, 0)) -> Column:
    """The part at z, y, x of a phantom moved by a shift in voxels (z, y, x): BODY, a label, or 0 outside."""
    n = tuple(reversed(grid.size))
    out: Column = F.lit(0)
    for label, centre, radius, _, _ in PARTS:
        terms = [((F.col(c) - s) - centre[k] * n[k]) / (radius[k] * n[k]) for k, (c, s) in enumerate(zip(INDEX, shift, strict=True))]
        out = F.when(terms[0] * terms[0] + terms[1] * terms[1] + terms[2] * terms[2] <= 1, label).otherwise(out)
    return out


def value_column(part: Column, modality: str = "CT") -> Column:
    column = 3 if modality == "CT" else 4
    out: Column = F.lit(OUTSIDE[modality])
    for p in PARTS:
        out = F.when(part == p[0], p[column]).otherwise(out)
    return out


def phantom(cases: DataFrame, by: Sequence[str], grid: Grid, modality: str = "CT", shift: Sequence[str] = ()) -> DataFrame:
    """by, z, y, x, part, label (0 for none) and v for every voxel of every case; shift names columns of cases (z, y, x)."""
    rows = grid_voxels(cases, by, grid)
    if shift:
        rows = rows.join(cases.select(*by, *shift), list(by))
    rows = rows.withColumn("part", part_column(grid, [F.col(s) for s in shift] or (0, 0, 0)))
    label = F.when(F.col("part") == BODY, 0).otherwise(F.col("part"))
    return rows.select(*by, *INDEX, "part", label.alias("label"), value_column(F.col("part"), modality).alias("v"))
