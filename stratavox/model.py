"""Data model: volumes as tables of voxels, and the grid that places them in space.

A volume is ``voxels(volume_id, z, y, x, v)``, a label map ``labels(volume_id, z, y, x, label)`` with non-zero rows only, a
vector field ``field(volume_id, z, y, x, dx, dy, dz)`` in mm. Arrays are in order z, y, x; sizes, spacings and positions in
order x, y, z. Only this module converts between the two. Undefined figures are NULL, never NaN.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOXELS = "volume_id long, z int, y int, x int, v double"
LABELS = "volume_id long, z int, y int, x int, label int"
FIELD = "volume_id long, z int, y int, x int, dx double, dy double, dz double"
IDENTITY = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)
INDEX = ("z", "y", "x")


@dataclass(frozen=True)
class Grid:
    """Size, spacing and origin in x, y, z; direction as a row-major 3 by 3 matrix."""

    size: tuple[int, int, int]
    spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)
    origin: tuple[float, float, float] = (0.0, 0.0, 0.0)
    direction: tuple[float, ...] = IDENTITY

    @property
    def n_voxels(self) -> int:
        return self.size[0] * self.size[1] * self.size[2]

    @property
    def voxel_ml(self) -> float:
        return self.spacing[0] * self.spacing[1] * self.spacing[2] / 1000.0

    @property
    def extent(self) -> tuple[float, ...]:
        return tuple(n * s for n, s in zip(self.size, self.spacing, strict=True))

    @property
    def matrix(self) -> np.ndarray:
        """Index (x, y, z, 1) to physical position, 4 by 4."""
        m = np.eye(4)
        m[:3, :3] = np.array(self.direction).reshape(3, 3) * np.array(self.spacing)
        m[:3, 3] = self.origin
        return m

    @property
    def centre(self) -> tuple[float, ...]:
        return tuple(map(float, (self.matrix @ [*((n - 1) / 2 for n in self.size), 1.0])[:3]))

    def same_as(self, other: Grid, atol: float = 1e-4) -> bool:
        close = lambda a, b: np.allclose(a, b, atol=atol)
        return self.size == other.size and close(self.spacing, other.spacing) and close(self.origin, other.origin) and close(self.direction, other.direction)

    def orientation(self) -> str:
        """Three letters: the anatomical side that x, y and z grow towards (L/R, P/A, S/I)."""
        d = np.array(self.direction).reshape(3, 3)
        letters = (("R", "L"), ("A", "P"), ("I", "S"))
        return "".join(letters[r := int(np.abs(d[:, c]).argmax())][int(d[r, c] > 0)] for c in range(3))

    def position(self, x: Column, y: Column, z: Column) -> list[Column]:
        return affine(self.matrix, x, y, z)

    def index(self, px: Column, py: Column, pz: Column) -> list[Column]:
        """Continuous index of a physical position."""
        return affine(np.linalg.inv(self.matrix), px, py, pz)

    def contains(self, x: Column, y: Column, z: Column) -> Column:
        """Whether a continuous index is within the voxel centres, by a hair's breadth more."""
        inside = F.lit(True)
        for c, n in zip((x, y, z), self.size, strict=True):
            inside = inside & (c >= -1e-9) & (c <= n - 1 + 1e-9)
        return inside

    def resampled(self, spacing: tuple[float, float, float]) -> Grid:
        """The grid over the same extent with another spacing; itself if it has that spacing."""
        if np.allclose(self.spacing, spacing, atol=1e-4):
            return self
        size = tuple(max(1, round(n * s / t)) for n, s, t in zip(self.size, self.spacing, spacing, strict=True))
        return Grid(size, spacing, self.origin, self.direction)

    def cropped(self, low: tuple[int, int, int], size: tuple[int, int, int]) -> Grid:
        origin = tuple(map(float, (self.matrix @ [*low, 1.0])[:3]))
        return Grid(size, self.spacing, origin, self.direction)

    def column(self) -> Column:
        """The grid as a literal struct of type GRID."""
        array = lambda v, kind: F.array(*[F.lit(kind(x)) for x in v])
        return F.struct(array(self.size, int).alias("size"), array(self.spacing, float).alias("spacing"), array(self.origin, float).alias("origin"), array(self.direction, float).alias("direction"))


GRID = "struct<size: array<int>, spacing: array<double>, origin: array<double>, direction: array<double>>"


def grid_from(row: object) -> Grid:
    """The Grid of a struct of type GRID, as a Row or a dictionary."""
    return Grid(*[tuple(row[c]) for c in ("size", "spacing", "origin", "direction")])


@dataclass(frozen=True)
class Grids:
    """The grids of many cases: a table with one row a case, the key columns ``by`` and a struct ``grid`` of type GRID. Directions
    are orthonormal. Every operator that takes a Grid for all its cases takes this instead where each case has its own."""

    table: DataFrame
    by: tuple[str, ...]

    def resampled(self, spacing: tuple[float, float, float]) -> Grids:
        """The grids over the same extents with another spacing; a case that has it keeps its grid."""
        c = GridColumn(F.col("grid"))
        close = F.lit(True)
        for k, s in enumerate(spacing):
            close = close & (F.abs(c.spacing(k) - s) <= 1e-4 + 1e-5 * abs(s))
        size = F.array(*[F.greatest(F.lit(1), F.rint(c.size(k) * c.spacing(k) / s)).cast("int") for k, s in enumerate(spacing)])
        made = F.struct(size.alias("size"), F.array(*[F.lit(float(s)) for s in spacing]).alias("spacing"), F.col("grid.origin").alias("origin"), F.col("grid.direction").alias("direction"))
        return Grids(self.table.withColumn("grid", F.when(close, F.col("grid")).otherwise(made)), self.by)

    def cropped(self, boxes: DataFrame) -> Grids:
        """The grids of the boxes (by, low and high index of each axis); a case without a box keeps its whole grid."""
        c = GridColumn(F.col("grid"))
        low = [F.col(f"{a}_low") for a in "xyz"]
        size = F.array(*[(F.col(f"{a}_high") - F.col(f"{a}_low") + 1).cast("int") for a in "xyz"])
        made = F.struct(size.alias("size"), F.col("grid.spacing").alias("spacing"), F.array(*c.position(*low)).alias("origin"), F.col("grid.direction").alias("direction"))
        ends = [f"{a}_{e}" for a in "xyz" for e in ("low", "high")]
        rows = self.table.join(boxes.select(*self.by, *ends), list(self.by), "left")
        return Grids(rows.withColumn("grid", F.when(low[0].isNull(), F.col("grid")).otherwise(made)).drop(*ends), self.by)


class GridColumn:
    """A grid in a struct column, with the methods of Grid that are columns. Axes are 0, 1, 2 for x, y, z."""

    def __init__(self, column: Column) -> None:
        self.column = column

    def _at(self, name: str, k: int) -> Column:
        return F.get(self.column[name], F.lit(k))

    def size(self, axis: int) -> Column:
        return self._at("size", axis)

    def spacing(self, axis: int) -> Column:
        return self._at("spacing", axis)

    @property
    def centre(self) -> list[Column]:
        return self.position(*[(self.size(k) - 1) / 2 for k in range(3)])

    @property
    def voxel_ml(self) -> Column:
        return self.spacing(0) * self.spacing(1) * self.spacing(2) / 1000.0

    @property
    def n_voxels(self) -> Column:
        return self.size(0).cast("long") * self.size(1) * self.size(2)

    def position(self, x: Column, y: Column, z: Column) -> list[Column]:
        along = [self.spacing(k) * c for k, c in enumerate((x, y, z))]
        return [self._at("origin", r) + sum((self._at("direction", 3 * r + k) * along[k] for k in (1, 2)), self._at("direction", 3 * r) * along[0]) for r in range(3)]

    def index(self, px: Column, py: Column, pz: Column) -> list[Column]:
        """Continuous index of a physical position; the inverse of an orthonormal direction is its transpose."""
        gap = [p - self._at("origin", r) for r, p in enumerate((px, py, pz))]
        return [sum((self._at("direction", 3 * r + k) * gap[r] for r in (1, 2)), self._at("direction", k) * gap[0]) / self.spacing(k) for k in range(3)]

    def contains(self, x: Column, y: Column, z: Column) -> Column:
        inside = F.lit(True)
        for k, c in enumerate((x, y, z)):
            inside = inside & (c >= -1e-9) & (c <= self.size(k) - 1 + 1e-9)
        return inside


def with_grid(rows: DataFrame, grid: Grid | Grids, name: str = "_grid") -> tuple[DataFrame, GridColumn]:
    """rows with the grid of their case in a struct column, and that column's methods. The table of grids has one row a case, so
    Spark broadcasts it while it is small. A row whose case has no grid is left out."""
    if isinstance(grid, Grid):
        return rows.withColumn(name, grid.column()), GridColumn(F.col(name))
    table = grid.table.select(*grid.by, F.col("grid").alias(name))
    return rows.join(table, list(grid.by)), GridColumn(F.col(name))


def placed(rows: DataFrame, grid: Grid | Grids, into: Sequence[str] = ("px", "py", "pz"), index: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """rows with the positions in mm of an index (x, y, z)."""
    at = [F.col(c) for c in index]
    if isinstance(grid, Grid):
        return rows.withColumns(dict(zip(into, grid.position(*at), strict=True)))
    rows, g = with_grid(rows, grid)
    return rows.withColumns(dict(zip(into, g.position(*at), strict=True))).drop("_grid")


def grids_of(cases: DataFrame, by: Sequence[str], grid: Grid | Grids) -> Grids:
    """The grids of cases, of which all have the same one if a Grid is given."""
    return grid if isinstance(grid, Grids) else Grids(cases.select(*by).distinct().withColumn("grid", grid.column()), tuple(by))


def keys_of(grid: Grid | Grids, by: Sequence[str]) -> None:
    """An error if the grids of cases are not told apart by some of these keys."""
    if isinstance(grid, Grids) and not set(grid.by) <= set(by):
        raise ValueError(f"grids by {grid.by} do not fit rows by {tuple(by)}")


def affine(m: np.ndarray, x: Column, y: Column, z: Column) -> list[Column]:
    """A 4 by 4 matrix over three columns; exact zeros and ones leave no trace in the plan."""
    out = []
    for row in np.asarray(m, float)[:3]:
        terms = [c if w == 1 else c * float(w) for w, c in zip(row[:3], (x, y, z), strict=True) if w]
        total = terms[0] if terms else F.lit(0.0)
        for t in terms[1:]:
            total = total + t
        out.append(total + float(row[3]) if row[3] else total + 0.0)
    return out
