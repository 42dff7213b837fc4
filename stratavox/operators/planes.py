"""Separable work on volumes, plane by plane: along x and y within a plane, then along z within a plane of lines.

Voxels of one plane z are gathered into one row, which is bounded by the grid, and worked on along two axes; what comes out are
lines, one row each, which are gathered by y and worked on along z. So a voxel is shuffled twice whatever the reach of the
operation, and a large volume is as many tasks as it has planes. Volumes may be sparse: the functions say what a missing voxel is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import GRID, INDEX, Grid, Grids, grid_from, keys_of, with_grid
from ..shared import bound_batches


def _cells(column: pa.Array, i: int) -> dict[str, np.ndarray | pa.Array]:
    """The fields of the structs in the i-th list of a column, as flat arrays."""
    part = column.slice(i, 1).flatten()
    return dict(zip((f.name for f in part.type), part.flatten(), strict=True))


def _lists(values: np.ndarray) -> pa.Array:
    """The rows of a matrix as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)), pa.array(np.ascontiguousarray(values, np.float64).ravel()))


def _keys(batch: pa.RecordBatch, names: Sequence[str], i: int, n: int) -> list[pa.Array]:
    at = pa.array(np.full(n, i, np.int64))
    return [batch.column(name).take(at) for name in names]


def swept(voxels: DataFrame, by: Sequence[str], grid: Grid | Grids, values: Sequence[str], plane: Callable, column: Callable, lines: int = 1, out: Sequence[str] = ("v",)) -> DataFrame:
    """by, z, y, x and the columns ``out``.

    plane(grid, y, x, values) gets the indices and value arrays of the voxels of one plane and returns ``lines`` matrices (y, x).
    column(grid, z, matrices) gets the planes of lines of one y as matrices (z, x), and the z that they have, and returns indices
    z and x and the arrays of ``out``. Grids have the case's own size and spacing.
    """
    by = list(by)
    keys_of(grid, by)
    bound_batches(voxels.sparkSession)
    packed = voxels.select(*by, *[F.col(c).cast("int").alias(c) for c in INDEX], *values).groupBy(*by, "z").agg(F.collect_list(F.struct("y", "x", *values)).alias("_cells"))
    packed, _ = with_grid(packed, grid)
    kinds = {f.name: f.dataType.simpleString() for f in voxels.schema}
    head = ", ".join(f"`{c}` {kinds[c]}" for c in by)
    names = [f"_l{k}" for k in range(lines)]

    def planes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grids = batch.column("_grid").to_pylist()
            for i in range(batch.num_rows):
                g, cells = grid_from(grids[i]), _cells(batch.column("_cells"), i)
                made = plane(g, *(cells[c].to_numpy(zero_copy_only=False) for c in ("y", "x")), [cells[c].to_numpy(zero_copy_only=False) for c in values])
                n = g.size[1]
                y = pa.array(np.arange(n, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([*_keys(batch, [*by, "z"], i, n), y, *_keys(batch, ["_grid"], i, n), *map(_lists, made)], names=[*by, "z", "y", "_grid", *names])

    rows = packed.mapInArrow(planes, f"{head}, z int, y int, _grid {GRID}, " + ", ".join(f"{n} array<double>" for n in names))
    rows = rows.groupBy(*by, "y").agg(F.first("_grid").alias("_grid"), F.collect_list(F.struct("z", *names)).alias("_lines"))

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grids = batch.column("_grid").to_pylist()
            for i in range(batch.num_rows):
                g, cells = grid_from(grids[i]), _cells(batch.column("_lines"), i)
                at = cells["z"].to_numpy(zero_copy_only=False)
                order = np.argsort(at)
                matrices = [cells[n].flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1)[order] for n in names]
                z, x, made = column(g, at[order], matrices)
                index = [pa.array(np.asarray(v, np.int32)) for v in (z, np.full(len(z), batch.column("y")[i].as_py()), x)]
                yield pa.RecordBatch.from_arrays([*_keys(batch, by, i, len(z)), *index, *(pa.array(np.asarray(v, np.float64)) for v in made)], names=[*by, *INDEX, *out])

    return rows.mapInArrow(columns, f"{head}, z int, y int, x int, " + ", ".join(f"{n} double" for n in out))


def envelope(f: np.ndarray, w: float) -> np.ndarray:
    """min over j of f[., j] + w (i - j) ** 2 for every row and i: the lower envelope of parabolas, for all rows in step. Infinite
    entries have no parabola. Each parabola is put on and taken off a row's stack at most once."""
    rows, n = f.shape
    top = np.full(rows, -1)
    held, begins = np.zeros((rows, n), np.int64), np.empty((rows, n))
    for q in range(n):
        r = np.flatnonzero(np.isfinite(f[:, q]))
        while len(r):
            k = top[r]
            some = k >= 0
            v = held[r, np.maximum(k, 0)]
            cross = np.full(len(r), -np.inf)
            a, b = r[some], v[some]
            cross[some] = ((f[a, q] - f[a, b]) / w + (q * q - b * b)) / (2 * (q - b))
            lower = some & (cross <= begins[r, np.maximum(k, 0)])
            top[r[lower]] -= 1
            put = r[~lower]
            top[put] += 1
            held[put, top[put]], begins[put, top[put]] = q, cross[~lower]
            r = r[lower]
    out, at, all_rows = np.full((rows, n), np.inf), np.zeros(rows, np.int64), np.flatnonzero(top >= 0)
    for q in range(n):
        go = all_rows
        while len(go):
            go = go[(at[go] < top[go])]
            go = go[begins[go, at[go] + 1] < q]
            at[go] += 1
        j = held[all_rows, at[all_rows]]
        out[all_rows, q] = f[all_rows, j] + w * (q - j) ** 2
    return out


def squared_distances(sources: DataFrame, by: Sequence[str], grid: Grid | Grids, weights: Callable[[Grid], Sequence[float]], wanted: DataFrame | None = None, least: float = -np.inf, most: float = np.inf, outside: bool = False) -> DataFrame:
    """by, z, y, x, d2: the exact weighted squared distance to the nearest source voxel of the case, of voxels within least < d2 <= most.

    weights(grid) are those of squared steps along x, y, z. With ``wanted`` (by, z, y, x) only its voxels are returned, those of a
    case without sources with d2 infinite. With ``outside`` all voxels of the grid that are not in ``sources`` are the sources, and
    only voxels of ``sources`` are returned; beyond the grid there is no source.
    """
    by, some = list(by), wanted is not None
    rows = sources.select(*by, *INDEX, F.lit(1).alias("_flag"))
    if some:
        rows = rows.unionByName(wanted.select(*by, *INDEX, F.lit(2).alias("_flag")))

    def plane(g: Grid, y: np.ndarray, x: np.ndarray, values: list[np.ndarray]) -> list[np.ndarray]:
        there, asked = np.zeros((2, g.size[1], g.size[0]), bool)
        inside = (y >= 0) & (y < g.size[1]) & (x >= 0) & (x < g.size[0])
        y, x, flag = y[inside], x[inside], values[0][inside]
        there[y[flag == 1], x[flag == 1]] = True
        asked[y[flag == 2], x[flag == 2]] = True
        f = np.where(there != outside, 0.0, np.inf)
        w = weights(g)
        f = envelope(envelope(f, w[0]).T, w[1]).T
        return [f, there if outside else asked if some else np.ones_like(there)]

    def column(g: Grid, z: np.ndarray, lines: list[np.ndarray]) -> tuple:
        ok = (z >= 0) & (z < g.size[2])
        f = np.full((g.size[2], g.size[0]), 0.0 if outside else np.inf)
        use = np.zeros(f.shape, bool) if outside or some else np.ones(f.shape, bool)
        f[z[ok]], use[z[ok]] = lines[0][ok], lines[1][ok] > 0
        d = envelope(f.T, weights(g)[2]).T
        zi, xi = np.nonzero(use & (d > least) & (d <= most))
        return zi, xi, [d[zi, xi]]

    return swept(rows, by, grid, ["_flag"], plane, column, 2, ("d2",))


def step_weights(grid: Grid) -> list[float]:
    """For distances in mm."""
    return [s * s for s in grid.spacing]


def ball_weights(radius_mm: float) -> Callable[[Grid], list[float]]:
    """For ellipsoids of this radius, at least one voxel along each axis, whose border is at 1."""
    return lambda grid: [1 / max(1, round(radius_mm / s)) ** 2 for s in grid.spacing]
