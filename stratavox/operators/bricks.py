"""Interpolation in bricks: volumes as blocks of voxels with overlapping borders, met by the points that fall into them.

A brick is one row that holds the voxels of a cube and of a border as wide as the interpolation reaches, so a point finds all it
needs in one brick. Points come as lists too: each cube of a target grid is one task's work, which moves its voxel centres into the
source and deals them out by brick. A join of these lists with the bricks is all that is shuffled: a number for each voxel of the
source (and its border copies) and four for each of the target, whatever the number of taps. No row grows with a volume.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import GRID, INDEX, Grid, Grids, grid_from, keys_of, with_grid
from ..shared import bound_batches
from .planes import _cells, _keys, swept

#: Voxels of a brick along an axis.
EDGE = 32
BRICK = ("kz", "ky", "kx")
POINTS = "at array<long>, sx array<double>, sy array<double>, sz array<double>"
#: Deviation of the Gaussian kernel in voxels, where it is cut off in deviations, and the lobes of the windowed sinc.
SIGMA, CUT, LOBES = 0.8, 4.0, 3


def _nearest(s: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    return np.floor(s + 0.5).astype(np.int64), [np.ones(len(s))]


def _linear(s: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    low = np.floor(s)
    return low.astype(np.int64), [1 - (s - low), s - low]


def _cubic(s: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    low = np.floor(s)
    t = s - low
    return low.astype(np.int64) - 1, [(1 - t) ** 3 / 6, (3 * t**3 - 6 * t**2 + 4) / 6, (-3 * t**3 + 3 * t**2 + 3 * t + 1) / 6, t**3 / 6]


def _kernel(of: Callable[[np.ndarray], np.ndarray], reach: int) -> Callable:
    """Taps of a kernel, scaled so that their sum is 1."""

    def taps(s: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        low = np.floor(s)
        w = [of(s - low - k) for k in range(1 - reach, reach + 1)]
        total = sum(w)
        return low.astype(np.int64) + 1 - reach, [v / total for v in w]

    return taps


_REACH = int(np.ceil(SIGMA * CUT))
#: Taps along an axis (first index and weights), how far they reach, and whether the volume is filtered first.
METHODS: dict[str, tuple[Callable, int, bool]] = {
    "nearest": (_nearest, 1, False),
    "linear": (_linear, 1, False),
    "bspline": (_cubic, 2, True),
    "lanczos": (_kernel(lambda d: np.sinc(d) * np.sinc(np.clip(d / LOBES, -1, 1)), LOBES), LOBES, False),
    "gaussian": (_kernel(lambda d: np.exp(-0.5 * (d / SIGMA) ** 2), _REACH), _REACH, False),
}


def spline_coefficients(f: np.ndarray) -> np.ndarray:
    """Coefficients along the rows of a matrix whose cubic B-spline passes through them, mirrored at both ends."""
    n = f.shape[1]
    if n == 1:
        return f
    pole = np.sqrt(3.0) - 2
    c = 6.0 * f
    k = np.arange(1, n - 1)
    first = c[:, 0] + pole ** (n - 1) * c[:, -1] + c[:, 1:-1] @ (pole**k + pole ** (2 * n - 2 - k))
    c[:, 0] = first / (1 - pole ** (2 * n - 2))
    for i in range(1, n):
        c[:, i] += pole * c[:, i - 1]
    c[:, -1] = pole / (pole * pole - 1) * (c[:, -1] + pole * c[:, -2])
    for i in range(n - 2, -1, -1):
        c[:, i] = pole * (c[:, i + 1] - c[:, i])
    return c


def filtered(voxels: DataFrame, by: Sequence[str], grid: Grid | Grids, values: Sequence[str] = ("v",)) -> DataFrame:
    """by, z, y, x, values: the B-spline coefficients of dense volumes."""

    def plane(g: Grid, y: np.ndarray, x: np.ndarray, found: list[np.ndarray]) -> list[np.ndarray]:
        out = []
        for v in found:
            a = np.zeros((g.size[1], g.size[0]))
            a[y, x] = v
            out.append(spline_coefficients(spline_coefficients(a).T).T)
        return out

    def column(g: Grid, z: np.ndarray, lines: list[np.ndarray]) -> tuple:
        zi, xi = np.indices(lines[0].shape)
        return z[zi.ravel()], xi.ravel(), [spline_coefficients(a.T.copy()).T.ravel() for a in lines]

    return swept(voxels, by, grid, values, plane, column, len(values), values)


def bricks(voxels: DataFrame, by: Sequence[str], values: Sequence[str], reach: int, edge: int = EDGE) -> DataFrame:
    """by, kz, ky, kx, cells (z, y, x and values): each cube of voxels with those around it that are within reach."""
    rows = voxels.select(*by, *[F.col(c).cast("int").alias(c) for c in INDEX], *[F.col(v).cast("double").alias(v) for v in values])
    for c, k in zip(INDEX, BRICK, strict=True):
        at = F.floor(F.col(c) / edge).cast("int")
        place = F.col(c) - at * edge
        near = F.array(at, F.when((place < reach) & (at > 0), at - 1), F.when(place >= edge - reach, at + 1))
        rows = rows.withColumn(k, F.explode(F.array_compact(near)))
    return rows.groupBy(*by, *BRICK).agg(F.collect_list(F.struct(*INDEX, *values)).alias("_cells"))


def _dealt(batch: pa.RecordBatch, keep: Sequence[str], i: int, at: np.ndarray, s: np.ndarray, size: np.ndarray, salt: int, edge: int) -> Iterator[list[pa.Array]]:
    """Rows of points (x, y, z) of the i-th row of a batch, one for each brick that they fall into, and one for those outside."""
    s = np.round(s, 9)
    inside = ((s >= -1e-9) & (s <= size - 1 + 1e-9)).all(1)
    if (~inside).any():  # they meet no brick, and are spread by a number of their own
        yield from _row(batch, keep, i, (-1, -1, salt), at[~inside], s[~inside])
    at, s = at[inside], np.clip(s[inside], 0, size - 1)
    k = (np.floor(s).astype(np.int64) // edge)[:, ::-1]
    order = np.lexsort((k[:, 2], k[:, 1], k[:, 0]))
    at, s, k = at[order], s[order], k[order]
    for part in np.split(np.arange(len(k)), np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1) if len(k) else []:
        yield from _row(batch, keep, i, tuple(int(v) for v in k[part[0]]), at[part], s[part])


def _row(batch: pa.RecordBatch, keep: Sequence[str], i: int, key: tuple[int, ...], at: np.ndarray, s: np.ndarray) -> Iterator[list[pa.Array]]:
    one = lambda v, kind: pa.array([v], pa.list_(kind))
    yield [*_keys(batch, keep, i, 1), *[pa.array([v], pa.int32()) for v in key], one(at, pa.int64()), *[one(np.ascontiguousarray(c), pa.float64()) for c in s.T]]


def _head(df: DataFrame, by: Sequence[str]) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return ", ".join(f"`{c}` {kinds[c]}" for c in by)


def aimed(cases: DataFrame, by: Sequence[str], target: Grid | Grids, source: Grid | Grids, matrix: str | None = None, edge: int = EDGE) -> DataFrame:
    """by, both grids, the key of a source brick and lists of target voxels (by flat index) with their continuous source index, for
    all voxels of the target; those outside of the source have a key that no brick has."""
    by = list(by)
    for g in (target, source):
        keys_of(g, by)
    rows = cases.select(*by, F.col(matrix).alias("_matrix") if matrix else F.lit(None).cast("array<double>").alias("_matrix"))
    rows = rows if matrix else rows.distinct()
    rows, t = with_grid(rows, target, "_target")
    rows, _ = with_grid(rows, source, "_source")
    for axis, k in zip((2, 1, 0), BRICK, strict=True):
        rows = rows.withColumn(k, F.explode(F.sequence(F.lit(0), F.floor((t.size(axis) - 1) / edge).cast("int"))))
    # Cases are few rows, cubes many: they are spread before the work begins.
    rows = rows.repartition(*by, *BRICK)

    def aim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain = {c: batch.column(c).to_pylist() for c in ("_matrix", "_target", "_source", *BRICK)}
            for i in range(batch.num_rows):
                a, b = grid_from(plain["_target"][i]), grid_from(plain["_source"][i])
                move = np.array(plain["_matrix"][i], float).reshape(4, 4) if plain["_matrix"][i] else np.eye(4)
                m = np.linalg.inv(b.matrix) @ move @ a.matrix
                ends = [(edge * plain[k][i], min(edge * (plain[k][i] + 1), n)) for k, n in zip(BRICK, reversed(a.size), strict=True)]
                z, y, x = (v.ravel() for v in np.meshgrid(*[np.arange(*e) for e in ends], indexing="ij"))
                p = np.stack([x, y, z], 1).astype(float)
                flat = (z.astype(np.int64) * a.size[1] + y) * a.size[0] + x
                salt = int(flat[0] % (1 << 31))
                for made in _dealt(batch, [*by, "_target", "_source"], i, flat, p @ m[:3, :3].T + m[:3, 3], np.array(b.size), salt, edge):
                    yield pa.RecordBatch.from_arrays(made, names=[*by, "_target", "_source", *BRICK, "at", "sx", "sy", "sz"])

    return rows.mapInArrow(aim, f"{_head(cases, by)}, _target {GRID}, _source {GRID}, kz int, ky int, kx int, {POINTS}")


def aimed_points(points: DataFrame, by: Sequence[str], idx: str, position: Sequence[str], source: Grid | Grids, edge: int = EDGE) -> DataFrame:
    """The same for given points: rows by, idx (long) and a position in mm. Points of one batch and brick are one row."""
    by = list(by)
    keys_of(source, by)
    rows, g = with_grid(points.select(*by, F.col(idx).cast("long").alias("_idx"), *position), source, "_source")
    index = g.index(*[F.col(c) for c in position])
    rows = rows.select(*by, "_idx", "_source", *[c.alias(n) for c, n in zip(index, ("sx", "sy", "sz"), strict=True)])

    def aim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            case = batch.select(by).to_pandas()
            for _, at in case.groupby(by, dropna=False).indices.items() if batch.num_rows else []:
                i = int(at[0])
                s = np.stack([batch.column(c).to_numpy(zero_copy_only=False)[at] for c in ("sx", "sy", "sz")], 1)
                number = batch.column("_idx").to_numpy(zero_copy_only=False)[at].astype(np.int64)
                size = np.array(batch.column("_source")[i].as_py()["size"])
                for made in _dealt(batch, [*by, "_source"], i, number, np.where(np.isfinite(s), s, -1.0), size, int(number[0] % (1 << 31)), edge):
                    yield pa.RecordBatch.from_arrays(made, names=[*by, "_source", *BRICK, "at", "sx", "sy", "sz"])

    return rows.mapInArrow(aim, f"{_head(points, by)}, _source {GRID}, kz int, ky int, kx int, {POINTS}")


def interpolated(cells: dict[str, np.ndarray] | None, values: Sequence[str], s: list[np.ndarray], size: Sequence[int], method: str) -> list[np.ndarray]:
    """The values at continuous indices (x, y, z) from the voxels of a brick; NaN where none of the voxels with a weight is there.
    A missing voxel counts as 0. Beyond the grid a spline is mirrored, a Gaussian ends, and the others repeat the edge."""
    if cells is None:
        return [np.full(len(s[0]), np.nan) for _ in values]
    index = [cells[c] for c in INDEX]
    low = [int(v.min()) for v in index]
    shape = [int(v.max()) - a + 1 for v, a in zip(index, low, strict=True)]
    boxes = []
    for v in values:
        box = np.full(shape, np.nan)
        box[tuple(i - a for i, a in zip(index, low, strict=True))] = cells[v]
        boxes.append(box)
    taps, _, _ = METHODS[method]
    axes = []
    for axis in (2, 1, 0):  # z, y, x
        n, (first, weights) = size[axis], taps(s[axis])
        each = []
        for k, w in enumerate(weights):
            i = first + k
            if method == "bspline":
                i = np.abs(i) if n > 1 else np.zeros_like(i)
                i = np.where(i > n - 1, 2 * (n - 1) - i, i) if n > 1 else i
            elif method == "gaussian":
                w = np.where((i < 0) | (i > n - 1), 0.0, w)
            each.append((np.clip(i, 0, n - 1), w))
        if method == "gaussian":
            total = sum(w for _, w in each)
            each = [(i, w / total) for i, w in each]
        axes.append(each)
    sums, found = [np.zeros(len(s[0])) for _ in values], np.zeros(len(s[0]), bool)
    for iz, wz in axes[0]:
        for iy, wy in axes[1]:
            for ix, wx in axes[2]:
                w = wz * wy * wx
                at = [i - a for i, a in zip((iz, iy, ix), low, strict=True)]
                there = (w != 0) & np.logical_and.reduce([(i >= 0) & (i < n) for i, n in zip(at, shape, strict=True)])
                at = tuple(np.where(there, i, 0) for i in at)
                for k, box in enumerate(boxes):
                    v = box[at]
                    ok = there & ~np.isnan(v)
                    sums[k] += np.where(ok, w * np.where(ok, v, 0.0), 0.0)
                    found |= ok
    return [np.where(found, x, np.nan) for x in sums]


def _met(points: DataFrame, blocks: DataFrame, on: Sequence[str], by: Sequence[str], values: Sequence[str], method: str, names: str, made: Callable) -> DataFrame:
    bound_batches(points.sparkSession)
    rows = points.join(blocks, [*on, *BRICK], "left")
    columns = [c.split()[0] for c in names.split(", ")]

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, there = batch.column("_source").to_pylist(), batch.column("_cells").is_valid().to_pylist()
            targets = batch.column("_target").to_pylist() if "_target" in batch.schema.names else [None] * batch.num_rows
            for i in range(batch.num_rows):
                at = batch.column("at").slice(i, 1).flatten().to_numpy()
                s = [batch.column(c).slice(i, 1).flatten().to_numpy() for c in ("sx", "sy", "sz")]
                cells = {k: v.to_numpy(zero_copy_only=False) for k, v in _cells(batch.column("_cells"), i).items()} if there[i] else None
                found = interpolated(cells, values, s, sizes[i]["size"], method)
                ids = made(at, targets[i])
                yield pa.RecordBatch.from_arrays([*_keys(batch, by, i, len(at)), *ids, *[pa.array(v, mask=np.isnan(v)) for v in found]], names=[*by, *columns])

    return rows.mapInArrow(sample, f"{_head(points, by)}, {names}")


def resampled(voxels: DataFrame, cases: DataFrame, by: Sequence[str], target: Grid | Grids, source: Grid | Grids, matrix: str | None = None, interpolation: str = "linear", value: str | Sequence[str] = "v", on: Sequence[str] | None = None, edge: int = EDGE) -> DataFrame:
    """by, z, y, x, value (or several) on the target grid for every case; NULL for what lies outside of the source or has no voxel
    there.

    cases has one row a case, with a matrix (fixed to moving, 16 doubles, row-major) where transforms differ by case; ``on`` are
    the key columns that voxels and cases share, if one volume serves several cases.
    """
    if interpolation not in METHODS:
        raise ValueError(f"unknown interpolation {interpolation!r}; there are {sorted(METHODS)}")
    by, on, values = list(by), list(on or by), [value] if isinstance(value, str) else list(value)
    _, reach, first = METHODS[interpolation]
    voxels = filtered(voxels, on, source, values) if first else voxels
    points = aimed(cases, by, target, source, matrix, edge)

    def made(at: np.ndarray, grid: dict) -> list[pa.Array]:
        nx, ny, _ = grid["size"]
        return [pa.array(v.astype(np.int32)) for v in (at // (nx * ny), at // nx % ny, at % nx)]

    names = "z int, y int, x int, " + ", ".join(f"{v} double" for v in values)
    return _met(points, bricks(voxels, on, values, reach, edge), on, by, values, interpolation, names, made)


def sampled(points: DataFrame, voxels: DataFrame, by: Sequence[str], source: Grid | Grids, values: Sequence[str], position: Sequence[str] = ("px", "py", "pz"), idx: str = "idx", interpolation: str = "linear", edge: int = EDGE, on: Sequence[str] | None = None) -> DataFrame:
    """by, idx and the values at given positions in mm; NULL outside of the grid. idx (a whole number) tells the points of a case
    apart; ``on`` are the keys that points and voxels share."""
    by, on = list(by), list(on or by)
    _, reach, first = METHODS[interpolation]
    if first:
        raise ValueError("coefficients are made of whole volumes: filter the volume and ask for them")
    at = aimed_points(points, by, idx, position, source, edge)
    out = _met(at, bricks(voxels, on, values, reach, edge), on, by, values, interpolation, "_idx long, " + ", ".join(f"{v} double" for v in values), lambda at, _: [pa.array(at)])
    return out.withColumnRenamed("_idx", idx).withColumn(idx, F.col(idx).cast(points.schema[idx].dataType))
