"""Fitting transforms: one case a group, so thousands of pairs are fitted at once; voxels of one working grid are a bounded group.

Linear stages maximise the normalised correlation by damped Gauss-Newton steps on normalised intensities, or mutual information
by a pattern search, from coarse to fine. A deformable stage moves voxels by smoothed demons steps. Results are judged by how
well they recover known transforms, not by equality with any other optimiser.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import GRID, Grid, Grids, grid_from, with_grid
from .planes import _cells
from .transforms import from_parameters

#: Voxels of a working grid at most; a larger volume has to be resampled or cropped first.
MOST_VOXELS = 4_000_000
FITTED = "case_id long, matrix array<double>, metric string, score double, n_samples long, stages array<struct<stage: string, final_metric: double, matrix: array<double>>>"
LENGTHS = {"translation": 3, "rigid": 6, "similarity": 7, "affine": 12}


def start_parameters(kind: str) -> np.ndarray:
    return {"translation": np.zeros(3), "rigid": np.zeros(6), "similarity": np.array([0, 0, 0, 0, 0, 0, 1.0]), "affine": np.array([1, 0, 0, 0, 1, 0, 0, 0, 1, 0, 0, 0.0])}[kind]


def gathered(volumes: DataFrame, side: int, extra: Sequence[str] = ()) -> DataFrame:
    """case_id, side, z, cells: the planes of volumes (case_id, z, y, x, v), one row each."""
    return volumes.groupBy("case_id", "z").agg(F.collect_list(F.struct("y", "x", "v", *extra)).alias("cells")).select("case_id", F.lit(side).alias("side"), F.col("z").cast("int").alias("z"), "cells")


def dense(planes: pa.Table, grid: Grid, value: str = "v") -> np.ndarray:
    """An array from the planes of one volume, the least value where voxels are missing."""
    if grid.n_voxels > MOST_VOXELS:
        raise ValueError(f"{grid.n_voxels} voxels are more than a working grid may have ({MOST_VOXELS})")
    out = np.full(tuple(reversed(grid.size)), np.nan, np.float64)
    column = planes.column("cells").combine_chunks()
    for i, z in enumerate(planes.column("z").to_pylist()):
        cells = _cells(column, i)
        out[z, cells["y"].to_numpy(zero_copy_only=False), cells["x"].to_numpy(zero_copy_only=False)] = cells[value].cast(pa.float64()).to_numpy(zero_copy_only=False)
    return np.nan_to_num(out, nan=float(np.nanmin(out)) if np.isfinite(out).any() else 0.0)


def levels_of(n_resolutions: int, shape: Sequence[int]) -> int:
    """Levels of a stage: as many as it says, but none on which the shortest axis has fewer than four voxels."""
    return max(1, min(n_resolutions, 1 + int(np.log2(max(min(shape), 4) / 4))))


def smoothed(a: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing along each axis, edges repeated."""
    if sigma <= 0:
        return a
    r = max(1, int(3 * sigma))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    for axis in range(3):
        n = a.shape[axis]
        i = np.clip(np.arange(-r, n + r), 0, n - 1)
        wide = np.take(a, i, axis)
        a = sum(w * np.take(wide, np.arange(j, j + n), axis) for j, w in enumerate(k))
    return a


def interpolated(a: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trilinear values at continuous indices (rows x, y, z), and which of them lie inside."""
    n = np.array(a.shape[::-1])
    inside = ((index >= 0) & (index <= n - 1)).all(1)
    i = np.clip(index, 0, n - 1)
    low = np.minimum(np.floor(i).astype(int), np.maximum(n - 2, 0))
    f = i - low
    out = np.zeros(len(index))
    for dx in (0, 1):
        for dy in (0, 1):
            for dz in (0, 1):
                w = np.where(dx, f[:, 0], 1 - f[:, 0]) * np.where(dy, f[:, 1], 1 - f[:, 1]) * np.where(dz, f[:, 2], 1 - f[:, 2])
                at = np.minimum(low + (dx, dy, dz), n - 1)
                out += w * a[at[:, 2], at[:, 1], at[:, 0]]
    return out, inside


def mutual_information(x: np.ndarray, y: np.ndarray, bins: int = 32) -> float:
    h = np.histogram2d(x, y, bins)[0]
    e = lambda p: -(p[p > 0] / p.sum() * np.log(p[p > 0] / p.sum())).sum()
    joint = e(h.ravel())
    return float((e(h.sum(0)) + e(h.sum(1))) / joint) if joint > 0 else 1.0


def fit(f: np.ndarray, m: np.ndarray, fixed: Grid, moving: Grid, kind: str = "rigid", start: np.ndarray | None = None, metric: str = "ncc", levels: int = 3, iterations: int = 60, samples: int = 4096, mask: np.ndarray | None = None, seed: int = 20250101) -> tuple[np.ndarray, float, int]:
    """(matrix fixed to moving, score, samples) of a linear stage that starts from a matrix."""
    start = np.eye(4) if start is None else start
    rng, centre = np.random.default_rng(seed), np.array(fixed.centre)
    to_moving = np.linalg.inv(moving.matrix)
    p, score, n = start_parameters(kind), -np.inf, 0
    allowed = np.argwhere(mask if mask is not None and mask.sum() >= 512 else np.ones(f.shape, bool))[:, ::-1]
    matrix = lambda q: start @ from_parameters(kind, q, centre)
    step = np.array({"translation": [1.0] * 3, "rigid": [0.02] * 3 + [1.0] * 3, "similarity": [0.02] * 3 + [1.0] * 3 + [0.02], "affine": [0.02] * 9 + [1.0] * 3}[kind])
    for level in reversed(range(levels)):
        sigma = 0.75 * 2**level if level else 0.5
        fs, ms = smoothed(f, sigma), smoothed(m, sigma)
        gradient = [g for g in np.gradient(ms)[::-1]]
        chosen = allowed[rng.choice(len(allowed), min(len(allowed), samples * (2 if metric == "mi" else 4)), replace=False)]
        points = chosen @ fixed.matrix[:3, :3].T + fixed.matrix[:3, 3]
        a = fs[chosen[:, 2], chosen[:, 1], chosen[:, 0]]

        def value(q: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
            moved = points @ matrix(q)[:3, :3].T + matrix(q)[:3, 3]  # noqa: B023
            index = moved @ to_moving[:3, :3].T + to_moving[:3, 3]
            b, inside = interpolated(ms, index)  # noqa: B023
            if inside.sum() < max(64, 0.05 * len(index)):
                return -np.inf, b, inside, index
            x, y = a[inside], b[inside]  # noqa: B023
            if metric == "mi":
                return mutual_information(x, y), b, inside, index
            sx, sy = x.std(), y.std()
            return (float(((x - x.mean()) * (y - y.mean())).mean() / (sx * sy)) if sx * sy > 0 else -np.inf), b, inside, index

        score, b, inside, index = value(p)
        if metric == "mi":
            size = 2.0 * 2**level
            for _ in range(iterations):
                better = False
                for i in range(len(p)):
                    for sign in (1, -1):
                        q = p.copy()
                        q[i] += sign * size * step[i]
                        s = value(q)[0]
                        if s > score + 1e-7:
                            p, score, better = q, s, True
                            break
                if not better:
                    size /= 2
                    if size < 0.05:
                        break
        else:
            damping = 1e-2
            for _ in range(iterations):
                if not np.isfinite(score):
                    break
                x, y = a[inside], b[inside]
                sx, sy = x.std(), y.std()
                if sx * sy == 0:
                    break
                g = np.stack([interpolated(c, index[inside])[0] for c in gradient], 1) @ to_moving[:3, :3] / sy
                base = points[inside] @ matrix(p)[:3, :3].T + matrix(p)[:3, 3]
                jac = np.empty((len(g), len(p)))
                for i in range(len(p)):
                    q = p.copy()
                    q[i] += 1e-4 * step[i]
                    jac[:, i] = ((points[inside] @ matrix(q)[:3, :3].T + matrix(q)[:3, 3] - base) / 1e-4 * g).sum(1)
                jac -= jac.mean(0)
                residual = (x - x.mean()) / sx - (y - y.mean()) / sy
                normal, right = jac.T @ jac, jac.T @ residual
                taken = False
                for _ in range(8):
                    move = np.linalg.solve(normal + damping * np.diag(np.diag(normal) + 1e-9), right) * step
                    found = value(p + move)
                    if found[0] > score:
                        gain, p = found[0] - score, p + move
                        score, b, inside, index = found
                        damping, taken = max(damping / 5, 1e-6), True
                        break
                    damping *= 5
                if not taken or gain < 1e-7:
                    break
        n = int(inside.sum())
    return matrix(p), score, n


def demons(f: np.ndarray, m: np.ndarray, iterations: int = 40, sigma: float = 1.5, levels: int = 2) -> np.ndarray:
    """Displacements in voxels (x, y, z last) of a deformable stage on one grid: demons forces, smoothed after every step."""
    norm = lambda a: (a - a.mean()) / max(a.std(), 1e-9)
    u = np.zeros((*f.shape, 3))
    grid = np.stack(np.meshgrid(*[np.arange(n) for n in f.shape], indexing="ij")[::-1], -1).reshape(-1, 3)
    for level in reversed(range(levels)):
        fs, ms = norm(smoothed(f, level)), norm(smoothed(m, level))
        for _ in range(iterations):
            moved = interpolated(ms, np.clip(grid + u.reshape(-1, 3), 0, np.array(f.shape[::-1]) - 1))[0].reshape(f.shape)
            diff = fs - moved
            g = np.stack(np.gradient(moved)[::-1], -1)
            u = u + g * (diff / ((g**2).sum(-1) + diff**2 + 1e-3))[..., None]
            u = np.stack([smoothed(u[..., c], sigma) for c in range(3)], -1)
    return u


def _groups(fixed: DataFrame, moving: DataFrame, cases: DataFrame, masked: bool) -> DataFrame:
    """The planes of both sides and the row of each case (side 2), to be grouped by case."""
    rows = gathered(fixed if masked else fixed.withColumn("mask", F.lit(True)), 0, ["mask"])
    rows = rows.unionByName(gathered(moving.withColumn("mask", F.lit(True)), 1, ["mask"]))
    rows = rows.withColumns({"matrix": F.lit(None).cast("array<double>"), "fixed": F.lit(None).cast(GRID), "moving": F.lit(None).cast(GRID)})
    return rows.unionByName(cases.withColumn("side", F.lit(2)), allowMissingColumns=True)


def fitted(fixed: DataFrame, moving: DataFrame, starts: DataFrame, fixed_grid: Grid | Grids, moving_grid: Grid | Grids, kinds: tuple[str, ...] = ("rigid", "affine"), metric: str | tuple[str, ...] = "ncc", iterations: int | tuple[int, ...] = 60, samples: int | tuple[int, ...] = 4096, levels: int | tuple[int, ...] = 3, seed: int = 20250101) -> DataFrame:
    """case_id, matrix, metric, score, n_samples, stages (each with its figure and the transform up to it): the stages one after another from each case's start.

    fixed and moving: case_id, z, y, x, v (fixed may have a boolean mask column); starts: case_id, matrix. Metric, iterations,
    samples and levels are for all stages or for each. The planes of both volumes meet the start and the grids of their case in one
    group; a case without voxels on either side or without start gets no row.
    """
    each = lambda v: v if isinstance(v, tuple) else (v,) * len(kinds)
    settings = list(zip(kinds, each(metric), each(iterations), each(samples), each(levels), strict=True))
    cases, _ = with_grid(starts.select("case_id", "matrix"), fixed_grid, "fixed")
    cases, _ = with_grid(cases, moving_grid, "moving")
    masked = "mask" in fixed.columns
    names = [c.split()[0] for c in ("case_id", "matrix", "metric", "score", "n_samples", "stages")]
    stage = pa.struct([("stage", pa.string()), ("final_metric", pa.float64()), ("matrix", pa.list_(pa.float64()))])
    kinds_of = [pa.int64(), pa.list_(pa.float64()), pa.string(), pa.float64(), pa.int64(), pa.list_(stage)]
    schema = pa.schema(list(zip(names, kinds_of, strict=True)))

    def one(t: pa.Table) -> pa.Table:
        side = t.column("side").to_numpy()
        if set(side.tolist()) != {0, 1, 2}:
            return schema.empty_table()
        case = t.filter(pa.array(side == 2)).drop_columns(["cells"]).to_pylist()[0]
        f_grid, m_grid = grid_from(case["fixed"]), grid_from(case["moving"])
        a, b = (t.filter(pa.array(side == k)) for k in (0, 1))
        f, m = dense(a, f_grid), dense(b, m_grid)
        mask = dense(a, f_grid, "mask") > 0.5 if masked else None
        at, score, n, stages = np.array(case["matrix"], float).reshape(4, 4), 0.0, 0, []
        for kind, measure, most, some, depth in settings:
            at, score, n = fit(f, m, f_grid, m_grid, kind, at, measure, levels_of(depth, f.shape), most, some, mask, seed)
            stages.append({"stage": kind, "final_metric": float(score), "matrix": at.ravel().tolist()})
        return pa.Table.from_pylist([dict(zip(names, (case["case_id"], at.ravel().tolist(), settings[-1][1], float(score), n, stages), strict=True))], schema)

    return _groups(fixed, moving, cases, masked).groupBy("case_id").applyInArrow(one, FITTED)


def deformed(fixed: DataFrame, moved: DataFrame, grid: Grid | Grids, iterations: int = 40, sigma: float = 1.5) -> DataFrame:
    """case_id, z, y, x, dx, dy, dz in mm: a displacement field for each case, from volumes (case_id, z, y, x, v) on one grid."""
    cases, _ = with_grid(fixed.select("case_id").distinct(), grid, "fixed")
    cases = cases.select("case_id", F.lit(None).cast("array<double>").alias("matrix"), "fixed", F.col("fixed").alias("moving"))
    names = ["case_id", "z", "y", "x", "dx", "dy", "dz"]
    schema = pa.schema(list(zip(names, [pa.int64(), *[pa.int32()] * 3, *[pa.float64()] * 3], strict=True)))

    def one(t: pa.Table) -> pa.Table:
        side = t.column("side").to_numpy()
        if set(side.tolist()) != {0, 1, 2}:
            return schema.empty_table()
        case = t.filter(pa.array(side == 2)).drop_columns(["cells"]).to_pylist()[0]
        g = grid_from(case["fixed"])
        u = demons(*(dense(t.filter(pa.array(side == k)), g) for k in (0, 1)), iterations, sigma)
        mm = (u @ (np.array(g.direction).reshape(3, 3) * np.array(g.spacing)).T).reshape(-1, 3)
        index = [pa.array(i.ravel()) for i in np.indices(u.shape[:3], dtype=np.int32)]
        return pa.table([pa.array(np.full(len(mm), case["case_id"], np.int64)), *index, *[pa.array(np.ascontiguousarray(c)) for c in mm.T]], schema=schema)

    return _groups(fixed, moved, cases, False).groupBy("case_id").applyInArrow(one, "case_id long, z int, y int, x int, dx double, dy double, dz double")
