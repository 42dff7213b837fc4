"""Neighbourhoods along grid lines: box means, shifts, Jacobians and self-similarity channels, as window functions.

A line of voxels along one axis is a window partition, bounded by the grid's size on that axis. Edges repeat the outermost
voxel. Volumes must be dense: a row for every voxel.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..model import INDEX, Grid, Grids, with_grid
from .planes import swept


def line(by: Sequence[str], axis: str) -> WindowSpec:
    return Window.partitionBy(*by, *[c for c in INDEX if c != axis]).orderBy(axis)


def _ends(w: WindowSpec, c: Column) -> tuple[Column, Column]:
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.first(c).over(whole), F.last(c).over(whole)


def shift(c: Column, by: Sequence[str], axis: str, by_voxels: int) -> Column:
    """The value ``by_voxels`` before along an axis."""
    if not by_voxels:
        return c
    w = line(by, axis)
    first, last = _ends(w, c)
    return F.coalesce(F.lag(c, by_voxels).over(w), first) if by_voxels > 0 else F.coalesce(F.lead(c, -by_voxels).over(w), last)


def box_mean(df: DataFrame, by: Sequence[str], columns: Sequence[str], radius: int, grid: Grid) -> DataFrame:
    """Means over (2 radius + 1) cubed voxels: one pass along each axis, edges counted as often as they are repeated."""
    for k, axis in enumerate(INDEX):
        w, n = line(by, axis), grid.size[2 - k]
        near = w.rowsBetween(-radius, radius)

        def mean(c: str) -> Column:
            first, last = _ends(w, F.col(c))  # noqa: B023
            before = F.greatest(F.lit(0), radius - F.col(axis))  # noqa: B023
            after = F.greatest(F.lit(0), radius - (n - 1 - F.col(axis)))  # noqa: B023
            return (F.sum(c).over(near) + before * first + after * last) / (2 * radius + 1)  # noqa: B023

        df = df.withColumns({c: mean(c) for c in columns})
    return df


def smoothed(a: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing along the rows of a matrix, cut off at three deviations, edges repeated."""
    n = a.shape[1]
    if sigma <= 0 or n == 1:
        return a
    reach = max(1, int(np.ceil(3 * sigma)))
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weights /= weights.sum()
    wide = np.pad(a, ((0, 0), (reach, reach)), "edge")
    out = np.zeros_like(a)
    for k, w in enumerate(weights):
        out += w * wide[:, k : k + n]
    return out


def gaussian(df: DataFrame, by: Sequence[str], columns: Sequence[str], sigma_mm: float, grid: Grid | Grids) -> DataFrame:
    """Gaussian smoothing along each axis in turn, plane by plane, cut off at three deviations, edges repeated."""

    def plane(g: Grid, y: np.ndarray, x: np.ndarray, values: list[np.ndarray]) -> list[np.ndarray]:
        out = []
        for v in values:
            a = np.zeros((g.size[1], g.size[0]))
            a[y, x] = v
            out.append(smoothed(smoothed(a, sigma_mm / g.spacing[0]).T, sigma_mm / g.spacing[1]).T)
        return out

    def column(g: Grid, z: np.ndarray, lines: list[np.ndarray]) -> tuple:
        zi, xi = np.indices(lines[0].shape)
        return z[zi.ravel()], xi.ravel(), [smoothed(a.T, sigma_mm / g.spacing[2]).T.ravel() for a in lines]

    rows = swept(df, by, grid, columns, plane, column, len(columns), columns)
    more = [c for c in df.columns if c not in {*by, *INDEX, *columns}]
    return rows.join(df.select(*by, *INDEX, *more), [*by, *INDEX]).select(*df.columns) if more else rows.select(*df.columns)


def jacobian(field: DataFrame, by: Sequence[str], grid: Grid | Grids) -> DataFrame:
    """by, z, y, x, det of the identity plus the displacement's gradient, by central differences (edges repeated)."""
    u = ("dx", "dy", "dz")
    terms = {}
    for a, axis in enumerate("xyz"):
        for r, c in enumerate(u):
            terms[r, a] = (shift(F.col(c), by, axis, -1) - shift(F.col(c), by, axis, 1)) / 2
    rows, g = with_grid(field.withColumns({f"g{r}{a}": t for (r, a), t in terms.items()}), grid)
    if isinstance(grid, Grid):
        d = np.array(grid.direction).reshape(3, 3)
        along = lambda r, c: sum((F.col(f"g{r}{a}") / grid.spacing[a] * float(d[c, a]) for a in range(3) if d[c, a]), F.lit(1.0 if r == c else 0.0))
    else:
        along = lambda r, c: sum((F.col(f"g{r}{a}") / g.spacing(a) * F.get(g.column["direction"], F.lit(3 * c + a)) for a in range(3)), F.lit(1.0 if r == c else 0.0))
    # Gradients along grid axes become gradients along the world's axes.
    m = {(r, c): along(r, c) for r in range(3) for c in range(3)}
    det = m[0, 0] * (m[1, 1] * m[2, 2] - m[1, 2] * m[2, 1]) - m[0, 1] * (m[1, 0] * m[2, 2] - m[1, 2] * m[2, 0]) + m[0, 2] * (m[1, 0] * m[2, 1] - m[1, 1] * m[2, 0])
    return rows.select(*by, *INDEX, det.alias("det"))


#: Neighbours as (axis, side), and the pairs of them that are not opposite: the channels.
SIDES = tuple((axis, side) for axis in INDEX for side in (1, -1))
PAIRS = tuple((a, b) for a in range(6) for b in range(a + 1, 6) if SIDES[a][0] != SIDES[b][0])


def self_similarity(df: DataFrame, by: Sequence[str], grid: Grid, value: str = "v", radius: int = 2, dilation: int = 2, eps: float = 1e-5) -> DataFrame:
    """by, z, y, x, ch: twelve modality-independent channels (MIND with self-similarity context), each voxel by its maximum.

    A channel is exp(-d / variance): d the box mean of the squared difference of two shifted copies, variance the mean over
    channels, held within a thousandth and a thousandfold of its median over the volume.
    """
    least = min(grid.spacing)
    steps = {c: max(1, round(dilation * least / grid.spacing[2 - k])) for k, c in enumerate(INDEX)}
    rows = df.withColumns({f"s{i}": shift(F.col(value), by, axis, side * steps[axis]) for i, (axis, side) in enumerate(SIDES)})
    names = [f"d{i}" for i in range(len(PAIRS))]
    rows = rows.select(*by, *INDEX, *[((F.col(f"s{a}") - F.col(f"s{b}")) * (F.col(f"s{a}") - F.col(f"s{b}"))).alias(n) for n, (a, b) in zip(names, PAIRS, strict=True)])
    rows = box_mean(rows, by, names, radius, grid)
    rows = rows.withColumn("variance", sum((F.col(n) for n in names[1:]), F.col(names[0])) / len(names))
    # Sums along windows leave rounding errors where the difference is 0.
    middle = rows.groupBy(*by).agg(F.coalesce(F.median(F.when(F.col("variance") > 1e-12, F.col("variance"))), F.lit(1.0)).alias("_m"))
    rows = rows.join(middle, list(by))
    v = F.greatest(F.col("_m") * 1e-3, F.least(F.col("_m") * 1e3, "variance")) + eps
    rows = rows.select(*by, *INDEX, F.array(*[F.exp(-F.greatest(F.lit(0.0), F.col(n)) / v) for n in names]).alias("e"))
    return rows.select(*by, *INDEX, F.transform("e", lambda x: x / (F.array_max("e") + eps)).alias("ch"))


def gram(df: DataFrame, by: Sequence[str], channels: str = "ch") -> DataFrame:
    """by, i, j, n, mean_i, mean_j, cov (population) of the channels of one volume: c (c + 1) / 2 sums, added up in the map tasks."""
    rows = df.select(*by, F.posexplode(channels).alias("i", "a"), channels)
    rows = rows.select(*by, "i", F.col("a").cast("double").alias("a"), F.posexplode(channels).alias("j", "b")).where(F.col("j") >= F.col("i"))
    b = F.col("b").cast("double")
    return rows.groupBy(*by, "i", "j").agg(F.count("*").alias("n"), F.avg("a").alias("mean_i"), F.avg(b).alias("mean_j"), F.covar_pop("a", b).alias("cov"))


def principal_components(df: DataFrame, k: int, channels: str = "ch") -> tuple[np.ndarray, np.ndarray, float]:
    """(mean, components, explained share) over all voxels; the largest entry of each component is positive.

    Only the covariance, a square of the number of channels, comes to the driver.
    """
    rows = gram(df.withColumn("_all", F.lit(0)), ["_all"], channels).collect()
    n = max(r["j"] for r in rows) + 1
    cov, mean = np.zeros((n, n)), np.zeros(n)
    for r in rows:
        cov[r["i"], r["j"]] = cov[r["j"], r["i"]] = r["cov"]
        mean[r["i"]], mean[r["j"]] = r["mean_i"], r["mean_j"]
    if k >= n:
        return mean, np.eye(n), 1.0
    values, vectors = np.linalg.eigh(cov)
    top = vectors[:, ::-1][:, :k].T
    top = top * np.where(top[np.arange(k), np.abs(top).argmax(1)] < 0, -1.0, 1.0)[:, None]
    return mean, top, round(float(values[::-1][:k].sum() / max(values.sum(), 1e-300)), 4)


def projected(channels: Column, mean: np.ndarray, components: np.ndarray) -> Column:
    """The channels less the mean on each component."""
    centred = F.zip_with(channels, F.array(*map(F.lit, mean.tolist())), lambda x, m: x - m)
    dot = lambda w: F.aggregate(F.zip_with(centred, F.array(*map(F.lit, w.tolist())), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.array(*[dot(w) for w in components])
