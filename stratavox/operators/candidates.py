"""Starting points: candidate transforms of every case, scored in one plan and ranked."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.statistics import BINS_COARSE, ncc, nmi, rounded
from ..model import INDEX, Grid, Grids
from .resample import resampled
from .transforms import about, composed, rotation, translation

SCHEMA = "case_id long, ordinal int, name string, matrix array<double>"
#: Least gap between the two best scores that is not ambiguous.
AMBIGUOUS = 0.01


def geometry_start(fixed: Grid, moving: Grid) -> np.ndarray:
    """Grid centre on grid centre."""
    return translation(np.array(moving.centre) - np.array(fixed.centre))


def moments_start(fixed_centre: Sequence[float], moving_centre: Sequence[float]) -> np.ndarray:
    return translation(np.array(moving_centre) - np.array(fixed_centre))


def organ_centroid_start(fixed: DataFrame, moving: DataFrame) -> DataFrame:
    """case_id, n_organs, offset in mm: the mean difference of the centroids of organs that both sides have.

    fixed and moving: case_id, organ, cx, cy, cz.
    """
    other = moving.select("case_id", "organ", *[F.col(c).alias(f"m{c}") for c in ("cx", "cy", "cz")])
    rows = fixed.join(other, ["case_id", "organ"])
    return rows.groupBy("case_id").agg(F.count("*").alias("n_organs"), *[F.avg(F.col(f"m{c}") - F.col(c)).alias(f"d{c[1]}") for c in ("cx", "cy", "cz")])


def axes_start(fixed_centre: Sequence[float], fixed_axes: np.ndarray, fixed_lengths: Sequence[float], moving_centre: Sequence[float], moving_axes: np.ndarray, moving_lengths: Sequence[float]) -> np.ndarray:
    """Principal axes on principal axes: signs aligned, no mirror, an isotropic scale within 0.7 to 1.4. Axes are rows."""
    m = moving_axes * np.where((fixed_axes * moving_axes).sum(1) < 0, -1.0, 1.0)[:, None]
    if np.linalg.det(m.T @ fixed_axes) < 0:
        m[2] = -m[2]
    scale = float(np.clip(np.cbrt(np.prod(np.array(moving_lengths) / np.maximum(fixed_lengths, 1e-9))), 0.7, 1.4))
    return about(m.T @ fixed_axes * scale, fixed_centre, np.array(moving_centre) - np.array(fixed_centre))


def probes(base: np.ndarray, rotations: Sequence[Sequence[float]], centre: Sequence[float]) -> list[np.ndarray]:
    """The base after each rotation about the fixed centre; the base itself for none."""
    return [base if not any(r) else composed([about(rotation(r), centre), base]) for r in rotations]


def candidates(spark: SparkSession, starts: dict[int, dict[str, np.ndarray]], rotations: Sequence[Sequence[float]], centre: Sequence[float]) -> DataFrame:
    """Rows for every case, start and rotation, in order. Starts and rotations are parameters, a few for each case."""
    rows = []
    for case, found in starts.items():
        ordinal = 0
        for name, base in found.items():
            for r, m in zip(rotations, probes(base, rotations, centre), strict=True):
                rows.append((case, ordinal, name if not any(r) else f"{name}+rot{tuple(r)}", [float(v) for v in m.ravel()]))
                ordinal += 1
    return spark.createDataFrame(rows, SCHEMA)


def scored(candidates: DataFrame, fixed: DataFrame, moving: DataFrame, grid: Grid | Grids, source: Grid | Grids, default: float = 0.0, metric: str = "auto") -> DataFrame:
    """candidates with score: the mean of correlation and mutual information less 1 over the coarse grid, of those that are
    defined; NULL if none is. fixed and moving: case_id, z, y, x, v. All candidates of all cases are one job."""
    by = ["case_id", "ordinal"]
    moved = resampled(moving, candidates, by, grid, source, "matrix", "linear", default, on=["case_id"]).withColumnRenamed("v", "m")
    pairs = moved.join(fixed.select("case_id", *INDEX, F.col("v").alias("f")), ["case_id", *INDEX])
    c = pairs.groupBy(*by).agg(ncc("f", "m").alias("ncc"))
    rows = c.join(nmi(pairs, by, "f", "m", BINS_COARSE), by)
    parts = {"auto": F.array("ncc", F.col("nmi") - 1), "ncc": F.array("ncc"), "nmi": F.array(F.col("nmi") - 1)}[metric]
    parts = F.array_compact(parts)
    score = F.try_divide(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x), F.size(parts))
    return candidates.join(rows.withColumn("score", score).select(*by, "ncc", "nmi", "score"), by, "left")


def ranked(scored: DataFrame, by: Sequence[str] = ("case_id",)) -> DataFrame:
    """Ranks by score, candidates without one last, equal ones in their order; with the lead over the next, and whether the best
    is ambiguous."""
    score = F.coalesce(F.col("score"), F.lit(float("-inf")))
    w = Window.partitionBy(*by).orderBy(score.desc(), "ordinal")
    whole = Window.partitionBy(*by)
    rows = scored.withColumn("rank", F.row_number().over(w)).withColumn("lead", rounded(F.col("score") - F.lead("score").over(w), 4))
    spread = F.when(F.count("score").over(whole) == F.count("*").over(whole), rounded(F.max("score").over(whole) - F.min("score").over(whole), 4))
    return rows.withColumn("ambiguous", (F.col("rank") == 1) & F.coalesce(F.col("lead") < AMBIGUOUS, F.lit(False))).withColumn("score_spread", spread)
