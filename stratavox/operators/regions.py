"""Regions of interest: the mask that a fit works on, the crop around targets, and figures of every organ.

Organs are voxels (by, z, y, x, organ), several rows a voxel where organs overlap.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import INDEX, Grid, Grids, with_grid
from .geometry import bounding_box
from .morphology import body_mask, dilated
from .overlap import overlap
from .surface import surface_distances

#: Masks with fewer voxels than this restrict nothing.
LEAST_MASK = 512


def combined_mask(organs: DataFrame, by: Sequence[str], grid: Grid | Grids, targets: Sequence[str] = (), dilate_mm: float = 8.0, voxels: DataFrame | None = None, modality: str = "UNKNOWN") -> DataFrame:
    """by, z, y, x: the targets of a case that has any of them, else all its organs, both dilated.

    A case without organs gets the body, not dilated, if its voxels are given, and no row otherwise.
    """
    by = list(by)
    every = organs.select(*by, *INDEX).distinct()
    mask = every
    if targets:
        mask = organs.where(F.col("organ").isin(*targets)).select(*by, *INDEX).distinct()
        mask = mask.unionByName(every.join(mask.select(*by).distinct(), by, "left_anti"))
    if dilate_mm > 0:
        mask = dilated(mask, by, dilate_mm, grid)
    if voxels is None:
        return mask
    bare = voxels.join(every.select(*by).distinct(), by, "left_anti")
    return mask.unionByName(body_mask(bare, by, grid, modality))


def working_mask(mask: DataFrame, by: Sequence[str], least: int = LEAST_MASK) -> DataFrame:
    """The masks that have enough voxels; a case without rows here uses its whole volume."""
    enough = mask.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    return mask.join(enough.select(*by), list(by), "left_semi")


def roi_plan(cases: DataFrame, fixed: DataFrame, moving: DataFrame, by: Sequence[str], fixed_grid: Grid | Grids, moving_grid: Grid | Grids, targets: Sequence[str], margin_mm: float) -> DataFrame:
    """by, applied, reason, then for either side low and high index of each axis and the number of voxels, and speedup (1 digit).

    Each side is cropped to its own organs, so the crop needs no transform; positions stay as they are. A side without any of the
    targets stays whole, and so do both where there is no target or one side has no organ; ``reason`` says which.
    """
    by = list(by)
    rows = cases.select(*by).distinct()
    for side, organs in (("fixed", fixed), ("moving", moving)):
        grid = fixed_grid if side == "fixed" else moving_grid
        there = organs.select(*by).distinct().withColumn(f"_{side}", F.lit(True))
        wanted = organs.where(F.col("organ").isin(*targets)) if targets else organs.limit(0)
        box = bounding_box(wanted, by, grid, margin_mm)
        ends = [f"{c}_{e}" for c in INDEX for e in ("low", "high")]
        rows = rows.join(there, by, "left").join(box.select(*by, *[F.col(e).alias(f"{side}_{e}") for e in ends]), by, "left")
    both = F.col("_fixed").isNotNull() & F.col("_moving").isNotNull() & F.lit(bool(targets))
    rows = rows.withColumn("applied", both)
    rows = rows.withColumn("reason", F.when(F.lit(not targets), "no target").when(~F.col("applied"), "missing segmentation"))
    before = F.lit(0).cast("long")
    for side, grid in (("fixed", fixed_grid), ("moving", moving_grid)):
        rows, g = with_grid(rows, grid, f"_{side}_grid")
        total = F.lit(1).cast("long")
        for k, c in enumerate(INDEX):
            low, high = (F.coalesce(F.when(F.col("applied"), F.col(f"{side}_{c}_{e}")), v) for e, v in (("low", F.lit(0)), ("high", g.size(2 - k) - 1)))
            rows = rows.withColumns({f"{side}_{c}_low": low, f"{side}_{c}_high": high})
            total = total * (F.col(f"{side}_{c}_high") - F.col(f"{side}_{c}_low") + 1)
        rows = rows.withColumn(f"{side}_voxels", total)
        before = before + g.n_voxels
    speedup = F.round(before / (F.col("fixed_voxels") + F.col("moving_voxels")), 1)
    return rows.withColumn("speedup", speedup).drop("_fixed", "_moving", "_fixed_grid", "_moving_grid")


def organ_report(fixed: DataFrame, moving: DataFrame, by: Sequence[str], grid: Grid | Grids, organs: Sequence[str] | None = None) -> DataFrame:
    """by, organ, dice (4 digits), hd95_mm, msd_mm, fixed_ml, moving_ml (2 digits) of the organs that both sides have."""
    by = [*by, "organ"]
    if organs is not None:
        fixed, moving = (side.where(F.col("organ").isin(*organs)) for side in (fixed, moving))
    rows = overlap(fixed, moving, by[:-1]).where((F.col("n_fixed") > 0) & (F.col("n_moving") > 0))
    f, m = (side.select(*by, *INDEX).distinct().join(rows.select(*by), by, "left_semi") for side in (fixed, moving))
    rows = rows.join(surface_distances(f, m, by, grid), by, "left")
    rows, g = with_grid(rows, grid)
    ml = lambda c: F.round(F.col(c) * (F.lit(grid.voxel_ml) if isinstance(grid, Grid) else g.voxel_ml), 2)
    return rows.select(*by, "dice", F.col("hd95").alias("hd95_mm"), F.col("msd").alias("msd_mm"), ml("n_fixed").alias("fixed_ml"), ml("n_moving").alias("moving_ml"))


def agreed_labels(fixed_names: DataFrame, moving_names: DataFrame) -> DataFrame:
    """volume_id, label, organ, agrees: whether the moving side has the fixed side's name under the same number. Overlap by number
    is meaningless for the others."""
    there = moving_names.select("volume_id", "label", "organ").distinct().withColumn("agrees", F.lit(True))
    rows = fixed_names.select("volume_id", "label", "organ").distinct().join(there, ["volume_id", "label", "organ"], "left")
    return rows.withColumn("agrees", F.coalesce("agrees", F.lit(False)))
