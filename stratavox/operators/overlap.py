"""Label maps: organs present, volumes, centroids, and overlap of two label maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import INDEX, Grid


def named(labels: DataFrame, names: DataFrame) -> DataFrame:
    """labels with the organ of each label; labels without a name are called label_N. names has a row for each label of a volume."""
    rows = labels.join(names.select("volume_id", "label", "organ"), ["volume_id", "label"], "left")
    return rows.withColumn("organ", F.coalesce("organ", F.concat(F.lit("label_"), F.col("label").cast("string"))))


def present_organs(labels: DataFrame, names: DataFrame) -> DataFrame:
    """volume_id, organ of labels that have voxels and a name."""
    found = labels.where(F.col("label") != 0).select("volume_id", "label").distinct()
    return found.join(names, ["volume_id", "label"]).select("volume_id", "organ").distinct()


def missing_targets(targets: DataFrame, present: DataFrame) -> DataFrame:
    return targets.join(present, ["volume_id", "organ"], "left_anti")


def organ_volumes(labels: DataFrame, names: DataFrame, voxel_ml: float | Column) -> DataFrame:
    """volume_id, organ, n_voxels, volume_ml (2 digits); labels of one organ are added up."""
    rows = named(labels.where(F.col("label") != 0), names).groupBy("volume_id", "organ").agg(F.count("*").alias("n_voxels"))
    return rows.withColumn("volume_ml", F.round(F.col("n_voxels") * voxel_ml, 2))


def organ_centroids(labels: DataFrame, grid: Grid) -> DataFrame:
    """volume_id, label, n_voxels, cx, cy, cz in mm."""
    mean = labels.where(F.col("label") != 0).groupBy("volume_id", "label").agg(F.count("*").alias("n_voxels"), *[F.avg(c).alias(c) for c in INDEX])
    position = grid.position(F.col("x"), F.col("y"), F.col("z"))
    return mean.select("volume_id", "label", "n_voxels", *[p.alias(n) for p, n in zip(position, ("cx", "cy", "cz"), strict=True)])


def organ_mask(labels: DataFrame, names: DataFrame, organs: Sequence[str] | None = None) -> DataFrame:
    """Voxels (volume_id, z, y, x) of the organs, all labels of an organ together; of any label if organs is None."""
    rows = labels.where(F.col("label") > 0)
    if organs is not None:
        if not organs:
            raise ValueError("no organ is named")
        rows = named(rows, names).where(F.col("organ").isin(*organs))
    return rows.select("volume_id", *INDEX).distinct()


def first_come(masks: DataFrame) -> DataFrame:
    """One label map of overlapping masks (volume_id, label, z, y, x): the smallest label has a voxel."""
    return masks.groupBy("volume_id", *INDEX).agg(F.min("label").alias("label"))


def dice(n_a: Column, n_b: Column, n_ab: Column) -> Column:
    """Dice coefficient; NULL if both are empty."""
    return F.try_divide(2.0 * n_ab, n_a + n_b)


def overlap(fixed: DataFrame, moving: DataFrame, by: Sequence[str], organ: str = "organ") -> DataFrame:
    """by, organ, n_fixed, n_moving, n_both, dice (4 digits). fixed and moving: by, z, y, x, organ.

    Both sides are stacked and reduced by voxel in one shuffle, then by organ from map-side sums; organs that only one side has
    get 0. Matching is by organ name, so label numbers may differ.
    """
    stacked = fixed.select(*by, *INDEX, organ, F.lit(1).alias("f"), F.lit(0).alias("m")).unionByName(moving.select(*by, *INDEX, organ, F.lit(0).alias("f"), F.lit(1).alias("m")))
    voxels = stacked.groupBy(*by, *INDEX, organ).agg(F.max("f").alias("f"), F.max("m").alias("m"))
    out = voxels.groupBy(*by, organ).agg(F.sum("f").alias("n_fixed"), F.sum("m").alias("n_moving"), F.sum(F.col("f") * F.col("m")).alias("n_both"))
    return out.withColumn("dice", F.round(dice(F.col("n_fixed"), F.col("n_moving"), F.col("n_both")), 4))


def common_organs(fixed: DataFrame, moving: DataFrame, by: Sequence[str]) -> DataFrame:
    return fixed.join(moving.select(*by, "organ"), [*by, "organ"])
