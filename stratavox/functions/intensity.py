"""Intensity functions: finite values, clipping, normalisation and repair, for many volumes in one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Grid, Grids
from ..operators.neighbourhood import gaussian
from ..shared import written
from . import quantiles

# Bounds in Hounsfield units.
HU_WINDOWS = {
    "ct_full": (-1024.0, 3071.0),
    "ct_soft": (-160.0, 240.0),
    "ct_abdomen": (-150.0, 250.0),
    "ct_liver": (-30.0, 180.0),
    "ct_lung": (-1000.0, 200.0),
    "ct_mediastinum": (-125.0, 225.0),
    "ct_bone": (-200.0, 1000.0),
    "ct_brain": (0.0, 80.0),
    "ct_registration": (-450.0, 450.0),
}
# Percentiles to clip at by modality; none for quantitative ones, the last for any other.
CLIP_PERCENTILES = {"CT": None, "CBCT": None, "MR": (0.5, 99.5), "PT": (0.0, 99.5), "NM": (0.0, 99.5), "US": (1.0, 99.0)}
CLIP_OTHER = (0.5, 99.5)
FEATURE_CLIP = (-450.0, 450.0)
#: Ranges and deviations below this are constant images.
FLAT = 1e-8


def finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))


def clip(v: Column, low: Column | float, high: Column | float) -> Column:
    low, high = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))
    return F.greatest(low, F.least(high, v))


def percentiles_for(modality: str | None) -> tuple[float, float] | None:
    return CLIP_PERCENTILES.get((modality or "").upper(), CLIP_OTHER)


def measured(df: DataFrame, stats: DataFrame, by: Sequence[str]) -> DataFrame:
    """df with the figures of its volumes, one row each. Written first, they have a known size: while they are small Spark broadcasts
    them, where it would deal all rows by volume, a few volumes to a few tasks, on the size that it guesses of an aggregate."""
    return df.join(written(stats, "stats"), list(by), "left")


def clip_bounds(df: DataFrame, by: Sequence[str], value: str = "v", clip: tuple[float, float] | None = None, window: str | None = None, percentiles: tuple[float, float] | None = None) -> DataFrame:
    """by, low, high: explicit bounds win over a named window, and both over percentiles of the finite values.

    Percentiles are exact, by linear interpolation; both are NULL where there is no value or no range.
    """
    if clip is None and window is not None:
        if window.lower() not in HU_WINDOWS:
            raise ValueError(f"unknown window {window!r}; there are {sorted(HU_WINDOWS)}")
        clip = HU_WINDOWS[window.lower()]
    keys = df.select(*by).distinct()
    if clip is not None:
        return keys.select(*by, F.lit(float(clip[0])).alias("low"), F.lit(float(clip[1])).alias("high"))
    if percentiles is None:
        return keys.select(*by, F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))
    found = quantiles.percentiles(df, by, value, [p / 100 for p in percentiles])
    low, high = F.get("p", F.lit(0)), F.get("p", F.lit(1))
    return found.select(*by, F.when(high > low, low).alias("low"), F.when(high > low, high).alias("high"))


def clipped(df: DataFrame, bounds: DataFrame, by: Sequence[str], value: str = "v") -> DataFrame:
    """df with value clipped to the bounds of its volume; a volume without bounds keeps its values."""
    rows = measured(df, bounds.select(*by, F.col("low").alias("_low"), F.col("high").alias("_high")), by)
    return rows.withColumn(value, F.when(F.col("_low").isNull(), F.col(value)).otherwise(clip_column(value))).drop("_low", "_high")


def clip_column(value: str) -> Column:
    return clip(F.col(value), F.col("_low"), F.col("_high"))


def min_max(df: DataFrame, by: Sequence[str], value: str = "v") -> DataFrame:
    """value scaled to 0..1 by the finite range of its volume; a constant volume is left as it is."""
    v = F.when(finite(F.col(value)), F.col(value))
    stats = df.groupBy(*by).agg(F.min(v).alias("_low"), F.max(v).alias("_high"))
    range_ = F.col("_high") - F.col("_low")
    return measured(df, stats, by).withColumn(value, F.when(range_ < FLAT, F.col(value)).otherwise((F.col(value) - F.col("_low")) / range_)).drop("_low", "_high")


def z_score(df: DataFrame, by: Sequence[str], value: str = "v") -> DataFrame:
    """value less its mean over its sample deviation; a constant volume is left as it is."""
    v = F.when(finite(F.col(value)), F.col(value))
    stats = df.groupBy(*by).agg(F.avg(v).alias("_mean"), F.stddev_samp(v).alias("_sd"))
    flat = F.coalesce(F.col("_sd"), F.lit(0.0)) < FLAT
    return measured(df, stats, by).withColumn(value, F.when(flat, F.col(value)).otherwise((F.col(value) - F.col("_mean")) / F.col("_sd"))).drop("_mean", "_sd")


def repaired(df: DataFrame, by: Sequence[str], value: str = "v") -> DataFrame:
    """NaN and minus infinity become the finite minimum, infinity the maximum; 0 in a volume without any finite value."""
    v = F.when(finite(F.col(value)), F.col(value))
    stats = df.groupBy(*by).agg(F.min(v).alias("_low"), F.max(v).alias("_high"))
    fixed = F.when(finite(F.col(value)), F.col(value)).when(F.col(value) == float("inf"), F.col("_high")).otherwise(F.col("_low"))
    return measured(df, stats, by).withColumn(value, F.coalesce(fixed, F.lit(0.0))).drop("_low", "_high")


def feature_normalised(df: DataFrame, by: Sequence[str], value: str = "v", modality: str | None = None) -> DataFrame:
    """What feature extractors read: non-finite values 0, CT clipped to its window, scaled to 0..1; a constant volume is 0."""
    v = F.when(finite(F.col(value)), F.col(value)).otherwise(0.0)
    v = clip(v, *FEATURE_CLIP) if (modality or "").upper() in ("CT", "CBCT") else v
    rows = df.withColumn(value, v)
    stats = rows.groupBy(*by).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    range_ = F.col("_high") - F.col("_low")
    return measured(rows, stats, by).withColumn(value, F.when(range_ < FLAT, 0.0).otherwise((F.col(value) - F.col("_low")) / range_)).drop("_low", "_high")


def prepared(df: DataFrame, by: Sequence[str], value: str = "v", *, modality: str | None = None, clip: tuple[float, float] | None = None, window: str | None = None, percentiles: tuple[float, float] | str | None = "auto", smooth_mm: float | None = None, grid: Grid | Grids | None = None, normalize: str = "none") -> DataFrame:
    """The preparation chain: repair, clip (bounds measured on the repaired values), smooth (a dense volume, by its grid), normalise."""
    if percentiles == "auto":
        percentiles = None if clip or window else percentiles_for(modality)
    rows = repaired(df, by, value)
    rows = clipped(rows, clip_bounds(rows, by, value, clip, window, percentiles), by, value)
    if smooth_mm:
        if grid is None:
            raise ValueError("smoothing needs the grid")
        rows = gaussian(rows, by, [value], smooth_mm, grid)
    return {"none": lambda x: x, "minmax": lambda x: min_max(x, by, value), "zscore": lambda x: z_score(x, by, value)}[normalize](rows)


def channel_normalised(channels: Column, mode: str = "l2") -> Column:
    """An array of channels over its length ("l2") or as z-scores ("zscore", population deviation), or as it is ("none")."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))
    if mode == "none":
        return channels
    if mode == "l2":
        length = F.sqrt(total(F.transform(channels, lambda x: x.cast("double") * x)))
        return F.get(F.transform(F.array(length), lambda n: F.transform(channels, lambda x: x.cast("double") / (n + 1e-6))), F.lit(0))
    if mode != "zscore":
        raise ValueError(f"unknown mode {mode!r}")
    mean = total(channels) / F.size(channels)

    def scaled(m: Column) -> Column:
        sd = F.sqrt(total(F.transform(channels, lambda x: (x - m) * (x - m))) / F.size(channels))
        return F.get(F.transform(F.array(sd), lambda s: F.transform(channels, lambda x: (x - m) / (s + 1e-6))), F.lit(0))

    return F.get(F.transform(F.array(mean), scaled), F.lit(0))
