"""Acceptance gates: every run's figures against thresholds, as rows of checks, and the worst status of a run."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUS = ("PASS", "WARN", "FAIL")
CHECKS = "array<struct<name: string, status: string, measured: double, threshold: double>>"


@dataclass(frozen=True)
class Gates:
    """Thresholds; a gate that is None is not checked."""

    min_ncc_gain: float | None = None
    min_nmi_gain: float | None = None
    min_dice: dict[str, float] = field(default_factory=dict)
    max_folding_fraction: float | None = 1e-3
    min_abs_final_metric: float | None = 1e-6
    max_tre_mm: float | None = None
    max_translation_mm: float | None = 150.0
    max_scale_deviation: float | None = 0.35


def _check(name: str | Column, status: Column, measured: Column, threshold: float | None, when: Column | None = None) -> Column:
    row = F.struct((F.lit(name) if isinstance(name, str) else name).alias("name"), status.alias("status"), measured.cast("double").alias("measured"), F.lit(threshold).cast("double").alias("threshold"))
    return row if when is None else F.when(when, row)


def _bad(c: Column) -> Column:
    return c.isNull() | F.isnan(c)


def checks(runs: DataFrame, gates: Gates, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """by, name, status, measured, threshold: one row for each check of a run.

    With an array ``stages`` of structs with stage and final_metric, every stage has a check of its own instead of the run's.
    runs has ncc_gain, nmi_gain, final_metric, det_min, det_max, folding_fraction, deformable, translation_mm, scale_deviation,
    determinant, tre_mm and a map dice by organ; any of them may be NULL. A run without any check gets a warning.
    """
    out = []
    for name in ("ncc_gain", "nmi_gain"):
        limit = getattr(gates, f"min_{name}")
        if limit is not None:
            v = F.col(name)
            status = F.when(_bad(v) | ((v == 0) & F.lit(limit == 0)), "WARN").when(v < limit, "FAIL").otherwise("PASS")
            out.append(_check(name, status, v, limit))
    stages = None
    if gates.min_abs_final_metric is not None:
        metric = lambda name, v: _check(name, F.when(_bad(v) | (F.abs(v) == float("inf")), "WARN").when(F.abs(v) < gates.min_abs_final_metric, "FAIL").otherwise("PASS"), v, gates.min_abs_final_metric)
        if "stages" in runs.columns:
            named = lambda s: metric(F.concat(F.lit("final_metric["), s["stage"], F.lit("]")), s["final_metric"])
            stages = F.transform("stages", named)
        else:
            out.append(metric("final_metric", F.col("final_metric")))
    for organ, limit in gates.min_dice.items():
        v = F.try_element_at("dice", F.lit(organ))
        out.append(_check(f"dice[{organ}]", F.when(_bad(v), "WARN").when(v < limit, "FAIL").otherwise("PASS"), v, limit))
    if gates.max_folding_fraction is not None:
        v, d = F.col("folding_fraction"), F.coalesce(F.col("deformable"), F.lit(False))
        out.append(_check("folding_fraction", F.when(_bad(v), "WARN").when(v > gates.max_folding_fraction, "FAIL").otherwise("PASS"), v, gates.max_folding_fraction, ~_bad(v) | d))
        out.append(_check("jacobian_range", F.lit("WARN"), F.col("det_min"), None, (F.col("det_min") < 0.2) | (F.col("det_max") > 5)))
    for name in ("translation_mm", "scale_deviation"):
        limit = getattr(gates, f"max_{name}")
        if limit is not None:
            v = F.col(name)
            out.append(_check(name, F.when(v > limit, "FAIL").otherwise("PASS"), v, limit, ~_bad(v)))
    out.append(_check("determinant", F.lit("FAIL"), F.col("determinant"), None, F.col("determinant") <= 0))
    if gates.max_tre_mm is not None:
        v = F.col("tre_mm")
        out.append(_check("tre_mm", F.when(_bad(v), "WARN").when(v > gates.max_tre_mm, "FAIL").otherwise("PASS"), v, gates.max_tre_mm))
    nothing = F.array(_check("configuration", F.lit("WARN"), F.lit(None), None))
    found = F.filter(F.array(*out), lambda x: x.isNotNull())
    if stages is not None:
        found = F.concat(found, F.when(F.col("stages").isNull(), F.array().cast(CHECKS)).otherwise(stages))
    rows = runs.select(*by, F.explode(F.when(F.size(found) > 0, found).otherwise(nothing)).alias("c"))
    return rows.select(*by, "c.*")


def verdicts(checks: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """by, status (the worst), n_checks, n_failures, n_warnings."""
    level = F.array_position(F.array(*map(F.lit, STATUS)), F.col("status"))
    out = checks.groupBy(*by).agg(F.max(level).cast("int").alias("_l"), F.count("*").alias("n_checks"), F.count_if(F.col("status") == "FAIL").alias("n_failures"), F.count_if(F.col("status") == "WARN").alias("n_warnings"))
    return out.select(*by, F.element_at(F.array(*map(F.lit, STATUS)), F.col("_l")).alias("status"), "n_checks", "n_failures", "n_warnings")


def summary(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("status").agg(F.count("*").alias("n_runs"), F.sum("n_failures").alias("n_failures"))
