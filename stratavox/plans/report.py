"""Records of runs: JSON manifests, batch summaries and a plain HTML report."""

from __future__ import annotations

import html
import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def manifests(verdicts: DataFrame, metrics: DataFrame, checks: DataFrame, by: Sequence[str] = ("case_id",)) -> DataFrame:
    """by, value: one JSON text for each run, nulls kept, never NaN."""
    figures = [c for c in metrics.columns if c not in by and c != "dice"]
    clean = [F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in metrics.select(*figures).dtypes]
    rows = verdicts.join(metrics.select(*by, F.struct(*clean).alias("metrics")), list(by))
    rows = rows.join(checks.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("name", "status", "measured", "threshold"))).alias("checks")), list(by))
    return rows.select(*by, F.to_json(F.struct(*by, "status", "metrics", "checks"), {"ignoreNullFields": "false"}).alias("value"))


def batch_rows(verdicts: DataFrame, metrics: DataFrame, by: Sequence[str] = ("case_id",)) -> DataFrame:
    """Flat rows for CSV: the verdict and all figures, dice as JSON; columns in order of name."""
    rows = verdicts.join(metrics, list(by), "left").withColumn("dice", F.to_json("dice"))
    return rows.select(*sorted(rows.columns))


def shown(value: object) -> str:
    if value is None or (isinstance(value, float) and not math.isfinite(value)):
        return "n/a"
    return f"{value:.4f}" if isinstance(value, float) else str(value)


def html_report(verdict: dict[str, object], checks: Sequence[dict[str, object]], metrics: dict[str, object]) -> str:
    """The report of one run: the verdict first, then its checks and figures. Its rows are few and collected by the caller."""
    cell = lambda v: f"<td>{html.escape(shown(v))}</td>"
    lines = "".join(f"<tr>{cell(c['name'])}{cell(c['status'])}{cell(c['measured'])}{cell(c['threshold'])}</tr>" for c in checks)
    figures = "".join(f"<tr>{cell(k)}{cell(v)}</tr>" for k, v in sorted(metrics.items()))
    return f"<!doctype html><meta charset=utf-8><title>Run</title><h1>{html.escape(str(verdict['status']))}</h1><table><tr><th>check<th>status<th>measured<th>threshold</tr>{lines}</table><table>{figures}</table><p>Research software, not a medical device."
