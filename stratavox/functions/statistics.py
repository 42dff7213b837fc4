"""Masked statistics of volumes: description, correlation, mutual information, errors and deformation figures.

Everything takes the key columns ``by`` of a case, so one plan serves any number of cases. Values that are not finite on
either side never count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intensity import finite
from .quantiles import beside, percentiles

#: Least voxels for a correlation and for mutual information; bins of the latter for reports and for candidates.
LEAST_NCC, LEAST_NMI, BINS, BINS_COARSE = 64, 256, 64, 48


def rounded(v: Column, digits: int) -> Column:
    """v at ``digits`` decimals as SQL engines round doubles: scaled, rounded to a whole number (halves away from zero), scaled back.
    ``F.round`` rounds the shortest decimal text instead, so 0.285, whose hundredfold is 28.499999999999996, becomes 0.29 there."""
    return F.round(v * 10.0**digits, 0) / 10.0**digits


def describe(df: DataFrame, by: Sequence[str], value: str = "v", mask: Column | None = None) -> DataFrame:
    """by, n, n_nonfinite, min, max (4 digits), p1, p99 (1 digit) of each volume, of the voxels for which the mask holds if there is one."""
    df = df if mask is None else df.where(mask)
    ok = finite(F.col(value))
    v = F.when(ok, F.col(value))
    out = df.groupBy(*by).agg(F.count("*").alias("n"), F.count(F.when(~ok, 1)).alias("n_nonfinite"), F.round(F.min(v), 4).alias("min"), F.round(F.max(v), 4).alias("max"))
    out = beside(out, percentiles(df, by, value, (0.01, 0.99)), by)
    return out.select(*by, "n", "n_nonfinite", "min", "max", F.round(F.get("p", F.lit(0)), 1).alias("p1"), F.round(F.get("p", F.lit(1)), 1).alias("p99"))


def _pair(a: str, b: str) -> tuple[Column, Column]:
    ok = finite(F.col(a)) & finite(F.col(b))
    return F.when(ok, F.col(a)), F.when(ok, F.col(b))


def ncc(a: str, b: str, least: int = LEAST_NCC) -> Column:
    """Pearson correlation as an aggregate; NULL below ``least`` pairs or without variance."""
    x, y = _pair(a, b)
    flat = (F.var_pop(x) <= 0) | (F.var_pop(y) <= 0)
    value = F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y)))
    return F.when((F.count(x) >= least) & ~flat, value)


def nmi(df: DataFrame, by: Sequence[str], a: str, b: str, bins: int = BINS, least: int = LEAST_NMI) -> DataFrame:
    """by, nmi = (H(A) + H(B)) / H(A, B) over equal bins of each side's range; NULL below ``least`` pairs or without entropy.

    The joint histogram is the only shuffle that depends on voxels, and map tasks reduce it to bins squared rows a case.
    With counts c and total n, H = ln n - sum(c ln c) / n, so no second pass over voxels is needed for probabilities.
    """
    x, y = _pair(a, b)
    rows = df.select(*by, x.alias("_a"), y.alias("_b")).where(F.col("_a").isNotNull())
    edges = rows.groupBy(*by).agg(*[f(c).alias(f"{c}_{n}") for c in ("_a", "_b") for f, n in ((F.min, "low"), (F.max, "high"))])

    def cell(c: str) -> Column:
        flat = F.col(f"{c}_high") <= F.col(f"{c}_low")
        low = F.when(flat, F.col(f"{c}_low") - 0.5).otherwise(F.col(f"{c}_low"))
        width = F.when(flat, 1.0).otherwise(F.col(f"{c}_high") - F.col(f"{c}_low"))
        return F.least(F.lit(bins - 1), F.floor((F.col(c) - low) / width * bins)).cast("int")

    joint = rows.join(edges, list(by)).select(*by, cell("_a").alias("_i"), cell("_b").alias("_j")).groupBy(*by, "_i", "_j").agg(F.count("*").alias("_c"))
    # One more aggregation over at most bins squared rows a case gives all three entropies.
    sides = joint.select(*by, F.explode(F.array(F.struct(F.lit("a").alias("s"), F.col("_i").alias("i"), F.lit(-1).alias("j")), F.struct(F.lit("b").alias("s"), F.lit(-1).alias("i"), F.col("_j").alias("j")), F.struct(F.lit("ab").alias("s"), F.col("_i").alias("i"), F.col("_j").alias("j")))).alias("_k"), "_c")
    counts = sides.groupBy(*by, "_k").agg(F.sum("_c").alias("_c")).groupBy(*by, F.col("_k.s").alias("_side")).agg(F.sum("_c").alias("_n"), F.sum(F.col("_c") * F.log("_c")).alias("_t"))
    entropy = F.log("_n") - F.col("_t") / F.col("_n")
    pick = lambda s: F.max(F.when(F.col("_side") == s, entropy))
    total = pick("ab")
    return counts.groupBy(*by).agg(F.when((F.max("_n") >= least) & (total > 1e-12), (pick("a") + pick("b")) / total).alias("nmi"))


def similarity_report(df: DataFrame, by: Sequence[str], fixed: str, before: str, after: str, mask: Column | None = None) -> DataFrame:
    """by, ncc and nmi before and after (4 digits), their gains (differences of the rounded figures) and the number of voxels, of the
    voxels for which the mask holds if there is one."""
    df = df if mask is None else df.where(mask)
    flat = df.groupBy(*by).agg(F.count("*").alias("n_voxels_evaluated"), F.round(ncc(fixed, before), 4).alias("ncc_before"), F.round(ncc(fixed, after), 4).alias("ncc_after"))
    sides = F.array(*[F.struct(F.lit(n).alias("_s"), F.col(c).alias("_m")) for n, c in (("before", before), ("after", after))])
    both = nmi(df.select(*by, F.col(fixed).alias("_f"), F.inline(sides)), [*by, "_s"], "_f", "_m")
    pick = lambda n: F.round(F.max(F.when(F.col("_s") == n, F.col("nmi"))), 4).alias(f"nmi_{n}")
    flat = flat.join(both.groupBy(*by).agg(pick("before"), pick("after")), list(by), "left")
    gain = lambda m: F.round(F.col(f"{m}_after") - F.col(f"{m}_before"), 4).alias(f"{m}_gain")
    return flat.select(*by, "n_voxels_evaluated", "ncc_before", "ncc_after", gain("ncc"), "nmi_before", "nmi_after", gain("nmi"))


def registration_error(df: DataFrame, by: Sequence[str], moved: Sequence[str], target: Sequence[str], start: Sequence[str]) -> DataFrame:
    """Landmark errors in mm (2 digits): mean, median, p95, max, mean before, and their number.

    df has a row for each landmark with positions after the transform, of the target, and before it.
    """
    length = lambda a, b: F.sqrt(sum(((F.col(p) - F.col(q)) * (F.col(p) - F.col(q)) for p, q in zip(a, b, strict=True)), F.lit(0.0)))
    rows = df.select(*by, length(moved, target).alias("e"), length(start, target).alias("e0"))
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg("e"), 2).alias("mean"), F.percentile("e", F.array(F.lit(0.5), F.lit(0.95))).alias("p"), F.round(F.max("e"), 2).alias("max"), F.round(F.avg("e0"), 2).alias("mean_before"))
    return out.select(*by, "n", "mean", F.round(F.get("p", F.lit(0)), 2).alias("median"), F.round(F.get("p", F.lit(1)), 2).alias("p95"), "max", "mean_before")


def jacobian_statistics(df: DataFrame, by: Sequence[str], det: str = "det") -> DataFrame:
    """Figures of the Jacobian determinant; voxels whose determinant is 0 or less are folded."""
    v = F.when(finite(F.col(det)), F.col(det))
    out = df.groupBy(*by).agg(F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.avg(v).alias("m"), F.stddev_pop(v).alias("s"), F.percentile(v, F.array(F.lit(0.01), F.lit(0.99))).alias("p"), F.count(F.when(v <= 0, 1)).alias("n_folded"))
    r = lambda c, name: F.round(c, 4).alias(name)
    return out.select(*by, "n", r("lo", "det_min"), r("hi", "det_max"), r("m", "det_mean"), r("s", "det_std"), r(F.get("p", F.lit(0)), "det_p1"), r(F.get("p", F.lit(1)), "det_p99"), "n_folded", F.round(F.try_divide(F.col("n_folded"), F.col("n")), 6).alias("folding_fraction"))


def displacement_statistics(field: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean, p95 and maximum of displacement lengths in mm (3 digits)."""
    u = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz"))
    u = F.when(finite(u), u)
    return field.groupBy(*by).agg(F.round(F.avg(u), 3).alias("mean_mm"), F.round(F.percentile(u, F.lit(0.95)), 3).alias("p95_mm"), F.round(F.max(u), 3).alias("max_mm"))


def histogram(df: DataFrame, by: Sequence[str], value: str = "v", bins: int = 128) -> DataFrame:
    """by, bin, centre, n over equal bins of each volume's finite range, the last one closed."""
    v = F.when(finite(F.col(value)), F.col(value))
    rows = df.select(*by, v.alias("_v")).where(F.col("_v").isNotNull())
    edges = rows.groupBy(*by).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    flat = F.col("_high") <= F.col("_low")
    low, width = F.when(flat, F.col("_low") - 0.5).otherwise(F.col("_low")), F.when(flat, 1.0).otherwise(F.col("_high") - F.col("_low"))
    cell = F.least(F.lit(bins - 1), F.floor((F.col("_v") - low) / width * bins)).cast("int")
    rows = rows.join(edges, list(by)).select(*by, cell.alias("bin"), low.alias("_from"), width.alias("_width"))
    return rows.groupBy(*by, "bin", "_from", "_width").agg(F.count("*").alias("n")).select(*by, "bin", (F.col("_from") + (F.col("bin") + 0.5) * F.col("_width") / bins).alias("centre"), "n")
