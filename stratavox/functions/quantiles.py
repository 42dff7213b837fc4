"""Exact percentiles of large groups by refinement: histograms that narrow down to the bucket of a rank, never a sorted volume."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written

#: Buckets of a pass, and values up to which a bucket is ranked as it is. Groups of up to FEW values are left to Spark's own
#: aggregate, which holds all distinct values of a group.
BINS, RANKED, FEW = 1024, 65_536, 1 << 20


def finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))


def beside(rows: DataFrame, more: DataFrame, by: Sequence[str]) -> DataFrame:
    """Two tables of one row a group, side by side; NULL keys are equal. Without keys there is one row of either."""
    if not by:
        return rows.crossJoin(more)  # one row each
    keys = [F.col(f"_r.{c}").eqNullSafe(F.col(f"_m.{c}")) for c in by]
    on = keys[0]
    for k in keys[1:]:
        on = on & k
    return rows.alias("_r").join(more.alias("_m"), on, "left").select("_r.*", *[F.col(f"_m.{c}") for c in more.columns if c not in by])


def percentiles(df: DataFrame, by: Sequence[str], value: str, fractions: Sequence[float]) -> DataFrame:
    """by, p: the exact percentiles of the finite values of each group, by linear interpolation between ranks; NULL of none.

    Each pass counts the values in equal buckets between the ends of the one that holds a rank and keeps that bucket by its own least
    and greatest value, so no value is ever on a wrong side; map tasks reduce all values to BINS rows a rank. A rank is found when
    its bucket has one value, or few enough to be ranked.
    """
    by = list(by)
    v = F.when(finite(F.col(value)), F.col(value).cast("double"))
    sizes = written(df.groupBy(*by).agg(F.count(v).alias("n"), F.min(v).alias("low"), F.max(v).alias("high")), "sizes")
    if (sizes.agg(F.max("n")).first()[0] or 0) <= FEW:
        return df.groupBy(*by).agg(F.percentile(v, F.array(*[F.lit(float(f)) for f in fractions])).alias("p"))
    values = df.select(*[F.col(c).alias(f"_{c}") for c in by], v.alias("_v")).where(F.col("_v").isNotNull())
    at = [F.lit(float(f)) * (F.col("n") - 1) for f in fractions]
    ranks = F.array_distinct(F.concat(F.array(*[F.floor(a) for a in at]), F.array(*[F.ceil(a) for a in at])))
    todo = sizes.where("n > 0").select(*by, F.explode(ranks).alias("rank"), F.lit(0).cast("long").alias("before"), "low", "high", "n")
    done = None
    same = lambda: [F.col(f"_{c}").eqNullSafe(F.col(c)) for c in by]
    on = lambda: _all([*same(), F.col("_v") >= F.col("low"), F.col("_v") <= F.col("high")])
    while True:
        todo = written(todo, "ranks")
        found = todo.where("low = high").select(*by, "rank", F.col("low").alias("x"))
        done = found if done is None else done.unionByName(found)
        todo = todo.where("low < high")
        most = todo.agg(F.max("n")).first()[0]
        if most is None:
            break
        if most <= RANKED:
            place = F.row_number().over(Window.partitionBy(*by, "rank").orderBy("_v")) - 1 + F.col("before")
            rows = values.join(todo, on()).select(*by, "rank", "before", "_v").withColumn("_at", place)
            done = done.unionByName(rows.where("_at = rank").select(*by, "rank", F.col("_v").alias("x")))
            break
        # Halves first, so that the width of a range of any doubles is finite.
        part = (F.col("_v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)
        bucket = F.least(F.lit(BINS - 1), F.floor(part * BINS)).cast("int")
        counts = values.join(todo, on()).groupBy(*by, "rank", "before", bucket.alias("bucket")).agg(F.count("*").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
        upto = F.col("before") + F.sum("n").over(Window.partitionBy(*by, "rank").orderBy("bucket"))
        counts = counts.withColumn("upto", upto).where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("n") <= F.col("rank")))
        todo = counts.select(*by, "rank", (F.col("upto") - F.col("n")).alias("before"), "low", "high", "n")
    found = done.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("x"))
    rows = beside(sizes.select(*by, "n"), found, by)
    x = lambda r: F.try_element_at("x", r.cast("long"))
    made = [x(F.floor(a)) + (x(F.ceil(a)) - x(F.floor(a))) * (a - F.floor(a)) for a in at]
    return rows.select(*by, F.when(F.col("n") > 0, F.array(*made)).alias("p"))


def _all(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
