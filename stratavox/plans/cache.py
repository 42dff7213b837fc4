"""Results kept by content: what was computed for equal voxels and equal settings is not computed again."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fingerprints(voxels: DataFrame, by: Sequence[str], values: Sequence[str] = ("v",)) -> DataFrame:
    """by, fingerprint: of all voxels of a volume, in whatever order and partitions they come. Two sums of 64-bit hashes are added up
    in the map tasks, so no volume is gathered; equal rows count as often as they occur."""
    cells = ["z", "y", "x", *values]
    one, two = (F.sum(F.xxhash64(F.lit(seed), *cells).cast("decimal(38,0)")) for seed in ("a", "b"))
    rows = voxels.groupBy(*by).agg(F.count("*").alias("_n"), one.alias("_a"), two.alias("_b"))
    return rows.select(*by, F.sha2(F.concat_ws("/", F.col("_n").cast("string"), F.col("_a").cast("string"), F.col("_b").cast("string")), 256).alias("fingerprint"))


def combined(sides: Sequence[DataFrame], by: Sequence[str], settings: str = "") -> DataFrame:
    """by, key: one key for all fingerprints of a case and the settings; a side that is missing counts as none."""
    rows = sides[0].withColumnRenamed("fingerprint", "_f0")
    for k, more in enumerate(sides[1:], 1):
        rows = rows.join(more.withColumnRenamed("fingerprint", f"_f{k}"), list(by), "left")
    parts = [F.coalesce(F.col(f"_f{k}"), F.lit("-")) for k in range(len(sides))]
    return rows.select(*by, F.sha2(F.concat_ws("/", *parts, F.sha2(F.lit(settings).cast("binary"), 256)), 256).alias("key"))


def kept(store: DataFrame | None, keys: DataFrame) -> DataFrame:
    """The rows of keys (by, key) that the store has no result for, one for each key."""
    least = keys.groupBy("key").agg(F.min(F.struct(*[c for c in keys.columns if c != "key"])).alias("_c")).select("_c.*", "key")
    return least if store is None else least.join(store.select("key").distinct(), "key", "left_anti")


def computed_once(path: str, keys: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The results of all rows of keys (by, key), each computed once for equal keys and kept as Parquet under path.

    compute gets the rows that have no result yet and returns rows with their ``by``; several rows a case are fine. Its result is
    appended by one job, so a run that fails leaves no part of it. Equal cases get the same result.
    """
    spark, by = keys.sparkSession, [c for c in keys.columns if c != "key"]

    def stored() -> DataFrame | None:
        try:
            return spark.read.parquet(path)
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" in str(missing) or "UNABLE_TO_INFER_SCHEMA" in str(missing):
                return None
            raise

    missing = kept(stored(), keys)
    if missing.limit(1).count():
        made = compute(missing).join(missing, by).drop(*by)
        made.write.mode("append").parquet(path)
    return keys.join(stored(), "key").drop("key")
