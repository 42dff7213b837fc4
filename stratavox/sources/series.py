"""Image series: inventory of files, order of slices, volumes made of them, warnings, and the stored form of values."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import bound_batches
from .files import dicom_headers, dicom_slices


def inventory(headers: DataFrame, by: Sequence[str] = ("series_uid",)) -> DataFrame:
    """by, n_files, first_file, modality and rank by number of files. headers: by, path, modality; a series that is spread over
    folders is one. The rank is over one row a series."""
    rows = headers.groupBy(*by).agg(F.count("*").alias("n_files"), F.min("path").alias("first_file"), F.min_by("modality", "path").alias("modality"))
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.col("n_files").desc(), *by)))


def slice_regularity(slices: DataFrame, by: Sequence[str], position: str, least: int = 3) -> DataFrame:
    """by, n_gaps, median, std, min, max of the gaps between neighbouring slices (4 digits), and irregular: a deviation of more
    than a hundredth of the median and of 0.01 mm. NULL below three slices."""
    gap = F.abs(F.col(position) - F.lag(position).over(Window.partitionBy(*by).orderBy(position)))
    rows = slices.withColumn("_g", gap).groupBy(*by).agg(F.count("*").alias("n_slices"), F.count("_g").alias("n_gaps"), F.median("_g").alias("m"), F.stddev_pop("_g").alias("s"), F.min("_g").alias("lo"), F.max("_g").alias("hi"))
    known = F.col("n_slices") >= least
    out = {name: F.when(known, F.round(F.col(c), 4)) for name, c in (("median_gap", "m"), ("std_gap", "s"), ("min_gap", "lo"), ("max_gap", "hi"))}
    irregular = F.when(known, F.col("s") > F.greatest(F.col("m") * 0.01, F.lit(0.01)))
    return rows.select(*by, "n_slices", *[c.alias(n) for n, c in out.items()], irregular.alias("irregular"))


def warnings(series: DataFrame) -> Column:
    """Texts on what makes a series doubtful: irregular gaps, fewer than four voxels along an axis, PET that is not SUV, another
    modality, a tilted gantry. series: irregular, size (array), modality, units, tilt_deg."""
    return F.array_compact(
        F.array(
            F.when(F.col("irregular"), "irregular slice spacing"),
            F.when(F.array_min("size") < 4, "fewer than 4 voxels along an axis"),
            F.when((F.col("modality") == "PT") & (F.coalesce(F.col("units"), F.lit("")) != "SUV"), "PET values are not SUV"),
            F.when(~F.coalesce(F.col("modality"), F.lit("")).isin("CT", "CBCT", "MR", "PT", "NM", "US"), "unsupported modality"),
            F.when(F.abs("tilt_deg") > 0.5, "tilted gantry"),
        )
    )


def stored(df: DataFrame, by: Sequence[str], value: str = "v", levels: int = 32_000) -> DataFrame:
    """df with slope, intercept and stored, the whole number 0..levels that stands for value: v is slope * stored + intercept.
    A constant volume has slope 1 and is stored as 0. Halves go to the even number."""
    stats = df.groupBy(*by).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    rows = df.join(stats, list(by))
    slope = F.when(F.col("_high") > F.col("_low"), (F.col("_high") - F.col("_low")) / levels).otherwise(1.0)
    rows = rows.withColumn("slope", slope).withColumn("intercept", F.col("_low"))
    whole = F.least(F.lit(levels), F.greatest(F.lit(0), F.rint((F.col(value) - F.col("intercept")) / F.col("slope")).cast("int")))
    return rows.withColumn("stored", whole).drop("_low", "_high")


def numbers(text: Column) -> Column:
    """The numbers of a text that backslashes part; one that is none is NULL."""
    return F.transform(F.split(text, r"\\"), lambda x: F.trim(x).try_cast("double"))


def ordered_slices(headers: DataFrame, by: Sequence[str] = ("series_uid",)) -> DataFrame:
    """headers with place (mm along the slice normal), z (its number from 0 in this order, then by path), p, o and s (position,
    orientation and pixel spacing as numbers). headers: by, path, position, orientation, pixel_spacing. The normal is the cross
    product of the image's axes, so the order does not depend on names or on how a series is spread over folders."""
    rows = headers.withColumns({"p": numbers(F.col("position")), "o": numbers(F.col("orientation")), "s": numbers(F.col("pixel_spacing"))})
    o = lambda i: F.get("o", F.lit(i))
    normal = [o(1) * o(5) - o(2) * o(4), o(2) * o(3) - o(0) * o(5), o(0) * o(4) - o(1) * o(3)]
    rows = rows.withColumn("normal", F.array(*normal))
    place = sum((F.get("normal", F.lit(i)) * F.get("p", F.lit(i)) for i in (1, 2)), F.get("normal", F.lit(0)) * F.get("p", F.lit(0)))
    rows = rows.withColumn("place", place)
    return rows.withColumn("z", F.row_number().over(Window.partitionBy(*by).orderBy("place", "path")) - 1)


def series_geometry(slices: DataFrame, by: Sequence[str] = ("series_uid",), least_gap: float = 1e-3) -> DataFrame:
    """by, n_slices, grid and problems of each series, from ordered slices (with rows and columns). The step along z is the mean gap.
    problems says why a series is no volume: a slice without position, orientation or size, slices of several sizes, spacings or
    orientations, several slices at one place, fewer than two slices. Its grid is NULL then."""
    gap = F.col("place") - F.lag("place").over(Window.partitionBy(*by).orderBy("place", "path"))
    size = F.struct(F.col("rows").try_cast("int").alias("rows"), F.col("columns").try_cast("int").alias("columns"))
    whole = F.forall(F.concat("p", "o", "s"), lambda x: x.isNotNull()) & (F.size("p") == 3) & (F.size("o") == 6) & (F.size("s") == 2) & size["rows"].isNotNull() & size["columns"].isNotNull()
    kind = F.struct(size.alias("size"), F.transform("o", lambda x: F.round(x, 4)).alias("o"), F.transform("s", lambda x: F.round(x, 4)).alias("s"))
    rows = slices.withColumns({"_gap": gap, "_whole": F.coalesce(whole, F.lit(False)), "_kind": kind, "_size": size})
    first = lambda c: F.min_by(c, F.struct("place", "path"))
    found = rows.groupBy(*by).agg(F.count("*").alias("n_slices"), F.bool_and("_whole").alias("_whole"), F.min("_kind").alias("_k0"), F.max("_kind").alias("_k1"), F.min("_gap").alias("_least"), F.avg("_gap").alias("_step"), first("p").alias("_p"), first("o").alias("_o"), first("s").alias("_s"), first("normal").alias("_n"), first("_size").alias("_z"))
    one = F.col("_k0") == F.col("_k1")
    problems = F.array_compact(F.array(F.when(~F.col("_whole"), "a slice without position, orientation or size"), F.when(F.col("_whole") & ~one, "slices of several sizes, spacings or orientations"), F.when(F.col("_whole") & one & (F.col("_least") < least_gap), "several slices at one place"), F.when(F.col("n_slices") < 2, "fewer than two slices")))
    at = lambda c, i: F.get(c, F.lit(i))
    direction = F.array(*[c for r in range(3) for c in (at("_o", r), at("_o", 3 + r), at("_n", r))])
    grid = F.struct(F.array(F.col("_z.columns"), F.col("_z.rows"), F.col("n_slices").cast("int")).alias("size"), F.array(at("_s", 1), at("_s", 0), F.col("_step")).alias("spacing"), F.col("_p").alias("origin"), direction.alias("direction"))
    return found.withColumn("problems", problems).select(*by, "n_slices", F.when(F.size("problems") == 0, grid).alias("grid"), "problems")


def assembled(files: DataFrame, headers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(geometry: series_uid, n_slices, grid, problems; voxels: series_uid, z, y, x, v) of all series among files (path, content) whose
    headers are given. Series with problems have no voxels. A slice is decoded by one task, so large series are many tasks."""
    bound_batches(files.sparkSession)
    slices = ordered_slices(headers)
    geometry = series_geometry(slices)
    fine = geometry.where(F.col("grid").isNotNull()).select("series_uid")
    wanted = slices.join(fine, "series_uid").select("path", "series_uid", F.col("z").cast("int").alias("z"))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid, z, content = (batch.column(c).to_pylist() for c in ("series_uid", "z", "content"))
            for u, k, c in zip(uid, z, content, strict=True):
                values, _ = dicom_slices(c)
                y, x = (pa.array(i.ravel()) for i in np.indices(values.shape, dtype=np.int32))
                same = pa.array(np.zeros(values.size, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([u]).take(same), pa.array(np.full(values.size, k, np.int32)), y, x, pa.array(values.ravel().astype(np.float64))], names=["series_uid", "z", "y", "x", "v"])

    rows = files.join(wanted, "path").select("series_uid", "z", "content")
    return geometry, rows.mapInArrow(decoded, "series_uid string, z int, y int, x int, v double")


def read_series(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Geometry and voxels of all DICOM series under a path, one volume a UID however many folders it is spread over."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    return assembled(files, dicom_headers(spark, path))
