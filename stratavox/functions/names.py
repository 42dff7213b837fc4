"""Organ names, profiles and groups, modalities, pseudonyms and log figures."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Other spellings of organ names.
ALIASES = {
    "left_kidney": "kidney_left",
    "right_kidney": "kidney_right",
    "left_lung": "lung_left",
    "right_lung": "lung_right",
    "left_head_of_femur": "femur_left",
    "right_head_of_femur": "femur_right",
    "gall_bladder": "gallbladder",
    "postcava": "inferior_vena_cava",
    "intestine": "small_bowel",
    "bladder": "urinary_bladder",
    "lung_upper_lobe_left": "lung_left",
    "lung_lower_lobe_left": "lung_left",
    "lung_upper_lobe_right": "lung_right",
    "lung_middle_lobe_right": "lung_right",
    "lung_lower_lobe_right": "lung_right",
}
# File endings that are no part of a name, longest first.
ENDINGS = (".nii.gz", ".nii", ".nrrd", ".mha")
# Groups of organs that stand for their members, in order.
GROUPS = {
    "abdomen": ("liver", "spleen", "pancreas", "kidney_left", "kidney_right", "stomach", "gallbladder"),
    "abdomen_solid": ("liver", "spleen", "kidney_left", "kidney_right"),
    "thorax": ("lung_left", "lung_right", "heart", "esophagus"),
    "pelvis": ("prostate", "urinary_bladder", "rectum", "femur_left", "femur_right"),
    "vessels": ("aorta", "inferior_vena_cava", "portal_vein_and_splenic_vein", "celiac_trunk"),
    "bones": ("femur_left", "femur_right", "hip_left", "hip_right", "sacrum"),
    "liver_region": ("liver", "portal_vein_and_splenic_vein", "hepatic_vessel", "gallbladder"),
}
# Modalities that measure alike.
FAMILIES = {"CT": "CT", "CBCT": "CT", "MR": "MR", "PT": "PT", "NM": "PT", "US": "US"}


@dataclass(frozen=True)
class Profile:
    """Settings for an organ; the defaults are those of one that is not listed."""

    name: str
    region: str = "unknown"
    deformable: bool = True
    bspline_grid_mm: float = 20.0
    hu_window: str | None = None
    mask_dilate_mm: float = 8.0
    roi_margin_mm: float = 25.0
    typical_motion_mm: float = 10.0


# Name, region, deformable, grid, window, mask margin, crop margin, motion (mm).
PROFILES = {
    p.name: p
    for p in (
        Profile("liver", "abdomen", True, 20.0, "ct_liver", 8.0, 25.0, 20.0),
        Profile("spleen", "abdomen", True, 20.0, "ct_abdomen", 8.0, 25.0, 15.0),
        Profile("pancreas", "abdomen", True, 15.0, "ct_abdomen", 10.0, 25.0, 15.0),
        Profile("kidney_left", "abdomen", True, 20.0, "ct_abdomen", 8.0, 25.0, 10.0),
        Profile("kidney_right", "abdomen", True, 20.0, "ct_abdomen", 8.0, 25.0, 10.0),
        Profile("stomach", "abdomen", True, 15.0, "ct_abdomen", 8.0, 25.0, 25.0),
        Profile("duodenum", "abdomen", True, 12.0, "ct_abdomen", 8.0, 25.0, 20.0),
        Profile("gallbladder", "abdomen", True, 15.0, "ct_abdomen", 8.0, 25.0, 10.0),
        Profile("esophagus", "thorax", True, 12.0, "ct_mediastinum", 8.0, 25.0, 10.0),
        Profile("colon", "abdomen", True, 15.0, "ct_abdomen", 8.0, 25.0, 25.0),
        Profile("small_bowel", "abdomen", True, 12.0, "ct_abdomen", 8.0, 25.0, 30.0),
        Profile("adrenal_gland_left", "abdomen", True, 12.0, None, 12.0, 30.0, 10.0),
        Profile("adrenal_gland_right", "abdomen", True, 12.0, None, 12.0, 30.0, 10.0),
        Profile("aorta", "abdomen", False, 20.0, "ct_soft", 8.0, 25.0, 5.0),
        Profile("inferior_vena_cava", "abdomen", False, 20.0, "ct_soft", 8.0, 25.0, 10.0),
        Profile("portal_vein_and_splenic_vein", "abdomen", True, 12.0, "ct_liver", 8.0, 25.0, 10.0),
        Profile("hepatic_vessel", "abdomen", True, 10.0, "ct_liver", 8.0, 25.0, 10.0),
        Profile("celiac_trunk", "abdomen", False, 20.0, "ct_soft", 8.0, 25.0, 10.0),
        Profile("lung_left", "thorax", True, 15.0, "ct_lung", 8.0, 25.0, 25.0),
        Profile("lung_right", "thorax", True, 15.0, "ct_lung", 8.0, 25.0, 25.0),
        Profile("heart", "thorax", True, 15.0, "ct_mediastinum", 8.0, 25.0, 15.0),
        Profile("prostate", "pelvis", True, 12.0, "ct_soft", 10.0, 30.0, 8.0),
        Profile("urinary_bladder", "pelvis", True, 15.0, "ct_soft", 8.0, 25.0, 15.0),
        Profile("rectum", "pelvis", True, 12.0, "ct_soft", 8.0, 25.0, 15.0),
        Profile("femur_left", "musculoskeletal", False, 20.0, "ct_bone", 8.0, 25.0, 0.0),
        Profile("femur_right", "musculoskeletal", False, 20.0, "ct_bone", 8.0, 25.0, 10.0),
        Profile("hip_left", "musculoskeletal", False, 20.0, "ct_bone", 8.0, 25.0, 10.0),
        Profile("hip_right", "musculoskeletal", False, 20.0, "ct_bone", 8.0, 25.0, 10.0),
        Profile("sacrum", "pelvis", False, 20.0, "ct_bone", 8.0, 25.0, 10.0),
        Profile("brain", "head", False, 20.0, "ct_brain", 8.0, 25.0, 0.0),
    )
}
PROFILE_SCHEMA = T.StructType([T.StructField(n, {"str": T.StringType(), "bool": T.BooleanType(), "float": T.DoubleType(), "str | None": T.StringType()}[f.type]) for n, f in Profile.__dataclass_fields__.items()])


def _literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def canonical(name: Column) -> Column:
    """Trimmed, lower case, without file endings, words joined by underscores, and by the usual name of the organ.

    Each ending is taken off at most once, in order, so that ``liver.nii.gz`` and ``liver.nii`` are both ``liver``.
    """
    key = F.lower(F.trim(name))
    key = reduce(lambda k, e: F.when(k.endswith(e), F.substr(k, F.lit(1), F.length(k) - len(e))).otherwise(k), ENDINGS, key)
    key = F.translate(key, " -", "__")
    return F.coalesce(F.try_element_at(_literal_map(ALIASES), key), key)


def expanded(targets: DataFrame, by: list[str], target: str = "target", position: str = "position") -> DataFrame:
    """by, organ, position: groups replaced by their members, each organ at its first place."""
    groups = F.create_map(*[x for g, m in GROUPS.items() for x in (F.lit(g), F.array(*map(F.lit, m)))])
    members = F.coalesce(F.try_element_at(groups, F.lower(F.trim(F.col(target)))), F.array(canonical(F.col(target))))
    rows = targets.select(*by, F.col(position).alias("_p"), F.posexplode(members).alias("_q", "organ"))
    first = rows.groupBy(*by, "organ").agg(F.min(F.struct("_p", "_q")).alias("_at"))
    return first.select(*by, "organ", (F.col("_at._p") * 100 + F.col("_at._q")).cast("long").alias("position"))


def profiles(spark: SparkSession) -> DataFrame:
    """The listed profiles: a dimension of fixed size."""
    return spark.createDataFrame([tuple(p.__dict__.values()) for p in PROFILES.values()], PROFILE_SCHEMA)


def with_profiles(df: DataFrame, organ: str = "organ") -> DataFrame:
    """df with the profile of each organ, a neutral one if it is not listed. The listed ones are a fixed few rows."""
    listed = F.broadcast(profiles(df.sparkSession).withColumnRenamed("name", "_name"))
    rows = df.join(listed, df[organ] == F.col("_name"), "left")
    known, neutral = F.col("_name").isNotNull(), Profile("")
    columns = [F.when(known, F.col(n)).otherwise(F.lit(getattr(neutral, n))).alias(n) for n in Profile.__dataclass_fields__ if n != "name"]
    return rows.select(*[df[c] for c in df.columns], *columns)


def merged_profiles(targets: DataFrame, by: list[str]) -> DataFrame:
    """One profile for several organs (rows of by, organ, position): deformable if any is, the finest grid, the widest margins,
    region and window of the first that has one."""
    rows = with_profiles(targets)
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("position")))
    name = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "organ"))), lambda x: x["organ"]), "+")
    return rows.groupBy(*by).agg(name.alias("name"), F.min_by("region", "position").alias("region"), F.bool_or("deformable").alias("deformable"), F.min("bspline_grid_mm").alias("bspline_grid_mm"), first("hu_window").alias("hu_window"), F.max("mask_dilate_mm").alias("mask_dilate_mm"), F.max("roi_margin_mm").alias("roi_margin_mm"), F.max("typical_motion_mm").alias("typical_motion_mm"))


def family(modality: Column) -> Column:
    key = F.upper(F.coalesce(modality, F.lit("")))
    return F.coalesce(F.try_element_at(_literal_map(FAMILIES), key), key)


def same_modality(fixed: Column, moving: Column) -> Column:
    return (family(fixed) != "") & (family(fixed) == family(moving))


def pseudonym(value: Column, salt: str) -> Column:
    """Ten hexadecimal digits of a salted SHA-256; "unknown" for null or empty. A salt is required: a known one is reversible."""
    if not salt:
        raise ValueError("a salt is required")
    return F.when(F.coalesce(value, F.lit("")) == "", "unknown").otherwise(F.substring(F.sha2(F.concat(F.lit(f"{salt}::"), value), 256), 1, 10))


def file_digest(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 32)


def first_text(*values: Column) -> Column:
    """The first value that is not empty, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(v), F.lit("")) for v in values])


def final_metric(log: Column) -> Column:
    """The last ``Final metric value = x`` of a log; NULL without."""
    found = F.regexp_extract_all(log, F.lit(r"(?i)final metric value\s*=\s*([-+]?[0-9.]+(?:e[-+]?[0-9]+)?)"), F.lit(1))
    return F.get(found, F.size(found) - 1).try_cast("double")


# What a log says, and what it means.
HINTS = (
    ("too many samples map outside", "fields of view hardly overlap: improve the starting point or lower the required ratio of valid samples"),
    ("could not compute", "the metric is undefined: check masks and intensity ranges"),
    ("not enough memory", "lower the resolution or crop to the region of interest"),
    ("no such file", "an input path does not exist"),
    ("inconsistent", "image dimensions or spacings do not fit together"),
)


def hint(log: Column) -> Column:
    out = F.lit(None).cast("string")
    for text, meaning in reversed(HINTS):
        out = F.when(F.lower(log).contains(text), meaning).otherwise(out)
    return out


# What an optimiser's log says, in lower case, and what it means. Of the first two only one is told.
OUTSIDE = ("map outside moving image buffer",)
SAMPLING = ("too many samples", "not enough samples")
COUNTS = ("input primary is required", "should equal 1 or equal")
PENALTY = ("not implemented for advancedtransformadapter",)
SINGULAR = ("singular", "error in metric")


def diagnosis(log: Column, n_images: Column | int, n_metrics: Column | int) -> Column:
    """All hints that a log gives, in order: samples outside or none within the mask, images that do not fit the metrics, a penalty
    with a start transform, a metric that became invalid. NULL for a NULL log."""
    number = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("string")
    counts = F.concat(number(n_images), F.lit(" images for "), number(n_metrics), F.lit(" metrics: one image or one for each metric is needed"))

    def hints(low: Column) -> Column:
        said = lambda texts: reduce(Column.__or__, [F.contains(low, F.lit(t)) for t in texts])
        samples = F.when(said(OUTSIDE), "fields of view hardly overlap: improve the start, widen the mask or ask for fewer valid samples").when(said(SAMPLING), "no samples within the mask: ask for fewer or widen it")
        return F.array_compact(F.array(samples, F.when(said(COUNTS), counts), F.when(said(PENALTY), "a penalty does not work with a start transform given as such: chain it by a file"), F.when(said(SINGULAR), "the metric became invalid: check for values that are not finite, masks and overlap")))

    # The log is made and put in lower case once, as the lambda's variable, and not for each of the texts.
    return F.when(log.isNotNull(), F.get(F.transform(F.array(F.lower(log)), hints), F.lit(0)))


def last_description(log: Column) -> Column:
    """The last ``Description: ...`` of a log, trimmed; NULL without."""
    found = F.regexp_extract_all(log, F.lit(r"(?i)description:\s*([^\r\n]*)"), F.lit(1))
    return F.nullif(F.trim(F.get(found, F.size(found) - 1)), F.lit(""))
