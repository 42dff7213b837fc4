"""A batch of pairs in one plan: prepare, crop, start, fit, move, measure and judge, for all cases at once, each on its own grids."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import intensity, statistics
from ..functions.names import PROFILES
from ..model import INDEX, Grid, GridColumn, Grids, grids_of
from ..operators import bricks, candidates, gates, geometry, neighbourhood, optimise, overlap, regions, resample
from ..operators.transforms import decomposed, rotation
from ..shared import written
from .presets import Plan, adapted, as_json, metric_of

BY = ["case_id"]


@dataclass(frozen=True)
class Result:
    """Tables by case: fitted transforms, starts with their scores, moved volumes, moved labels (or None), displacement fields in mm
    before the matrix (or None), what was cropped (or None), figures, checks and verdicts; and the plan as it was run, as JSON."""

    transforms: DataFrame
    starts: DataFrame
    moved: DataFrame
    labels: DataFrame | None
    fields: DataFrame | None
    regions: DataFrame | None
    metrics: DataFrame
    checks: DataFrame
    verdicts: DataFrame
    settings: str


def _array(cells: Sequence[Column | float]) -> Column:
    return F.array(*[(c if isinstance(c, Column) else F.lit(float(c))).cast("double") for c in cells])


def _moved_by(d: Sequence[Column]) -> Column:
    """The matrix of a translation."""
    return _array([1, 0, 0, d[0], 0, 1, 0, d[1], 0, 0, 1, d[2], 0, 0, 0, 1])


def _turned(matrix: Column, turn: np.ndarray, centre: Sequence[Column]) -> Column:
    """matrix after a rotation about a centre: first the rotation, then the matrix."""
    m = lambda r, c: F.get(matrix, F.lit(4 * r + c))
    gap = [centre[r] - sum((float(turn[r, k]) * centre[k] for k in (1, 2)), float(turn[r, 0]) * centre[0]) for r in range(3)]
    cells = []
    for r in range(4):
        cells += [sum((m(r, k) * float(turn[k, c]) for k in (1, 2)), m(r, 0) * float(turn[0, c])) for c in range(3)]
        cells.append(sum((m(r, k) * gap[k] for k in range(3)), m(r, 3)))
    return _array(cells)


def _organ_axes(fixed: DataFrame, moving: DataFrame, fixed_grids: Grids, moving_grids: Grids, targets: Sequence[str]) -> DataFrame:
    """case_id, matrix: the principal axes of an organ on those of the same one: of the first target that both sides have, of the
    first organ by name without targets."""
    place = F.array_position(F.array(*map(F.lit, targets)), F.col("organ")) if targets else F.col("organ")
    both = fixed.select(*BY, "organ").distinct().join(moving.select(*BY, "organ").distinct(), [*BY, "organ"]).withColumn("place", place)
    both = both.where("place > 0") if targets else both
    chosen = both.groupBy(*BY).agg(F.min_by("organ", "place").alias("organ"))
    sides = []
    for name, organs, grids in (("f", fixed, fixed_grids), ("m", moving, moving_grids)):
        mask = organs.join(chosen, [*BY, "organ"]).select(*BY, *INDEX).distinct()
        rows = geometry.principal_axes(mask, BY, grids).where("n > 1")
        sides.append(rows.select(*BY, F.array("cx", "cy", "cz").alias(f"{name}c"), F.col("axes").alias(f"{name}a"), F.col("lengths").alias(f"{name}l")))

    def matrices(fc: pd.Series, fa: pd.Series, fl: pd.Series, mc: pd.Series, ma: pd.Series, ml: pd.Series) -> pd.Series:
        square = lambda v: np.array(v, float).reshape(3, 3)
        return pd.Series([candidates.axes_start(a, square(b), c, d, square(e), f).ravel().tolist() for a, b, c, d, e, f in zip(fc, fa, fl, mc, ma, ml, strict=True)])

    made = F.pandas_udf(matrices, "array<double>")
    return sides[0].join(sides[1], BY).select(*BY, made("fc", "fa", "fl", "mc", "ma", "ml").alias("matrix"))


def _masked_only(volume: DataFrame, mask: DataFrame | None) -> DataFrame:
    """The voxels of the mask, of cases that have one; all voxels of the others."""
    if mask is None:
        return volume
    inside = volume.join(mask, [*BY, *INDEX], "left_semi")
    return inside.unionByName(volume.join(mask.select(*BY).distinct(), BY, "left_anti"))


def _starts(plan: Plan, fixed: DataFrame, moving: DataFrame, fixed_grids: Grids, moving_grids: Grids, labels: tuple[DataFrame, DataFrame, Grids, Grids] | None, masks: tuple[DataFrame | None, DataFrame | None]) -> DataFrame:
    """case_id, ordinal, name, matrix for every mode that a case has figures for; by geometry where it has none for any of them."""
    grids = fixed_grids.table.select(*BY, F.col("grid").alias("fg")).join(moving_grids.table.select(*BY, F.col("grid").alias("mg")), BY)
    centres = {f"{s}{c}": v for s in ("f", "m") for c, v in zip("xyz", GridColumn(F.col(f"{s}g")).centre, strict=True)}
    grids = written(grids.join(fixed.select(*BY).distinct(), BY).select(*BY, *[v.alias(n) for n, v in centres.items()]), "grids")
    by_geometry = grids.select(*BY, _moved_by([F.col(f"m{c}") - F.col(f"f{c}") for c in "xyz"]).alias("matrix"))
    offset = lambda rows: rows.select(*BY, _moved_by([F.col(f"m{c}") - F.col(c) for c in ("cx", "cy", "cz")]).alias("matrix"))
    renamed = lambda df: df.withColumnsRenamed({c: f"m{c}" for c in ("cx", "cy", "cz")})
    found = []
    for k, mode in enumerate(plan.init):
        rows = None
        if mode == "identity":
            rows = grids.select(*BY, _moved_by([F.lit(0.0)] * 3).alias("matrix"))
        elif mode == "moments":
            a, b = (geometry.centre_of_mass(_masked_only(v.select(*BY, *INDEX, "v"), w), BY, g) for v, w, g in ((fixed, masks[0], fixed_grids), (moving, masks[1], moving_grids)))
            rows = offset(a.join(renamed(b), BY))
        elif mode == "geometry":
            rows = by_geometry
        elif labels is not None and mode == "organ_moments":
            rows = _organ_axes(*labels, plan.targets)
        elif labels is not None and mode == "organ_centroid":
            sides = []
            for organs, g in zip(labels[:2], labels[2:], strict=True):
                organs = organs.where(F.col("organ").isin(*plan.targets)) if plan.targets else organs
                mean = organs.groupBy(*BY, "organ").agg(*[F.avg(c).alias(c) for c in INDEX])
                sides.append(geometry.placed(mean, g, ("cx", "cy", "cz")).select(*BY, "organ", "cx", "cy", "cz"))
            rows = candidates.organ_centroid_start(*sides).select(*BY, _moved_by([F.col(c) for c in ("dx", "dy", "dz")]).alias("matrix"))
        if rows is not None:
            found.append(rows.select(*BY, F.lit(k).alias("ordinal"), F.lit(mode).alias("name"), "matrix"))
    out = found[0] if found else by_geometry.limit(0).select(*BY, F.lit(0).alias("ordinal"), F.lit("").alias("name"), "matrix")
    for more in found[1:]:
        out = out.unionByName(more)
    out = written(out, "starts")
    bare = by_geometry.join(out.select(*BY).distinct(), BY, "left_anti")
    out = out.unionByName(bare.select(*BY, F.lit(0).alias("ordinal"), F.lit("geometry").alias("name"), "matrix"))
    turns = [rotation(r) for r in plan.rotations_deg]
    names = ["" if not any(r) else f"+rot({','.join(str(int(a)) for a in r)})" for r in plan.rotations_deg]
    if plan.flip_check:  # every start once more, half a turn about z further
        turns += [t @ rotation((0.0, 0.0, 180.0)) for t in turns]
        names += [f"{n}+flip180z" for n in names]
    out = out.join(grids.select(*BY, "fx", "fy", "fz"), BY)
    each = F.array(*[F.struct(F.lit(k).alias("turn"), F.lit(n).alias("how"), _turned(F.col("matrix"), t, [F.col(f"f{c}") for c in "xyz"]).alias("matrix")) for k, (n, t) in enumerate(zip(names, turns, strict=True))])
    out = out.select(*BY, "ordinal", "name", F.inline(each))
    return out.select(*BY, (F.col("ordinal") * len(turns) + F.col("turn")).cast("int").alias("ordinal"), F.concat("name", "how").alias("name"), "matrix")


def _mask(work: DataFrame, organs: DataFrame | None, work_grids: Grids, full_grids: Grids, modality: str, plan: Plan) -> DataFrame:
    """case_id, z, y, x of the working grid: around the targets, or the organs of a case without any; the body of a case without
    organs; no row where the mask is too small to be used."""
    none = work.limit(0).select(*BY, *INDEX, F.lit("").alias("organ"))
    if organs is None:
        small = regions.combined_mask(none, BY, work_grids, voxels=work, modality=modality)
    else:
        mask = regions.combined_mask(organs, BY, full_grids, plan.targets, plan.mask_dilate_mm)
        cases = mask.select(*BY).distinct()
        small = resample.resampled(mask.withColumn("mask", F.lit(1)), cases, BY, work_grids, full_grids, None, "nearest", 0, "mask").where("mask = 1").select(*BY, *INDEX)
        bare = work.join(organs.select(*BY).distinct(), BY, "left_anti")
        small = small.unionByName(regions.combined_mask(none, BY, work_grids, voxels=bare, modality=modality))
    return written(regions.working_mask(small, BY), "mask")


def _with_mask(work: DataFrame, mask: DataFrame) -> DataFrame:
    """work with a column mask, true everywhere for a case without one."""
    out = work.join(mask.withColumn("mask", F.lit(True)), [*BY, *INDEX], "left")
    out = out.join(mask.select(*BY).distinct().withColumn("_any", F.lit(True)), BY, "left")
    return out.withColumn("mask", F.coalesce("mask", F.col("_any").isNull())).drop("_any")


def landmark_errors(landmarks: DataFrame, fitted: DataFrame, field: DataFrame | None, grids: Grids) -> DataFrame:
    """case_id and the errors of landmarks in mm. landmarks: case_id, idx, fx, fy, fz (fixed), mx, my, mz (moving). A fixed point goes
    through the field, if there is one, and then through the matrix; beyond the field's grid nothing bends."""
    rows = landmarks.select(*BY, "idx", *[F.col(f"f{c}").alias(f"p{c}") for c in "xyz"], *[F.col(f"m{c}").alias(f"t{c}") for c in "xyz"])
    at = ["px", "py", "pz"]
    if field is not None:
        rows = resample.field_at(rows, field, BY, grids)
        rows = rows.withColumns({f"q{c}": F.coalesce(F.col(f"m{c}"), F.col(f"p{c}")) for c in "xyz"}).drop("mx", "my", "mz")
        at = ["qx", "qy", "qz"]
    rows = rows.join(fitted.select(*BY, "matrix"), BY)
    rows = rows.withColumns(dict(zip(("ax", "ay", "az"), resample.applied(F.col("matrix"), *map(F.col, at)), strict=True)))
    out = statistics.registration_error(rows, BY, ("ax", "ay", "az"), ("tx", "ty", "tz"), ("px", "py", "pz"))
    return out.select(*BY, F.col("n").alias("n_landmarks"), F.col("mean").alias("tre_mm"), F.col("median").alias("tre_median_mm"), F.col("p95").alias("tre_p95_mm"), F.col("max").alias("tre_max_mm"), F.col("mean_before").alias("tre_before_mm"))


def target_profile(targets: Sequence[str]) -> tuple[bool, float]:
    """Whether any of the targets may deform, and their finest control grid in mm; organs without a profile may, at 20 mm."""
    found = [PROFILES[t] for t in targets if t in PROFILES]
    known = [(p.deformable, float(p.bspline_grid_mm)) for p in found] + [(True, 20.0)] * (len(targets) - len(found))
    return any(d for d, _ in known), min((g for _, g in known), default=20.0)


def resolved(plan: Plan, linear_only: bool = False) -> Plan:
    """The plan as it is run: stages adapted to the targets, deformable ones left out if only linear ones are asked for."""
    from dataclasses import replace

    stages = plan.stages
    if plan.targets:
        stages = tuple(adapted(s, *target_profile(plan.targets)) for s in stages)
    if linear_only:
        stages = tuple(s for s in stages if s.kind in optimise.LENGTHS)
    return replace(plan, stages=stages)


def run_batch(fixed: DataFrame, moving: DataFrame, fixed_grid: Grid | Grids, moving_grid: Grid | Grids, plan: Plan, fixed_labels: DataFrame | None = None, moving_labels: DataFrame | None = None, coarse_mm: float = 6.0, linear_only: bool = False, landmarks: DataFrame | None = None) -> Result:
    """fixed and moving: case_id, z, y, x, v; labels: case_id, z, y, x, organ; landmarks: case_id, idx, fx, fy, fz, mx, my, mz. Each
    case may have grids of its own.

    Moved volumes keep the moving side's own values: preparation only serves the fit; what lies outside of the moving grid takes the
    moving volume's least value. A plan with ``roi_crop`` fits each side within the box around its own targets; positions stay as
    they are, so the transform holds for the whole volumes, which are moved and measured. Stages have their own metric, iterations,
    samples and levels; a plan with targets fits within the mask around them. A deformable stage bends the fixed grid before the
    linear transform. Required features are refused; other plans fall back to the metrics of intensities.
    """
    if plan.features is True:
        raise ValueError("the batch run does not execute features of a plan")
    plan = resolved(plan, linear_only)
    full_f, full_m = grids_of(fixed, BY, fixed_grid), grids_of(moving, BY, moving_grid)
    labels = (fixed_labels.select(*BY, *INDEX, "organ"), moving_labels.select(*BY, *INDEX, "organ")) if fixed_labels is not None and moving_labels is not None else None
    prep = lambda df, p, m, g: intensity.prepared(df.select(*BY, *INDEX, "v"), BY, modality=m, clip=p.clip, window=p.window, percentiles=p.percentiles, smooth_mm=p.smooth_mm, grid=g, normalize=p.normalize)
    f, m = prep(fixed, plan.fixed, plan.fixed_modality, full_f), prep(moving, plan.moving, plan.moving_modality, full_m)
    bare = [fixed.select(*BY, *INDEX, "v"), moving.select(*BY, *INDEX, "v")]
    f_grids, m_grids, cropped = full_f, full_m, None
    cut_labels = labels
    if plan.roi_crop:
        none = fixed.limit(0).select(*BY, *INDEX, F.lit("").alias("organ"))
        cropped = written(regions.roi_plan(fixed, *(labels or (none, none)), BY, full_f, full_m, plan.targets, plan.roi_margin_mm), "regions")
        boxes = [cropped.select(*BY, *[F.col(f"{s}_{c}_{e}").alias(f"{c}_{e}") for c in INDEX for e in ("low", "high")]) for s in ("fixed", "moving")]
        f, m = (geometry.cropped(v, b, BY) for v, b in zip((f, m), boxes, strict=True))
        bare = [geometry.cropped(v, b, BY) for v, b in zip(bare, boxes, strict=True)]
        f_grids, m_grids = (Grids(written(g.cropped(b).table, "grids"), g.by) for g, b in zip((full_f, full_m), boxes, strict=True))
        cut_labels = tuple(geometry.cropped(v, b, BY) for v, b in zip(labels, boxes, strict=True)) if labels else None
    space = (plan.spacing_mm,) * 3
    f_work, f_space = resample.to_spacing(f, BY, f_grids, space)
    m_work, m_space = resample.to_spacing(m, BY, m_grids, space)
    f_work, m_work = written(f_work, "fixed"), written(m_work, "moving")
    masks: list[DataFrame | None] = [None, None]
    if plan.targets:
        # The body is told from air by values that are not prepared.
        for k, (values, organs, full, small, modality) in enumerate(((bare[0], fixed_labels, f_grids, f_space, plan.fixed_modality), (bare[1], moving_labels, m_grids, m_space, plan.moving_modality))):
            if k == 0 or "moments" in plan.init:
                organs = None if organs is None else (cut_labels[k] if cut_labels is not None else organs)
                masks[k] = _mask(resample.to_spacing(values, BY, full, space)[0], organs, small, full, modality, plan)
    start = written(_starts(plan, f_work, m_work, f_space, m_space, (*labels, full_f, full_m) if labels else None, tuple(masks)), "candidates")
    if len(plan.init) * len(plan.rotations_deg) > 1 or plan.flip_check:
        f_coarse, grid = resample.to_spacing(f_work, BY, f_space, (coarse_mm,) * 3)
        start = written(candidates.ranked(candidates.scored(start, f_coarse, m_work, grid, m_space)), "ranked")
        best = start.where(F.col("rank") == 1)
    else:
        best = start
    linear = [s for s in plan.stages if s.kind in optimise.LENGTHS]
    metrics = tuple("mi" if metric_of(s, plan) == "mi" else "ncc" for s in linear)
    target = f_work if masks[0] is None else _with_mask(f_work, masks[0])
    fitted = optimise.fitted(target, m_work, best, f_space, m_space, tuple(s.kind for s in linear), metrics, tuple(s.max_iterations for s in linear), tuple(s.n_samples for s in linear), tuple(s.n_resolutions for s in linear))
    fitted = written(fitted, "transforms")
    bent = [s for s in plan.stages if s.kind not in optimise.LENGTHS]
    field = None
    if bent:
        # Where the moving side is not known the fixed one stands for it, so that nothing pulls there.
        near = bricks.resampled(m_work, fitted, BY, f_space, m_space, "matrix").join(f_work.select(*BY, *INDEX, F.col("v").alias("_fixed")), [*BY, *INDEX])
        near = near.select(*BY, *INDEX, F.coalesce("v", "_fixed").alias("v"))
        # A control grid of some mm is a smoothing of as many voxels, and stiffer the heavier bending weighs.
        sigma = max(1.0, bent[-1].grid_mm / plan.spacing_mm / 8 * min(2.0, max(1.0, bent[-1].bending_weight) ** 0.5))
        small = optimise.deformed(f_work, near, f_space, min(bent[-1].max_iterations, 40), sigma)
        field = written(resample.regridded(written(small, "small"), fitted, BY, full_f, f_space), "field")

    def carried(volume: DataFrame, by: list[str], cases: DataFrame, how: str, value: str) -> DataFrame:
        if field is None:
            return resample.resampled(volume, cases, by, full_f, full_m, "matrix", how, None if how == "linear" else 0, value)
        bending = field.join(cases.select(*by), BY)
        out = resample.through_field(volume, bending, by, full_f, full_m, cases, "matrix", how, value)
        if how != "linear":
            return out.withColumn(value, F.coalesce(F.col(value), F.lit(0.0)).cast("int"))
        least = volume.groupBy(*by).agg(F.min(value).alias("_least"))
        return out.join(least, by, "left").withColumn(value, F.coalesce(value, "_least")).drop("_least")

    moved = written(carried(moving.select(*BY, *INDEX, "v"), BY, fitted.select(*BY, "matrix"), "linear", "v"), "moved")
    identity = fitted.select(*BY, F.array(*[F.lit(float(v)) for v in np.eye(4).ravel()]).alias("matrix"))
    before = resample.resampled(moving, identity, BY, full_f, full_m, "matrix", default=None).withColumnRenamed("v", "before")
    pairs = fixed.select(*BY, *INDEX, "v").join(before, [*BY, *INDEX]).join(moved.withColumnRenamed("v", "after"), [*BY, *INDEX])
    figures = statistics.similarity_report(pairs, BY, "v", "before", "after").join(fitted.select("case_id", F.col("score").alias("final_metric"), F.transform("stages", lambda s: F.struct(s["stage"].alias("stage"), s["final_metric"].alias("final_metric"))).alias("stages"), "matrix"), BY)
    figures = figures.withColumns(linear_figures("matrix")).drop("matrix")
    if field is not None:
        figures = _bent_figures(figures, field, full_f)
    carried_labels = None
    dice = F.create_map().cast("map<string,double>")
    if labels:
        organs = labels[1]
        # One label volume an organ: nearest neighbours never mix names.
        wanted = fitted.select("case_id", "matrix").join(organs.select("case_id", "organ").distinct(), "case_id")
        carried_labels = carried_organs = written(carried(organs.withColumn("label", F.lit(1)), ["case_id", "organ"], wanted, "nearest", "label").where("label <> 0"), "labels")
        shared = overlap.overlap(fixed_labels, carried_organs, BY)
        if plan.qc_labels:
            shared = shared.where(F.col("organ").isin(*plan.qc_labels))
        figures = figures.join(shared.groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct("organ", "dice"))).alias("dice")), BY, "left")
        dice = F.coalesce("dice", dice)
    figures = figures.withColumn("dice", dice).withColumn("deformable", F.lit(field is not None))
    if landmarks is not None:
        figures = figures.join(landmark_errors(landmarks, fitted, field, full_f), BY, "left")
    else:
        figures = figures.withColumn("tre_mm", F.lit(None).cast("double"))
    figures = written(figures, "metrics")
    checks = gates.checks(figures, plan.gates, BY)
    return Result(fitted, start, moved, carried_labels, field, cropped, figures, checks, gates.verdicts(checks, BY), as_json(plan))


def _bent_figures(figures: DataFrame, field: DataFrame, grids: Grids) -> DataFrame:
    """figures with the determinants of the field followed by the matrix, which are the field's times the matrix's."""
    det = statistics.jacobian_statistics(neighbourhood.jacobian(field, BY, grids), BY)
    rows = figures.drop("det_min", "det_max", "folding_fraction").join(det.select(*BY, F.col("det_min").alias("_low"), F.col("det_max").alias("_high"), "folding_fraction"), BY, "left")
    ends = [F.col("_low") * F.col("determinant"), F.col("_high") * F.col("determinant")]
    length = statistics.displacement_statistics(field, BY).withColumnsRenamed({c: f"bending_{c}" for c in ("mean_mm", "p95_mm", "max_mm")})
    return rows.withColumns({"det_min": F.least(*ends), "det_max": F.greatest(*ends)}).drop("_low", "_high").join(length, BY, "left")


def linear_figures(matrix: str) -> dict:
    """Figures of a linear transform, whose Jacobian determinant is the same everywhere."""

    def figures(matrices: pd.Series) -> pd.DataFrame:
        out = [decomposed(np.array(m, float).reshape(4, 4)) for m in matrices]
        return pd.DataFrame({"translation_mm": [float(np.linalg.norm(d["translation_mm"])) for d in out], "scale_deviation": [float(np.abs(np.array(d["scale"]) - 1).max()) for d in out], "determinant": [d["determinant"] for d in out]})

    x = F.pandas_udf(figures, "translation_mm double, scale_deviation double, determinant double")(F.col(matrix))
    det = x["determinant"]
    return {"translation_mm": x["translation_mm"], "scale_deviation": x["scale_deviation"], "determinant": det, "det_min": det, "det_max": det, "folding_fraction": F.when(det <= 0, 1.0).otherwise(0.0)}
