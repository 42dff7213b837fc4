"""Distance transforms, grids of cases, bricks and fields against numpy on small volumes."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratavox.functions import quantiles
from stratavox.model import Grid, GridColumn, Grids, grid_from, with_grid
from stratavox.operators import bricks, gates, geometry, morphology, neighbourhood, optimise, planes, resample, surface
from stratavox.operators import transforms as tf
from stratavox.plans import batch, cache, presets
from stratavox.shared import written
from stratavox.sources import phantom
from test_core import array, brute_ball, mask, voxels

BY = ["volume_id"]


def grids(spark, made, name="volume_id"):
    table = None
    for k, g in made.items():
        row = spark.range(1).select(F.lit(k).cast("long").alias(name), g.column().alias("grid"))
        table = row if table is None else table.unionByName(row)
    return Grids(table, (name,))


def test_envelope_is_the_least_of_all_parabolas():
    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 40):
        f = np.where(rng.random((50, n)) < 0.5, rng.integers(0, 60, (50, n)).astype(float), np.inf)
        i = np.arange(n)
        for w in (1.0, 0.25, 6.25):
            want = (f[:, None, :] + w * (i[:, None] - i[None, :]) ** 2).min(2)
            assert np.allclose(planes.envelope(f, w), want)


def test_distance_transform_against_brute_force(spark):
    rng = np.random.default_rng(1)
    grid = Grid((9, 7, 6), (1.0, 2.0, 2.5))
    m = rng.random((6, 7, 9)) < 0.05
    m[2] = False
    df = voxels(spark, m).where("v > 0").select(*BY, "z", "y", "x")
    p = np.argwhere(m) * (2.5, 2.0, 1.0)
    all_ = np.argwhere(np.ones_like(m)) * (2.5, 2.0, 1.0)
    want = ((all_[:, None] - p[None]) ** 2).sum(-1).min(1).reshape(m.shape)
    assert np.allclose(array(planes.squared_distances(df, BY, grid, planes.step_weights), m.shape, "d2"), want)
    some = voxels(spark, np.ones((6, 7, 9)), 1).where("(z + y + x) % 3 = 0").unionByName(voxels(spark, np.ones((2, 2, 2)), 2))
    rows = planes.squared_distances(df, BY, grid, planes.step_weights, wanted=some).collect()
    assert len(rows) == some.count() and all(r["d2"] == np.inf if r["volume_id"] == 2 else np.isclose(r["d2"], want[r["z"], r["y"], r["x"]]) for r in rows)
    assert planes.squared_distances(df.limit(0), BY, grid, planes.step_weights).collect() == []


@pytest.mark.parametrize("radius", [1.0, 4.0])
def test_balls_by_distance_transform(spark, radius):
    rng = np.random.default_rng(2)
    a, b = Grid((12, 10, 8), (1.0, 1.0, 2.0)), Grid((9, 11, 7), (2.0, 0.7, 1.3))
    m, n = rng.random((8, 10, 12)) < 0.02, rng.random((7, 11, 9)) < 0.02
    df = voxels(spark, m).unionByName(voxels(spark, n, 2)).where("v > 0").select(*BY, "z", "y", "x")
    full = voxels(spark, ~m).unionByName(voxels(spark, ~n, 2)).where("v > 0").select(*BY, "z", "y", "x")
    both = grids(spark, {1: a, 2: b})
    wide, thin = morphology.dilated(df, BY, radius, both), morphology.eroded(full, BY, radius, both)
    for k, v, g in ((1, m, a), (2, n, b)):
        assert (mask(wide.where(F.col("volume_id") == k), v.shape) == brute_ball(v, g, radius)).all()
        assert (mask(thin.where(F.col("volume_id") == k), v.shape) == brute_ball(~v, g, radius, True)).all()
    one = df.where("volume_id = 1")
    closed = brute_ball(brute_ball(m, a, radius), a, radius, True)
    assert (mask(morphology.closed(one, BY, radius, a), m.shape) == closed).all()


def test_surfaces_by_transform_equal_nearest_points(spark):
    rng = np.random.default_rng(3)
    grid = Grid((10, 9, 8), (1.5, 2.0, 2.5), (3.0, 4.0, 5.0))
    a, b = (np.where(np.add.outer(np.add.outer((np.arange(8) - z) ** 2, (np.arange(9) - 4) ** 2), (np.arange(10) - 5) ** 2) < r, 1, 0) for z, r in ((3, 9), (4, 12)))
    sides = [voxels(spark, v * (rng.random(v.shape) < 0.9)).where("v > 0").select(*BY, "z", "y", "x") for v in (a, b)]
    pts = [surface.surface_points(s, BY, grid) for s in sides]
    d = [np.array([r["d"] for r in surface.nearest(x, y, BY).collect()]) for x, y in (pts, pts[::-1])]
    got = surface.surface_distances(*sides, BY, grid).first()
    assert got["hd95"] == round(max(np.percentile(x, 95) for x in d), 2) and got["msd"] == pytest.approx(sum(x.mean() for x in d) / 2, abs=0.006)
    other = surface.surface_distances(sides[0], sides[1].withColumn("volume_id", F.lit(2).cast("long")), BY, grid).collect()
    assert {(r["volume_id"], r["hd95"], r["msd"]) for r in other} == {(1, None, None), (2, None, None)}


def test_grid_columns_agree_with_grids(spark):
    turn = (0.0, -1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0)
    made = {1: Grid((4, 5, 6), (1.0, 2.0, 3.0), (7.0, 8.0, 9.0)), 2: Grid((6, 4, 2), (0.5, 1.5, 2.5), (-1.0, 0.0, 1.0), turn)}
    table = grids(spark, made)
    rows, g = with_grid(spark.createDataFrame([(k, 1.0, 2.5, 0.25) for k in (1, 2, 3)], "volume_id long, i double, j double, k double"), table)
    p = g.position(F.col("i"), F.col("j"), F.col("k"))
    rows = rows.select("volume_id", "_grid", F.array(*p).alias("p"), F.array(*g.index(*p)).alias("q"), g.contains(F.col("i"), F.col("j"), F.col("k")).alias("inside"), g.n_voxels.alias("n"), F.array(*g.centre).alias("c"))
    for r in rows.collect():
        want = made[r["volume_id"]]
        assert np.allclose(r["p"], (want.matrix @ [1.0, 2.5, 0.25, 1])[:3]) and np.allclose(r["q"], [1.0, 2.5, 0.25]) and r["inside"] and r["n"] == want.n_voxels and np.allclose(r["c"], want.centre) and grid_from(r["_grid"]) == want
    assert rows.count() == 2
    fine = {r["volume_id"]: grid_from(r["grid"]) for r in table.resampled((1.0, 2.0, 3.0)).table.collect()}
    assert fine == {k: v.resampled((1.0, 2.0, 3.0)) for k, v in made.items()}
    boxes = spark.createDataFrame([(2, 0, 1, 1, 3, 2, 4)], "volume_id long, z_low int, z_high int, y_low int, y_high int, x_low int, x_high int")
    cut = {r["volume_id"]: grid_from(r["grid"]) for r in table.cropped(boxes).table.collect()}
    want = made[2].cropped((2, 1, 0), (3, 3, 2))
    assert cut[1] == made[1] and cut[2].size == want.size and np.allclose(cut[2].matrix, want.matrix)
    all_ = morphology.grid_voxels(spark.createDataFrame([(1,), (2,)], "volume_id long"), BY, table)
    assert {r["volume_id"]: r["count"] for r in all_.groupBy("volume_id").count().collect()} == {1: 120, 2: 48}
    assert isinstance(g, GridColumn)


def matrix_rows(spark, made, name="volume_id"):
    return spark.createDataFrame([(k, [float(v) for v in m.ravel()]) for k, m in made.items()], f"{name} long, matrix array<double>")


def corners(a, grid, moved, default):
    """Trilinear values at positions in mm, one corner after another."""
    i = (np.linalg.inv(grid.matrix) @ np.concatenate([moved, np.ones((len(moved), 1))], 1).T)[:3].T
    n = np.array(grid.size)
    out = np.full(len(i), default)
    for k, p in enumerate(np.round(i, 9)):
        if ((p >= 0) & (p <= n - 1)).all():
            low = np.floor(p).astype(int)
            out[k] = sum(np.prod(np.where(o, p - low, 1 - (p - low))) * a[tuple((low + o)[::-1])] for o in np.ndindex(2, 2, 2) if np.prod(np.where(o, p - low, 1 - (p - low))) > 0)
    return out


@pytest.mark.parametrize("edge", [4, 32])
def test_bricks_equal_corners_for_cases_with_grids_of_their_own(spark, edge):
    rng = np.random.default_rng(4)
    turn = tuple(tf.rotation((10, 20, 30)).ravel().tolist())
    source = {1: Grid((9, 8, 7), (1.0, 1.5, 2.0), (1.0, 2.0, 3.0)), 2: Grid((5, 12, 6), (2.0, 0.8, 1.0), (-3.0, 0.0, 4.0), turn)}
    target = {1: Grid((11, 9, 6), (0.9, 1.2, 2.1), (0.0, 3.0, 2.0)), 2: Grid((6, 7, 8), (1.5, 1.1, 0.9), (-4.0, 1.0, 3.0), turn)}
    arrays = {k: rng.normal(size=g.size[::-1]) for k, g in source.items()}
    move = {1: tf.from_parameters("rigid", [0.1, -0.2, 0.1, 1, 0, -1], (4, 5, 6)), 2: tf.from_parameters("affine", [1.1, 0.1, 0, 0, 0.9, 0, 0, 0.05, 1, 0.5, 0, 0], (0, 3, 6))}
    df = voxels(spark, arrays[1], 1).unionByName(voxels(spark, arrays[2], 2))
    out = bricks.resampled(df, matrix_rows(spark, move), BY, grids(spark, target), grids(spark, source), "matrix", "linear", edge=edge)
    for k, g in target.items():
        z, y, x = (v.ravel() for v in np.indices(g.size[::-1]))
        p = (move[k] @ g.matrix @ np.stack([x, y, z, np.ones(len(x))]))[:3].T
        got = array(out.where(F.col("volume_id") == k).fillna(-9.0), g.size[::-1]).ravel()
        assert np.allclose(got, corners(arrays[k], source[k], p, -9.0)) and (got != -9.0).sum() > 50
    whole, same = resample.to_spacing(df, BY, grids(spark, source), (1.0, 1.0, 1.0))
    for r in same.table.collect():
        assert grid_from(r["grid"]) == source[r["volume_id"]].resampled((1.0, 1.0, 1.0))
    assert whole.where("v IS NULL").count() == 0


def test_interpolations_of_higher_order(spark):
    grid, fine = Grid((14, 12, 10), (1.0, 1.0, 1.0)), Grid((14, 12, 8), (0.5, 0.5, 0.5), (3.0, 3.0, 3.0))
    z, y, x = np.indices((10, 12, 14)).astype(float)
    a = np.sin(x / 3) + np.cos(y / 4) * np.sin(z / 3)
    fz, fy, fx = np.indices((8, 12, 14)) * 0.5 + 3
    want = np.sin(fx / 3) + np.cos(fy / 4) * np.sin(fz / 3)
    df, case = voxels(spark, a), spark.createDataFrame([(1,)], "volume_id long")
    error = {}
    for how in ("linear", "bspline", "lanczos", "gaussian"):
        error[how] = np.abs(array(bricks.resampled(df, case, BY, fine, grid, None, how, edge=8), want.shape) - want).max()
        back = array(bricks.resampled(df, case, BY, grid, grid, None, how, edge=5), a.shape)
        assert how == "gaussian" or np.allclose(back, a)
    assert error["bspline"] < 4e-3 < error["linear"] and error["lanczos"] < 2e-2 and error["gaussian"] < 0.1
    flat = bricks.resampled(df.withColumn("v", F.lit(7.0)), case, BY, grid, grid, None, "gaussian")
    assert np.allclose(array(flat, a.shape), 7)
    f = np.random.default_rng(0).normal(size=(3, 9))
    c = bricks.spline_coefficients(f.copy())
    c = np.concatenate([c[:, 1:2], c, c[:, -2:-1]], 1)
    assert np.allclose((c[:, :-2] + 4 * c[:, 1:-1] + c[:, 2:]) / 6, f)
    with pytest.raises(ValueError):
        resample.resampled(df, case, BY, grid, grid, None, "cubic")


def test_sparse_labels_and_missing_volumes(spark):
    grid = Grid((6, 5, 4))
    labels = spark.createDataFrame([(1, 1, 1, 1, 3), (1, 3, 4, 5, 2)], "volume_id long, z int, y int, x int, label int")
    cases = matrix_rows(spark, {1: tf.translation([1, 0, 0]), 2: np.eye(4)})
    out = resample.resampled(labels, cases, BY, grid, grid, "matrix", "nearest", 0, "label")
    assert out.count() == 240 and out.schema["label"].dataType.simpleString() == "int"
    assert {tuple(r) for r in out.where("label > 0").collect()} == {(1, 1, 1, 0, 3), (1, 3, 4, 4, 2)}


def phantoms(spark, made):
    """Fixed volumes and organs of cases with grids of their own."""
    df = None
    for k, g in made.items():
        one = phantom.phantom(spark.range(1).select(F.lit(k).cast("long").alias("case_id")), ["case_id"], g)
        df = one if df is None else df.unionByName(one)
    named = F.element_at(F.create_map(*[F.lit(v) for p in phantom.ORGANS.items() for v in p]), F.col("label"))
    return df.select("case_id", "z", "y", "x", "v"), df.where("label > 0").select("case_id", "z", "y", "x", named.alias("organ"))


def test_batch_of_cases_with_grids_of_their_own(spark):
    """Two cases of different size and spacing, cropped to the liver, started from its centroid, moments and axes, judged by landmarks."""
    by = ["case_id"]
    fixed = {0: Grid((24, 24, 20), (4.0, 4.0, 5.0), (-40.0, -60.0, 30.0)), 1: Grid((20, 26, 24), (5.0, 4.0, 4.0), (10.0, -20.0, 0.0))}
    moving = {0: Grid((28, 22, 26), (3.5, 4.5, 4.0), (-42.0, -58.0, 28.0)), 1: Grid((26, 26, 20), (4.0, 4.0, 5.0), (8.0, -18.0, 2.0))}
    truth = {k: tf.from_parameters("rigid", [*np.radians(a), *d], g.centre) for (k, g), a, d in zip(fixed.items(), [(3, -2, 4), (-4, 0, 2)], [(5, -4, 3), (-6, 2, 4)], strict=True)}
    f_grids, m_grids = grids(spark, fixed, "case_id"), grids(spark, moving, "case_id")
    df, organs = phantoms(spark, fixed)
    back = matrix_rows(spark, {k: tf.inverted(m) for k, m in truth.items()}, "case_id")
    moved = written(resample.resampled(df, back, by, m_grids, f_grids, "matrix", "linear", -1000.0), "moved")
    wanted = back.join(organs.select("case_id", "organ").distinct(), "case_id")
    moved_organs = written(resample.warped_labels(organs.withColumn("label", F.lit(1)), wanted, ["case_id", "organ"], m_grids, f_grids, "matrix"), "organs")
    rng = np.random.default_rng(5)
    marks = []
    for k, g in fixed.items():
        for i in range(6):
            p = np.array(g.centre) + rng.uniform(-25, 15, 3)
            marks.append((k, i, *p.tolist(), *(truth[k] @ [*p, 1])[:3].tolist()))
    marks = spark.createDataFrame(marks, "case_id long, idx int, fx double, fy double, fz double, mx double, my double, mz double")
    plan = presets.preset("base", fixed_modality="CT", moving_modality="CT", spacing_mm=4.0, targets=("liver",), roi_crop=True, roi_margin_mm=16.0, init=("organ_centroid", "moments", "organ_moments"), stages=(presets.Stage("rigid", "ncc", 3, 60, 4096),), gates=gates.Gates(min_ncc_gain=0.01, min_dice={"liver": 0.8}, max_tre_mm=3.0))
    out = batch.run_batch(df, moved, f_grids, m_grids, plan, organs, moved_organs, landmarks=marks)
    cut = {r["case_id"]: r for r in out.regions.collect()}
    assert all(r["applied"] and r["speedup"] > 1.5 for r in cut.values()) and cut[0]["fixed_voxels"] != cut[1]["fixed_voxels"]
    assert {r["name"] for r in out.starts.collect()} == {"organ_centroid", "moments", "organ_moments"}
    rows = {r["case_id"]: r for r in out.metrics.collect()}
    assert set(rows) == {0, 1} and all(r["tre_mm"] < 3.0 < r["tre_before_mm"] and r["n_landmarks"] == 6 and r["dice"]["liver"] > 0.85 and not r["deformable"] for r in rows.values())
    assert {r["status"] for r in out.verdicts.collect()} == {"PASS"} and "tre_mm" in {r["name"] for r in out.checks.collect()}
    sizes = {r["case_id"]: r["count"] for r in out.moved.groupBy("case_id").count().collect()}
    assert sizes == {k: g.n_voxels for k, g in fixed.items()} and '"roi_crop": true' in out.settings


def test_batch_with_a_deformable_stage(spark):
    rng = np.random.default_rng(6)
    grid = Grid((20, 18, 16), (2.0, 2.0, 2.0), (5.0, 6.0, 7.0))
    a = 100 * optimise.smoothed(rng.random((16, 18, 20)), 1.5)
    at = np.stack(np.meshgrid(*[np.arange(n) for n in a.shape], indexing="ij")[::-1], -1).reshape(-1, 3).astype(float)
    bent = at + np.stack([1.2 * np.sin(at[:, 1] / 4), np.zeros(len(at)), 0.8 * np.cos(at[:, 0] / 5)], 1)
    b = optimise.interpolated(a, bent)[0].reshape(a.shape)
    sides = [voxels(spark, v, 3, "case_id") for v in (a, b)]
    organs = sides[0].where("v > 52").select("case_id", "z", "y", "x", F.lit("liver").alias("organ"))
    plan = presets.preset("base", fixed_modality="CT", moving_modality="CT", init=("identity",), stages=(presets.Stage("rigid", "ncc", 2, 20, 2048), presets.Stage("bspline", "ncc", 2, 40, 2048, 8.0)))
    out = batch.run_batch(*sides, grid, grid, plan, organs, organs)
    only = batch.run_batch(*sides, grid, grid, plan, linear_only=True)
    error = [np.abs(array(x.moved, a.shape) - a)[3:-3, 3:-3, 3:-3].mean() for x in (out, only)]
    r = out.metrics.first()
    assert error[0] < 0.6 * error[1], error
    assert r["deformable"] and not only.metrics.first()["deformable"]
    assert 0 < r["det_min"] < 0.98 < 1.02 < r["det_max"] < 4 and r["folding_fraction"] == 0 and r["bending_max_mm"] > 1 and out.fields.count() == a.size and out.labels.count() > 100


def test_fields_composed_and_inverted(spark):
    grid = Grid((14, 12, 10), (2.0, 2.0, 2.5), (1.0, 2.0, 3.0))
    z, y, x = (v.ravel() for v in np.indices((10, 12, 14)))
    u = np.stack([1.5 * np.sin(y / 4), np.cos(z / 3), 0.6 * np.sin(x / 5)], 1)
    cases = {1: u, 2: np.stack([-9.0 * np.sin(x / 1.5), 0 * x, 0 * x], 1)}  # the second one folds
    frames = [pd.DataFrame({"volume_id": k, "z": z, "y": y, "x": x, "dx": v[:, 0], "dy": v[:, 1], "dz": v[:, 2]}) for k, v in cases.items()]
    field = spark.createDataFrame(pd.concat(frames), "volume_id long, z int, y int, x int, dx double, dy double, dz double")
    back = written(resample.inverted_field(field, BY, grid, 0.005), "back")
    both = resample.composed_fields(back.select(*BY, "z", "y", "x", "dx", "dy", "dz"), field, BY, grid).where("dx IS NOT NULL")
    rows = both.where("volume_id = 1").collect()
    assert len(rows) > 0.6 * len(x) and all(abs(r["dx"]) + abs(r["dy"]) + abs(r["dz"]) < 0.01 for r in rows)
    folded = back.where("volume_id = 2")
    assert folded.where("dx IS NULL").count() > 300 and folded.where("dx IS NOT NULL AND residual > 0.005").count() == 0
    m = tf.from_parameters("affine", [1.1, 0, 0.1, 0, 1, 0, 0, 0, 0.9, 1, 2, 3], grid.centre)
    after = {(r["z"], r["y"], r["x"]): r for r in resample.matrix_after_field(field.where("volume_id = 1"), matrix_rows(spark, {1: m}), BY, grid, "matrix").collect()}
    p = (grid.matrix @ np.stack([x, y, z, np.ones(len(x))]))[:3].T
    want = (p + u) @ m[:3, :3].T + m[:3, 3] - p
    assert all(np.allclose([after[k][c] for c in ("dx", "dy", "dz")], w) for k, w in zip(zip(z, y, x, strict=True), want, strict=True))
    a = np.random.default_rng(7).normal(size=(10, 12, 14))
    got = array(resample.through_field(voxels(spark, a), field.where("volume_id = 1"), BY, grid, grid, matrix_rows(spark, {1: m}), "matrix").fillna(-9.0), a.shape).ravel()
    assert np.allclose(got, corners(a, grid, (p + u) @ m[:3, :3].T + m[:3, 3], -9.0))


def test_smoothing_of_cases_with_grids_of_their_own(spark):
    made = {1: Grid((6, 7, 5), (1.0, 2.0, 2.5)), 2: Grid((4, 5, 8), (2.0, 1.0, 1.0))}
    arrays = {k: np.random.default_rng(k).normal(size=g.size[::-1]) for k, g in made.items()}
    df = voxels(spark, arrays[1], 1).unionByName(voxels(spark, arrays[2], 2))
    out = neighbourhood.gaussian(df, BY, ["v"], 1.5, grids(spark, made))
    for k, g in made.items():
        one = neighbourhood.gaussian(voxels(spark, arrays[k], k), BY, ["v"], 1.5, g)
        assert np.allclose(array(out.where(F.col("volume_id") == k), arrays[k].shape), array(one, arrays[k].shape))
    boxes = geometry.bounding_box(df.where("z = 2 AND y = 2"), BY, grids(spark, made), 2.0)
    assert {r["volume_id"]: (r["z_low"], r["z_high"], r["y_low"], r["y_high"]) for r in boxes.collect()} == {1: (1, 3, 1, 3), 2: (0, 4, 0, 4)}


def test_percentiles_by_refinement(spark, monkeypatch):
    rng = np.random.default_rng(8)
    groups = {"normal": rng.normal(size=3000), "few": np.array([1.0, 2.0, 5.0]), "flat": np.full(2000, 7.0), "ties": rng.integers(0, 4, 2500).astype(float), "wide": np.concatenate([rng.normal(size=1500), [1e300, -1e300, 1e-300]]), "skew": np.exp(rng.normal(size=2000) * 8), "one": np.array([3.0])}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("normal", float("nan")), ("normal", None), ("none", None), (None, 1.0), (None, 2.0), ("one", float("inf"))]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    fractions = (0.0, 0.005, 0.5, 0.731, 0.995, 1.0)
    want = {r["k"]: r["p"] for r in quantiles.percentiles(df, ["k"], "v", fractions).collect()}
    monkeypatch.setattr(quantiles, "FEW", 10)
    monkeypatch.setattr(quantiles, "BINS", 16)
    monkeypatch.setattr(quantiles, "RANKED", 40)
    got = {r["k"]: r["p"] for r in quantiles.percentiles(df, ["k"], "v", fractions).collect()}
    assert set(got) == set(want) == {*groups, "none", None} and got["none"] is None
    for k, v in groups.items():
        assert np.allclose(got[k], np.quantile(v, fractions), rtol=1e-12) and np.allclose(got[k], want[k], rtol=1e-12), k
    assert got[None] == want[None]
    alone = quantiles.percentiles(df, [], "v", [0.5]).first()["p"]
    assert alone[0] == pytest.approx(np.median([v for _, v in rows if v is not None and np.isfinite(v)]))


def test_results_are_kept_by_content(spark, tmp_path):
    rng = np.random.default_rng(9)
    a, b = rng.normal(size=(3, 4, 5)), rng.normal(size=(3, 4, 5))
    changed = b.copy()
    changed[1, 2, 3] += 1e-9
    calls = []

    def means(df):
        def compute(cases):
            calls.append(sorted(r["volume_id"] for r in cases.collect()))
            return df.join(cases.select("volume_id"), "volume_id").groupBy("volume_id").agg(F.avg("v").alias("mean"))

        return compute

    def run(volumes, settings="x"):
        df = volumes[0]
        for more in volumes[1:]:
            df = df.unionByName(more)
        keys = cache.combined([cache.fingerprints(df.repartition(3), BY)], BY, settings)
        return {r["volume_id"]: r["mean"] for r in cache.computed_once(str(tmp_path / "store"), keys, means(df)).collect()}

    one = run([voxels(spark, a, 1), voxels(spark, b, 2), voxels(spark, a, 3)])
    assert one == {1: pytest.approx(a.mean()), 2: pytest.approx(b.mean()), 3: pytest.approx(a.mean())} and calls == [[1, 2]]
    assert run([voxels(spark, b, 2), voxels(spark, a, 1)]) == {k: one[k] for k in (1, 2)} and calls == [[1, 2]]
    run([voxels(spark, a, 1), voxels(spark, changed, 2)])
    assert calls == [[1, 2], [2]]
    run([voxels(spark, a, 1)], "y")
    assert calls[2:] == [[1]]
