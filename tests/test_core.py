"""The core operators against numpy on small volumes, and every query against its SQL."""

from __future__ import annotations

import json
import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratavox.functions import intensity, names, statistics
from stratavox.model import Grid
from stratavox.operators import candidates, gates, geometry, morphology, neighbourhood, optimise, overlap, regions, resample, surface
from stratavox.operators import transforms as tf
from stratavox.plans import batch, presets, queries, report
from stratavox.shared import bucketed
from stratavox.sources import files, phantom, series

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def voxels(spark, a, case=1, name="volume_id"):
    z, y, x = (i.ravel() for i in np.indices(a.shape, dtype=np.int32))
    return spark.createDataFrame(pd.DataFrame({name: np.int64(case), "z": z, "y": y, "x": x, "v": a.ravel().astype(float)}))


def array(df, shape, column="v"):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["z"], r["y"], r["x"]] = r[column]
    return out


def mask(df, shape):
    out = np.zeros(shape, bool)
    for r in df.collect():
        out[r["z"], r["y"], r["x"]] = True
    return out


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", ["ncc_by_group", "nmi_64", "dice_by_label", "gate_verdicts", "slice_regularity", "merged_profile", "resample_nearest", "otsu_threshold", "dicom_quantise", "organ_name_canonical"])
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=str)
    found = con.execute(queries.SQL[name])
    names_ = [c[0] for c in found.description]
    order = sorted(range(len(names_)), key=names_.__getitem__)
    assert sorted(names_) == sorted(df.columns)
    assert got == sorted((tuple(plain(r[i]) for i in order) for r in found.fetchall()), key=str)


def test_every_query_has_sql():
    assert queries.QUERIES.keys() == queries.SQL.keys()


def test_phantom_counts(spark):
    grid = Grid((80, 80, 64), (2.0, 2.0, 2.5))
    df = phantom.phantom(spark.range(1).select(F.col("id").alias("volume_id")), ["volume_id"], grid)
    got = {r["part"]: r["count"] for r in df.groupBy("part").count().collect()}
    assert got == {0: 282821, 100: 115667, 1: 8740, 2: 1511, 3: 861}


def test_similarity_of_degenerate_volumes(spark):
    rng = np.random.default_rng(0)
    base = pd.DataFrame({"k": np.repeat(["ok", "few", "flat", "bad"], [300, 20, 300, 300]), "a": rng.normal(size=920), "b": 0.0})
    base["b"] = base["a"] * 2 + 1
    base.loc[base["k"] == "flat", "b"] = 5.0
    base.loc[base["k"] == "bad", "b"] = float("nan")
    df = spark.createDataFrame(base)
    got = {r["k"]: r["c"] for r in df.groupBy("k").agg(statistics.ncc("a", "b").alias("c")).collect()}
    assert got["ok"] == pytest.approx(1) and got["few"] is None and got["flat"] is None and got["bad"] is None
    nmi = {r["k"]: r["nmi"] for r in statistics.nmi(df, ["k"], "a", "b").collect()}
    assert nmi["ok"] == pytest.approx(2, abs=0.02) and nmi["few"] is None and nmi.get("bad") is None


def test_nmi_matches_numpy(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=2000)
    b = a + rng.normal(size=2000)
    h = np.histogram2d(a, b, 64)[0] / 2000
    e = lambda p: -(p[p > 0] * np.log(p[p > 0])).sum()
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "a": a, "b": b}))
    assert statistics.nmi(df, ["k"], "a", "b").first()["nmi"] == pytest.approx((e(h.sum(0)) + e(h.sum(1))) / e(h), abs=1e-12)


def test_repair_and_preparation(spark):
    a = np.array([[[1.0, np.nan, np.inf, -np.inf, 5.0]]])
    assert array(intensity.repaired(voxels(spark, a), ["volume_id"]), a.shape).ravel().tolist() == [1, 1, 5, 1, 5]
    assert array(intensity.repaired(voxels(spark, a * np.nan), ["volume_id"]), a.shape).ravel().tolist() == [0] * 5
    flat = np.full((2, 2, 2), 7.0)
    assert (array(intensity.min_max(voxels(spark, flat), ["volume_id"]), flat.shape) == 7).all()
    assert (array(intensity.feature_normalised(voxels(spark, flat), ["volume_id"]), flat.shape) == 0).all()
    rng = np.random.default_rng(2).normal(size=(4, 5, 6))
    lo, hi = np.percentile(rng, [0.5, 99.5])
    got = array(intensity.prepared(voxels(spark, rng), ["volume_id"], modality="MR", normalize="minmax"), rng.shape)
    want = (np.clip(rng, lo, hi) - lo) / (hi - lo)
    assert np.allclose(got, want)
    with pytest.raises(ValueError):
        intensity.clip_bounds(voxels(spark, flat), ["volume_id"], window="none such")


def test_names(spark):
    df = spark.createDataFrame([(" Left-Kidney.NII.GZ",), ("liver.nii",), ("Spleen",), ("postcava",)], "n string")
    assert [r[0] for r in df.select(names.canonical(F.col("n"))).collect()] == ["kidney_left", "liver", "spleen", "inferior_vena_cava"]
    with pytest.raises(ValueError):
        names.pseudonym(F.col("n"), "")
    log = spark.createDataFrame([("x\nFinal metric value  = -0.5e-1\nFinal metric value = 2\n",), ("none",)], "l string")
    assert [r[0] for r in log.select(names.final_metric(F.col("l"))).collect()] == [2.0, None]


def test_overlap_edges(spark):
    f = spark.createDataFrame([(1, 0, 0, 0, "a"), (1, 0, 0, 1, "a"), (1, 0, 0, 2, "b")], "case_id long, z int, y int, x int, organ string")
    m = spark.createDataFrame([(1, 0, 0, 1, "a"), (1, 0, 0, 2, "a")], "case_id long, z int, y int, x int, organ string")
    got = {r["organ"]: r["dice"] for r in overlap.overlap(f, m, ["case_id"]).collect()}
    back = {r["organ"]: r["dice"] for r in overlap.overlap(m, f, ["case_id"]).collect()}
    assert got == {"a": 0.5, "b": 0.0} == back


def brute_ball(m, grid, radius, erode=False):
    out = np.zeros_like(m)
    for p in np.argwhere(np.ones_like(m)):
        vals = [m[tuple(p + o)] for o in np.array(morphology.ball(radius, grid)) if ((p + o >= 0) & (p + o < m.shape)).all()]
        out[tuple(p)] = all(vals) if erode else any(vals)
    return out


def test_morphology_against_numpy(spark):
    rng = np.random.default_rng(3)
    m = rng.random((6, 7, 8)) < 0.4
    grid = Grid((8, 7, 6), (1.0, 1.0, 2.0))
    df = voxels(spark, m).where("v > 0").select("volume_id", "z", "y", "x")
    by = ["volume_id"]
    assert (mask(morphology.dilated(df, by, 2.0, grid), m.shape) == brute_ball(m, grid, 2.0)).all()
    assert (mask(morphology.eroded(df, by, 1.0, grid), m.shape) == brute_ball(m, grid, 1.0, True)).all()
    label, n = np.zeros(m.shape, int), 0
    for p in np.argwhere(m):
        if not label[tuple(p)]:
            n += 1
            todo = [tuple(p)]
            while todo:
                q = todo.pop()
                if label[q] or not m[q]:
                    continue
                label[q] = n
                todo += [tuple(np.add(q, o)) for o in morphology.FACES if all(0 <= v < s for v, s in zip(np.add(q, o), m.shape, strict=True))]
    rows = morphology.labelled(df, by).collect()
    groups = {}
    for r in rows:
        groups.setdefault(str(r["component"]), set()).add(label[r["z"], r["y"], r["x"]])
    assert len(rows) == m.sum() and all(len(g) == 1 for g in groups.values()) and len(groups) == n
    ring = np.ones((5, 5, 5), bool)
    ring[2, 2, 2] = False
    hollow = voxels(spark, ring).where("v > 0").select("volume_id", "z", "y", "x")
    assert mask(morphology.filled(hollow, by, Grid((5, 5, 5))), ring.shape).all()


def test_surface_distance_against_brute_force(spark):
    rng = np.random.default_rng(4)
    pts = lambda n, s: pd.DataFrame(rng.random((n, 3)) * s, columns=["px", "py", "pz"]).assign(k=1)
    a, b = pts(80, 60.0), pts(25, 200.0)
    want = np.sqrt(((a[["px", "py", "pz"]].to_numpy()[:, None] - b[["px", "py", "pz"]].to_numpy()[None]) ** 2).sum(-1)).min(1)
    got = surface.nearest(spark.createDataFrame(a), spark.createDataFrame(b), ["k"], 2.0).collect()
    assert np.allclose(sorted(r["d"] for r in got), sorted(want))
    none = surface.nearest(spark.createDataFrame(a), spark.createDataFrame(b.assign(k=2)), ["k"]).collect()
    assert len(none) == 80 and all(r["d"] is None for r in none)


def test_geometry(spark):
    grid = Grid((6, 5, 4), (1.0, 2.0, 3.0), (10.0, 20.0, 30.0))
    assert grid.orientation() == "LPS" and grid.same_as(Grid((6, 5, 4), (1.00001, 2.0, 3.0), (10.0, 20.0, 30.0)))
    a = np.random.default_rng(5).random((4, 5, 6))
    rows, new = geometry.reoriented(voxels(spark, a), grid, "RAS")
    assert new.orientation() == "RAS" and np.allclose(array(rows, a.shape), a[:, ::-1, ::-1])
    assert np.allclose(new.matrix @ [5, 4, 0, 1], grid.matrix @ [0, 0, 0, 1])
    m = voxels(spark, a).where("v > 0.4")
    p = np.argwhere(a > 0.4)[:, ::-1] * grid.spacing + grid.origin
    got = geometry.principal_axes(m, ["volume_id"], grid).first()
    values = np.sqrt(np.linalg.eigvalsh(np.cov(p.T))[::-1])
    assert np.allclose(got["lengths"], values) and np.allclose(np.array(got["axes"]).reshape(3, 3) @ np.array(got["axes"]).reshape(3, 3).T, np.eye(3))
    centre = geometry.centre_of_mass(m, ["volume_id"], grid, mask=True).first()
    assert np.allclose([centre["cx"], centre["cy"], centre["cz"]], p.mean(0))


def test_resampling(spark):
    a = np.random.default_rng(6).random((5, 6, 7))
    grid, by = Grid((7, 6, 5), (1.0, 1.0, 2.0)), ["volume_id"]
    df = voxels(spark, a)
    eye = spark.createDataFrame([(1, [float(v) for v in np.eye(4).ravel()])], "volume_id long, matrix array<double>")
    assert np.allclose(array(resample.resampled(df, eye, by, grid, grid, "matrix"), a.shape), a)
    move = spark.createDataFrame([(1, [float(v) for v in tf.translation([1, 0, 2]).ravel()])], "volume_id long, matrix array<double>")
    want = np.zeros_like(a)
    want[:-1, :, :-1] = a[1:, :, 1:]
    for how in ("nearest", "linear"):
        assert np.allclose(array(resample.resampled(df, move, by, grid, grid, "matrix", how), a.shape), want)
    half = array(resample.to_spacing(df, by, grid, (0.5, 1.0, 2.0))[0], (5, 6, 14))
    assert np.allclose(half[:, :, ::2], a) and np.allclose(half[:, :, 1:-1:2], (a[:, :, 1:] + a[:, :, :-1]) / 2)
    field = resample.displacement_field(move, by, grid, "matrix")
    pts = spark.createDataFrame([(1, 0, 1.5, 2.0, 3.0), (1, 1, 99.0, 0.0, 0.0)], "volume_id long, idx int, px double, py double, pz double")
    got = {r["idx"]: (r["mx"], r["my"], r["mz"]) for r in resample.field_at(pts, field, by, grid).collect()}
    assert np.allclose(got[0], (2.5, 2.0, 5.0)) and got[1] == (None, None, None)


def test_box_mean_jacobian_and_channels(spark):
    rng = np.random.default_rng(7)
    a = rng.random((6, 7, 9))
    grid, by = Grid((9, 7, 6), (1.0, 2.0, 2.5)), ["volume_id"]
    pad = np.pad(a, 2, "edge")
    want = np.lib.stride_tricks.sliding_window_view(pad, (5, 5, 5)).mean((-1, -2, -3))
    df = voxels(spark, a)
    assert np.allclose(array(neighbourhood.box_mean(df, by, ["v"], 2, grid), a.shape), want)
    z, y, x = np.indices(a.shape)
    field = df.select("volume_id", "z", "y", "x", (F.col("x") * 0.1 * 1.0 + F.col("y") * 0.2).alias("dx"), (F.col("y") * 0.3 * 2.0).alias("dy"), (F.col("z") * -3.0 * 2.5).alias("dz"))
    det = array(neighbourhood.jacobian(field, by, grid), a.shape, "det")
    assert np.allclose(det[1:-1, 1:-1, 1:-1], 1.1 * 1.3 * -2.0)
    stats = statistics.jacobian_statistics(neighbourhood.jacobian(field, by, grid), by).first()
    assert stats["folding_fraction"] > 0.5
    ch = neighbourhood.self_similarity(df, by, grid).collect()
    assert len(neighbourhood.PAIRS) == 12 and len(ch) == a.size and all(len(r["ch"]) == 12 and 0 <= min(r["ch"]) and 0.9 < max(r["ch"]) <= 1 for r in ch)
    k = rng.normal(size=(200, 2)) @ rng.normal(size=(2, 5)) + 3
    mean, comp, share = neighbourhood.principal_components(spark.createDataFrame([(r.tolist(),) for r in k], "ch array<double>"), 2)
    assert share == 1.0 and np.allclose((k - mean) @ comp.T @ comp + mean, k)


def test_transforms():
    m = tf.from_parameters("affine", [1.1, 0.05, 0, 0, 0.9, 0.02, 0.01, 0, 1.2, 3, -4, 5], (10, 20, 30))
    assert np.allclose(tf.composed([m, tf.inverted(m)]), np.eye(4), atol=1e-10) and tf.is_identity(np.eye(4)) and not tf.is_identity(m)
    r = tf.from_parameters("rigid", [0.1, -0.2, 0.3, 1, 2, 3], (5, 5, 5))
    d = tf.decomposed(r)
    assert np.allclose(d["rotation_deg"], np.degrees([0.1, -0.2, 0.3])) and np.allclose(d["scale"], 1) and tf.kind_of(r) == "RIGID" and tf.kind_of(m) == "AFFINE"
    assert np.allclose(tf.linearised(lambda p: p @ m[:3, :3].T + m[:3, 3]), m)
    with pytest.raises(ValueError):
        tf.linearised(lambda p: p**2)
    text = "#Insight Transform File V1.0\nTransform: Euler3DTransform_double_3_3\nParameters: 0.1 -0.2 0.3 1 2 3\nFixedParameters: 5 5 5 0\n"
    assert np.allclose(tf.parse_transform(text), r)


def test_candidates_pick_the_true_start(spark):
    rng = np.random.default_rng(8)
    a = optimise.smoothed(rng.random((10, 12, 14)), 1.0)
    b = np.roll(a, 2, 2)
    grid = Grid((14, 12, 10), (2.0, 2.0, 2.0))
    starts = {1: {"wrong": np.eye(4), "right": tf.translation([4, 0, 0])}, 2: {"right": np.eye(4), "again": np.eye(4)}}
    c = candidates.candidates(spark, starts, [(0, 0, 0)], grid.centre)
    f = voxels(spark, a, 1, "case_id").unionByName(voxels(spark, a, 2, "case_id"))
    m = voxels(spark, b, 1, "case_id").unionByName(voxels(spark, a, 2, "case_id"))
    got = {(r["case_id"], r["name"]): r for r in candidates.ranked(candidates.scored(c, f, m, grid, grid)).collect()}
    assert got[1, "right"]["rank"] == 1 and not got[1, "right"]["ambiguous"] and got[2, "right"]["rank"] == 1 and got[2, "right"]["ambiguous"]


def test_gates_table(spark):
    cols = "run_id long, ncc_gain double, nmi_gain double, final_metric double, dice map<string,double>, folding_fraction double, deformable boolean, det_min double, det_max double, translation_mm double, scale_deviation double, determinant double, tre_mm double"
    rows = [(1, 0.1, 0.1, -0.5, {"liver": 0.9}, 0.0, True, 0.5, 1.5, 1.0, 0.0, 1.0, 1.0), (2, 0.0, None, 0.0, {}, None, True, 0.1, 9.0, 999.0, 0.9, -1.0, None), (3, -0.1, -0.1, None, {"liver": 0.1}, 0.5, False, None, None, None, None, None, 9.0)]
    g = gates.Gates(min_ncc_gain=0.0, min_nmi_gain=0.0, min_dice={"liver": 0.8}, max_tre_mm=3.0)
    got = {(r["run_id"], r["name"]): r["status"] for r in gates.checks(spark.createDataFrame(rows, cols), g).collect()}
    assert {v for (k, _), v in got.items() if k == 1} == {"PASS"}
    want = {"ncc_gain": "WARN", "nmi_gain": "WARN", "final_metric": "FAIL", "dice[liver]": "WARN", "folding_fraction": "WARN", "jacobian_range": "WARN", "translation_mm": "FAIL", "scale_deviation": "FAIL", "determinant": "FAIL", "tre_mm": "WARN"}
    assert {n: v for (k, n), v in got.items() if k == 2} == want
    assert {n: v for (k, n), v in got.items() if k == 3} == {"ncc_gain": "FAIL", "nmi_gain": "FAIL", "final_metric": "WARN", "dice[liver]": "FAIL", "folding_fraction": "FAIL", "tre_mm": "FAIL"}
    bare = gates.Gates(max_folding_fraction=None, min_abs_final_metric=None, max_translation_mm=None, max_scale_deviation=None)
    assert {r["name"] for r in gates.checks(spark.createDataFrame(rows, cols).where("run_id = 1"), bare).collect()} == {"configuration"}


def test_batch_refuses_what_it_does_not_run(spark):
    df = spark.createDataFrame([], "case_id long, z int, y int, x int, v double")
    grid = Grid((4, 4, 4), (1.0, 1.0, 1.0), (0.0, 0.0, 0.0))
    with pytest.raises(ValueError, match="does not execute"):
        batch.run_batch(df, df, grid, grid, presets.preset("base", features=True))


def test_stages_are_adapted_to_the_targets():
    plan = batch.resolved(presets.preset("ct_ct_lung_4d", targets=("liver",)))
    assert [s.kind for s in plan.stages] == ["rigid", "bspline"] and plan.stages[1].grid_mm == min(15.0, names.PROFILES["liver"].bspline_grid_mm)
    rigid = next(n for n, p in names.PROFILES.items() if not p.deformable)
    stiff = batch.resolved(presets.preset("ct_ct_lung_4d", targets=(rigid,))).stages[1]
    assert stiff.grid_mm == 40.0 and stiff.bending_weight == 5.0
    assert [s.kind for s in batch.resolved(presets.preset("ct_ct_lung_4d"), True).stages] == ["rigid"]
    again = presets.from_settings(json.loads(presets.as_json(plan)))
    assert again == plan


def test_background_outside_of_the_source_is_its_least_value(spark):
    rows = [(c, 0, 0, x, float(v)) for c, low in ((1, -1000), (2, 7)) for x, v in enumerate([low, low + 5, low + 10])]
    df = spark.createDataFrame(rows, "case_id long, z int, y int, x int, v double")
    a, b = Grid((5, 1, 1), (1.0, 1.0, 1.0), (-1.0, 0.0, 0.0)), Grid((3, 1, 1), (1.0, 1.0, 1.0), (0.0, 0.0, 0.0))
    got = {(r["case_id"], r["x"]): r["v"] for r in resample.resampled(df, df.select("case_id").distinct(), ["case_id"], a, b, default=None).collect()}
    assert [got[1, x] for x in range(5)] == [-1000, -1000, -995, -990, -1000] and [got[2, x] for x in range(5)] == [7, 7, 12, 17, 7]


def test_batch_recovers_a_known_transform(spark):
    grid = Grid((24, 24, 20), (4.0, 4.0, 5.0), (-40.0, -60.0, 30.0))
    by = ["case_id"]
    cases = spark.range(2).select(F.col("id").alias("case_id"))
    df = phantom.phantom(cases, by, grid)
    truth = {0: tf.from_parameters("rigid", [*np.radians([3, -2, 4]), 5, -4, 3], grid.centre), 1: tf.from_parameters("rigid", [*np.radians([-4, 0, 2]), -6, 2, 4], grid.centre)}
    inverse = spark.createDataFrame([(k, [float(v) for v in tf.inverted(m).ravel()]) for k, m in truth.items()], "case_id long, matrix array<double>")
    moving = resample.resampled(df, inverse, by, grid, grid, "matrix", "linear", -1000.0)
    organs = df.where("label > 0").select("case_id", "z", "y", "x", F.element_at(F.create_map(*[F.lit(v) for p in phantom.ORGANS.items() for v in p]), F.col("label")).alias("organ"))
    moved = resample.warped_labels(organs.withColumn("label", F.lit(1)), inverse.join(organs.select("case_id", "organ").distinct(), "case_id"), ["case_id", "organ"], grid, grid, "matrix")
    plan = presets.preset("base", fixed_modality="CT", moving_modality="CT", spacing_mm=4.0, stages=(presets.Stage("rigid", "ncc"),), gates=gates.Gates(min_ncc_gain=0.01, min_dice={"liver": 0.8}))
    out = batch.run_batch(df, moving, grid, grid, plan, organs, moved)
    probe = np.array([[*grid.centre, 1.0], [0, -30, 60, 1], [-20, -20, 100, 1]])
    for r in out.transforms.collect():
        error = np.abs(probe @ (np.array(r["matrix"]).reshape(4, 4) - truth[r["case_id"]]).T)[:, :3]
        assert np.linalg.norm(error, axis=1).max() < 1.5
    assert {r["status"] for r in out.verdicts.collect()} == {"PASS"}
    assert all(r["dice"]["liver"] > 0.85 for r in out.metrics.collect())
    text = report.manifests(out.verdicts, out.metrics, out.checks).first()["value"]
    assert '"status":"PASS"' in text and "NaN" not in text
    assert "n/a" in report.html_report({"status": "PASS"}, [{"name": "<x>", "status": "PASS", "measured": None, "threshold": 1.0}], {"a": float("nan")})


def test_deformable_stage_reduces_the_difference():
    rng = np.random.default_rng(9)
    a = optimise.smoothed(rng.random((14, 16, 18)), 1.5)
    grid = np.stack(np.meshgrid(*[np.arange(n) for n in a.shape], indexing="ij")[::-1], -1).reshape(-1, 3).astype(float)
    bent = grid + np.stack([1.2 * np.sin(grid[:, 1] / 5), np.zeros(len(grid)), np.zeros(len(grid))], 1)
    b = optimise.interpolated(a, bent)[0].reshape(a.shape)
    u = optimise.demons(a, b, 60, 1.0)
    after = optimise.interpolated(b, grid + u.reshape(-1, 3))[0].reshape(a.shape)
    inner = (slice(3, -3),) * 3
    assert np.abs(after - a)[inner].mean() < 0.4 * np.abs(b - a)[inner].mean()


def test_files(spark, tmp_path):
    a = np.random.default_rng(10).normal(size=(4, 5, 6)).astype(np.float32)
    grid = Grid((6, 5, 4), (0.7, 0.8, 2.5), (-10.0, 20.0, 5.0))
    (tmp_path / "v.nii.gz").write_bytes(files.encode_nifti(a, grid))
    headers, vox = files.read_nifti(spark, str(tmp_path))
    h = headers.first()
    assert h["size"] == [6, 5, 4] and np.allclose(h["spacing"], grid.spacing) and np.allclose(h["origin"], grid.origin) and np.allclose(h["direction"], grid.direction)
    assert np.allclose(array(vox, a.shape), a)
    again = files.nifti_files(vox.withColumn("volume_id", F.lit(1)), "volume_id", grid).first()["content"]
    assert np.allclose(files.decode_nifti(bytes(again))[0], a)
    (tmp_path / "p.txt").write_text("point\n2\n1 2 3 # c\n\n4,5;6\n")
    assert [(r["idx"], r["x"], r["z"]) for r in files.read_landmarks(spark, str(tmp_path / "p.txt")).orderBy("idx").collect()] == [(0, 1.0, 3.0), (1, 4.0, 6.0)]
    (tmp_path / "bad.txt").write_text("1 2\n")
    with pytest.raises(Exception, match="not a landmark"):
        files.read_landmarks(spark, str(tmp_path / "bad.txt")).collect()
    (tmp_path / "c.csv").write_text("﻿fixed,moving,name\na,b,../x y\nc,d,\n")
    assert [r["name"] for r in files.read_cases(spark, str(tmp_path / "c.csv")).orderBy("case_id").collect()] == ["__x_y", "case0002"]
    assert files.label_names('{"1": "liver"}') == {1: "liver"} == files.label_names("# c\n1: liver\n")
    p = files.parse_parameters('(A "x y" 1.5) // c\n(B "True")\n')
    assert p == {"A": ("x y", "1.5"), "B": ("True",)} and files.write_parameters(p) == '(A "x y" 1.5)\n(B "true")\n'


def dicom(position, values):
    element = lambda g, e, vr, v: np.array([g, e], "<u2").tobytes() + vr.encode() + (np.array([len(v)], "<u2").tobytes() if vr not in ("OW",) else b"\0\0" + np.array([len(v)], "<u4").tobytes()) + v
    text = lambda s: (s + " " * (len(s) % 2)).encode()
    short = lambda n: np.array([n], "<u2").tobytes()
    body = element(2, 0x10, "UI", b"1.2.840.10008.1.2.1\0") + element(8, 0x60, "CS", b"CT") + element(0x20, 0xE, "UI", b"1.2.3 ") + element(0x20, 0x32, "DS", text(f"0\\0\\{position}")) + element(0x20, 0x37, "DS", text("1\\0\\0\\0\\1\\0"))
    return b"\0" * 128 + b"DICM" + body + element(0x28, 0x10, "US", short(2)) + element(0x28, 0x11, "US", short(3)) + element(0x28, 0x103, "US", short(1)) + element(0x28, 0x1052, "DS", b"-1000 ") + element(0x28, 0x1053, "DS", b"2 ") + element(0x7FE0, 0x10, "OW", np.array(values, "<i2").tobytes())


def test_dicom_series(spark, tmp_path):
    for k in range(4):
        (tmp_path / f"{k}.dcm").write_bytes(dicom(2.5 * k if k < 3 else 9.0, range(6)))
    (tmp_path / "note.txt").write_text("no")
    h = files.dicom_headers(spark, str(tmp_path))
    inv = series.inventory(h).first()
    assert (inv["series_uid"], inv["n_files"], inv["modality"], inv["rank"]) == ("1.2.3", 4, "CT", 1)
    at = h.select("series_uid", F.get(F.split("position", r"\\"), F.lit(2)).cast("double").alias("p"))
    reg = series.slice_regularity(at, ["series_uid"], "p").first()
    assert reg["median_gap"] == 2.5 and reg["irregular"]
    values, place = files.dicom_slices((tmp_path / "1.dcm").read_bytes())
    assert values.tolist() == [[-1000, -998, -996], [-994, -992, -990]] and place == 2.5
    with pytest.raises(ValueError):
        files.dicom_elements(b"x" * 200)


def test_presets():
    assert len(presets.PRESETS) == 8 and presets.preset("ct_cbct_igrt").gates.max_translation_mm == 40
    assert presets.preset("base", targets=()).targets == ()
    with pytest.raises(ValueError):
        presets.preset("none")
    with pytest.raises(ValueError):
        presets.preset("base", wrong=1)
    with pytest.raises(ValueError):
        presets.Prep(clip=(2, 1))
    assert presets.metric_of(presets.Stage("rigid"), presets.preset("ct_mr_abdomen")) == "mi" and presets.metric_of(presets.Stage("rigid"), presets.preset("ct_cbct_igrt")) == "ncc"
    assert presets.adapted(presets.Stage("bspline"), False, 20).grid_mm == 40 and presets.adapted(presets.Stage("bspline"), True, 12).grid_mm == 12


def test_streamed_jobs(spark, tmp_path):
    from stratavox.streaming import jobs

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"job_id":"1","submitted":"2024-01-01T00:00:00Z","fixed":"a","moving":"b","preset":"base"}\n' * 2)
    rows = jobs.requests(spark, str(tmp_path / "in"))
    jobs.run_stream(rows, lambda df: df.withColumn("status", F.lit("done")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("job_id", "status").collect()] == [("1", "done")]


def test_padding_and_smoothing(spark):
    a = np.random.default_rng(21).normal(size=(5, 6, 7))
    grid = Grid((7, 6, 5), (1.0, 2.0, 2.5), (3.0, 4.0, 5.0))
    more, wide = geometry.padded(voxels(spark, a), grid, 4)
    assert wide.size == (8, 8, 8) and np.allclose(array(more, (8, 8, 8)), np.pad(a, ((1, 2), (1, 1), (0, 1)), mode="edge"))
    assert wide.origin == (3.0, 2.0, 2.5)
    back = geometry.unpadded(more, grid, 4)
    assert back.count() == a.size and np.allclose(array(back, a.shape), a)
    want = a
    for axis, spacing in enumerate((2.5, 2.0, 1.0)):
        sigma = 1.5 / spacing
        r = int(np.ceil(3 * sigma))
        w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
        index = np.arange(want.shape[axis])
        want = sum(k * want.take(np.clip(index + o, 0, len(index) - 1), axis) for k, o in zip(w / w.sum(), range(-r, r + 1), strict=True))
    assert np.allclose(array(intensity.prepared(voxels(spark, a), ["volume_id"], percentiles=None, smooth_mm=1.5, grid=grid), a.shape), want)
    with pytest.raises(ValueError, match="grid"):
        intensity.prepared(voxels(spark, a), ["volume_id"], smooth_mm=1.5)


def test_combined_mask_falls_back(spark):
    grid = Grid((10, 10, 10), (2.0, 2.0, 2.0))
    body = np.full((10, 10, 10), -1000.0)
    body[2:8, 2:8, 2:8] = 40.0
    df = voxels(spark, body, 1).unionByName(voxels(spark, body, 2)).unionByName(voxels(spark, body, 3))
    organs = spark.createDataFrame([(1, 5, 5, 5, "liver"), (1, 3, 3, 3, "spleen"), (2, 3, 3, 3, "spleen")], "volume_id long, z int, y int, x int, organ string")
    mask = regions.combined_mask(organs, ["volume_id"], grid, ["liver"], 2.0, df, "CT")
    got = {k: {(r["z"], r["y"], r["x"]) for r in mask.where(F.col("volume_id") == k).collect()} for k in (1, 2, 3)}
    ball = lambda z, y, x: {(z, y, x), (z + 1, y, x), (z - 1, y, x), (z, y + 1, x), (z, y - 1, x), (z, y, x + 1), (z, y, x - 1)}
    assert got[1] == ball(5, 5, 5) and got[2] == ball(3, 3, 3)
    assert got[3] >= set(map(tuple, np.argwhere(body > 0).tolist())) and len(got[3]) < 600
    assert regions.combined_mask(organs, ["volume_id"], grid, ["liver"], 2.0).where("volume_id = 3").count() == 0
    assert {r["volume_id"] for r in regions.working_mask(mask, ["volume_id"], 8).collect()} == {3}
    plan = {r["volume_id"]: r for r in regions.roi_plan(df, organs, organs.where("organ = 'liver'"), ["volume_id"], grid, grid, ["liver"], 4.0).collect()}
    assert plan[1]["applied"] and plan[1]["fixed_voxels"] == 125 and plan[1]["speedup"] == 8.0
    assert plan[2]["reason"] == "missing segmentation" and plan[3]["fixed_voxels"] == 1000
    assert {r["reason"] for r in regions.roi_plan(df, organs, organs, ["volume_id"], grid, grid, [], 4.0).collect()} == {"no target"}


def test_external_labels(spark, tmp_path):
    grid, fine = Grid((6, 5, 4), (2.0, 2.0, 2.0)), Grid((12, 10, 8), (1.0, 1.0, 1.0))
    a, b, c = np.zeros((4, 5, 6)), np.zeros((4, 5, 6)), np.zeros((8, 10, 12))
    a[0, 0, :3], b[0, 0, 2:5], c[2, 2, 2] = 1, 1, 1
    (tmp_path / "organs").mkdir()
    for name, values, g in (("Left-Kidney", a, grid), ("liver", b, grid), ("spleen", c, fine)):
        (tmp_path / f"organs/{name}.nii.gz").write_bytes(files.encode_nifti(values.astype(np.float32), g))
    labels, names_ = files.external_labels(spark, 7, directory=str(tmp_path / "organs"))
    assert {(r["label"], r["organ"]) for r in names_.collect()} == {(1, "kidney_left"), (2, "liver"), (3, "spleen")}
    assert {(r["volume_id"], r["z"], r["y"], r["x"], r["label"]) for r in labels.collect()} == {(7, 0, 0, 0, 1), (7, 0, 0, 1, 1), (7, 0, 0, 2, 1), (7, 0, 0, 3, 2), (7, 0, 0, 4, 2), (7, 1, 1, 1, 3)}
    (tmp_path / "m.nii.gz").write_bytes(files.encode_nifti((a * 5).astype(np.float32), grid))
    assert [tuple(r) for r in files.external_labels(spark, 7, labelmap=str(tmp_path / "m.nii.gz"))[1].collect()] == [(7, 5, "label_5")]
    assert [tuple(r) for r in files.external_labels(spark, 7, mask=str(tmp_path / "m.nii.gz"))[1].collect()] == [(7, 1, "target")]
    (tmp_path / "m.nii.gz.labels.json").write_text('{"5": "liver"}')
    assert [tuple(r) for r in files.external_labels(spark, 7, labelmap=str(tmp_path / "m.nii.gz"))[1].collect()] == [(7, 5, "liver")]
    with pytest.raises(ValueError):
        files.external_labels(spark, 7)


def test_settings_by_path():
    plan = presets.overridden(presets.preset("ct_mr_abdomen"), ["stages.0.metric=ncc", "gates.min_dice.spleen=0.5", "targets=[\"spleen\"]", "fixed.window=ct_liver", "flip_check=true"])
    assert plan.stages[0].metric == "ncc" and plan.stages[1] == presets.preset("ct_mr_abdomen").stages[1] and plan.targets == ("spleen",) and plan.flip_check
    assert plan.gates.min_dice == {"liver": 0.85, "spleen": 0.5} and plan.fixed.window == "ct_liver"
    for wrong in ("nothing", "stages.9.metric=ncc", "gates.none.x=1", "wrong=1", "fixed.wrong=1"):
        with pytest.raises(ValueError):
            presets.overridden(plan, [wrong])
    assert presets.merged({"a": {"b": 1, "c": [1, 2]}, "d": 4}, {"a": {"b": 2, "c": [3]}, "d": None}) == {"a": {"b": 2, "c": [3]}, "d": 4}


def test_checks_of_stages(spark):
    cols = "run_id long, stages array<struct<stage: string, final_metric: double>>, determinant double"
    rows = [(1, [("rigid", -0.5), ("affine", 0.0)], 1.0), (2, [("rigid", None)], 1.0), (3, [], -1.0), (4, None, 1.0)]
    bare = gates.Gates(max_folding_fraction=None, max_translation_mm=None, max_scale_deviation=None)
    got = {(r["run_id"], r["name"]): r["status"] for r in gates.checks(spark.createDataFrame(rows, cols), bare).collect()}
    assert got == {(1, "final_metric[rigid]"): "PASS", (1, "final_metric[affine]"): "FAIL", (2, "final_metric[rigid]"): "WARN", (3, "determinant"): "FAIL", (4, "configuration"): "WARN"}


def test_batch_fits_within_the_mask_of_targets(spark):
    grid = Grid((24, 24, 20), (4.0, 4.0, 5.0), (-40.0, -60.0, 30.0))
    df = phantom.phantom(spark.range(2).select(F.col("id").alias("case_id")), ["case_id"], grid)
    organs = df.where("label > 0").select("case_id", "z", "y", "x", F.element_at(F.create_map(*[F.lit(v) for p in phantom.ORGANS.items() for v in p]), F.col("label")).alias("organ"))
    plan = presets.preset("base", fixed_modality="CT", moving_modality="CT", spacing_mm=4.0, targets=("liver",), flip_check=True, stages=(presets.Stage("rigid", "ncc"), presets.Stage("affine", "ncc")))
    for labels in (organs.where("case_id = 0"), None):  # case 1 has no organ there: its mask is empty, so its whole volume serves
        out = batch.run_batch(df, df, grid, grid, plan, labels, labels)
        rows = out.transforms.collect()
        assert {r["case_id"] for r in rows} == {0, 1}
        for r in rows:
            assert np.abs(np.array(r["matrix"]).reshape(4, 4) - np.eye(4))[:3, :3].max() < 0.02 and [s["stage"] for s in r["stages"]] == ["rigid", "affine"]
            assert list(r["stages"][-1]["matrix"]) == list(r["matrix"])
        assert {r["name"] for r in out.checks.collect()} >= {"final_metric[rigid]", "final_metric[affine]"}


def test_a_bucketed_table_is_joined_without_moving_it(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (2**62 + 1, "d")], "k long, v string")
    table = bucketed(rows, "k", "t")
    assert sorted(map(tuple, table.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    other = spark.range(3).withColumnRenamed("id", "k").hint("merge")
    joined = table.join(other, "k")
    assert sorted(r.v for r in joined.collect()) == ["a", "b"]
    plan = joined._jdf.queryExecution().toString()
    assert "Bucketed: true" in plan.split("== Physical Plan ==")[1]
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("stratavox_")]
    assert not bucketed(rows.limit(0), "k", "t").count()


def test_scores_are_rounded_as_in_sql(spark, tmp_path):
    """Balances whose quotients are halves of the last digit only in decimal text: 2850 / 10000 is 0.28 by SQL. Rows: nation, key, balance."""
    rows = [(0, i + 1, float(b)) for i, b in enumerate((2850, 2849.99, 2800, 2850, 5750, 5650, 1450, -1450, -50, 9999.99))]
    spark.createDataFrame(rows, "s_nationkey int, s_suppkey long, s_acctbal double").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    got = sorted(tuple(r) for r in queries.QUERIES["init_candidate_ranking"](spark, str(tmp_path)).collect())
    duckdb.sql(f"CREATE OR REPLACE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet/*.parquet'")
    assert got == sorted(duckdb.sql(queries.SQL["init_candidate_ranking"]).fetchall())


def test_a_log_is_made_once(spark, tmp_path):
    """Texts that name the phrases themselves; the plan makes the log once and puts it in lower case once, however many texts are looked for."""
    rows = [(i, None if i % 7 == 0 else f"Too many SAMPLES {i}\nSingular Description: x\nMetric éİ") for i in range(48)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    df = queries.QUERIES["log_diagnosis"](spark, str(tmp_path))
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, df.collect()), key=str) == sorted(duckdb.sql(queries.SQL["log_diagnosis"]).fetchall(), key=str)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 1 and plan.count("lower(") == 2


def test_figures_of_volumes_do_not_deal_the_rows(spark, tmp_path):
    """Few volumes with many rows: what is joined with their figures stays where it is, with the results of the SQL."""
    rows = spark.range(20_000).selectExpr("id AS l_orderkey", "CAST(id % 7 AS INT) AS l_linenumber", "TIMESTAMP '2020-01-01' AS l_shipdate", "IF(id % 2 = 0, 'F', 'O') AS l_linestatus", "CAST(id AS DOUBLE) AS l_extendedprice")
    rows.coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    df = queries.QUERIES["feature_normalise"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    duckdb.sql(f"CREATE OR REPLACE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert sorted(map(tuple, df.collect())) == sorted(duckdb.sql(queries.SQL["feature_normalise"]).fetchall())
