"""Volumes as a data source, files with a commit, and series of slices made into volumes."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratavox.model import Grid, grid_from
from stratavox.operators import transforms as tf
from stratavox.sources import dicom, files, series, volumes
from test_core import array, voxels

TURN = tuple(tf.rotation((0, 0, 30)).ravel().tolist())


def test_formats_round_trip_through_the_source(spark, tmp_path):
    volumes.register(spark)
    grid = Grid((6, 5, 9), (0.7, 0.8, 2.5), (-10.0, 20.0, 5.0), TURN)
    a = np.random.default_rng(0).normal(size=(9, 5, 6)).astype("<f4")
    whole = np.random.default_rng(1).integers(-500, 500, (9, 5, 6)).astype("<i2")
    (tmp_path / "sub").mkdir()
    made = {"a.nii.gz": files.encode_nifti(a, grid), "b.nii": files.encode_nifti(a, grid, False), "sub/c.mha": volumes.encode_meta(whole, grid), "d.mha": volumes.encode_meta(a, grid, True), "e.nrrd": volumes.encode_nrrd(a, grid), "f.nrrd": volumes.encode_nrrd(whole.astype("<f8"), grid, True)}
    for name, content in made.items():
        (tmp_path / name).write_bytes(content)
    head, _, data = volumes.encode_meta(whole, grid).partition(b"ElementDataFile = LOCAL\n")
    (tmp_path / "g.mhd").write_bytes(head + b"ElementDataFile = g.raw\n")
    (tmp_path / "g.raw").write_bytes(data)
    (tmp_path / "note.txt").write_text("no")
    path = str(tmp_path)
    df = spark.read.format("volume").option("planes", 2).load(path)
    grids = {r["path"].removeprefix(path + "/"): grid_from(r["grid"]) for r in spark.read.format("volume_grid").load(path).collect()}
    assert set(grids) == {*made, "g.mhd"} and all(g.same_as(grid, 1e-3) for g in grids.values())
    for name in grids:
        got = array(df.where(F.col("path") == f"{path}/{name}"), a.shape)
        assert np.allclose(got, whole if name in ("sub/c.mha", "f.nrrd", "g.mhd") else a, atol=1e-6), name
    some = df.where((F.col("z") >= 3) & (F.col("z") < 5)).groupBy("path", "z").count().collect()
    assert len(some) == 14 and {r["count"] for r in some} == {30} and {r["z"] for r in some} == {3, 4}


def test_filters_choose_planes_and_files(spark, tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual

    grid = Grid((4, 3, 20))
    for name in ("a.mha", "b.mha"):
        (tmp_path / name).write_bytes(volumes.encode_meta(np.zeros((20, 3, 4), "<f4"), grid))
    reader = volumes.VolumeReader({"path": str(tmp_path), "planes": "4"})
    left = list(reader.pushFilters([GreaterThan(("z",), 5), LessThanOrEqual(("z",), 11), In(("path",), (f"{tmp_path}/b.mha", "x")), EqualTo(("v",), 1.0)]))
    assert [f.attribute for f in left] == [("v",)]
    assert [(s.path[-5:], s.low, s.high) for s in reader.partitions()] == [("b.mha", 6, 10), ("b.mha", 10, 12)]
    assert volumes.VolumeReader({"path": str(tmp_path), "planes": "4"}).partitions()[-1].high == 20
    volumes.register(spark)
    plan = spark.read.format("volume").load(str(tmp_path)).where("z = 7")._jdf.queryExecution().toString()
    assert "Filter " not in plan.split("== Physical Plan ==")[1]  # all of it is left to the reader
    with pytest.raises(ValueError):
        volumes.meta_header(b"NDims = 4\nDimSize = 1 1 1 1\nElementType = MET_FLOAT\nElementDataFile = LOCAL\n", "x")
    with pytest.raises(ValueError):
        volumes.nrrd_header(b"NRRD0004\ntype: block\ndimension: 3\nsizes: 1 1 1\n\n", "x")
    ras = volumes.nrrd_header(b"NRRD0004\ntype: float\ndimension: 3\nspace: right-anterior-superior\nsizes: 4 3 2\nspace directions: (2,0,0) (0,3,0) (0,0,4)\nspace origin: (1,2,3)\n\n", "x").grid
    assert ras.origin == (-1, -2, 3) and ras.spacing == (2, 3, 4) and ras.orientation() == "RAS"


def test_segmentations_are_written_together_or_not_at_all(spark, tmp_path):
    volumes.register(spark)
    grid = Grid((5, 4, 3), (1.0, 2.0, 3.0))
    labels = spark.createDataFrame([(7, 0, 1, 2, 1), (7, 2, 3, 4, 2), (8, 1, 1, 1, 2)], "volume_id long, z int, y int, x int, label int")
    names = spark.createDataFrame([(7, 1, "liver"), (7, 2, "spleen"), (8, 2, "spleen")], "volume_id long, label int, organ string")
    grids = spark.createDataFrame([(7,), (8,)], "volume_id long").withColumn("grid", grid.column())
    rows = volumes.segmentation_files(labels, names, grids)
    out = str(tmp_path / "out")
    rows.write.format("file_rows").mode("append").save(out)
    found = sorted(p.relative_to(out).as_posix() for p in (tmp_path / "out").rglob("*") if p.is_file())
    assert found == ["labels/7.nii.gz", "labels/7.nii.gz.labels.json", "labels/8.nii.gz", "labels/8.nii.gz.labels.json", "masks/7/liver.nii.gz", "masks/7/spleen.nii.gz", "masks/8/spleen.nii.gz"]
    assert not list((tmp_path / "out").glob("_staging*")) and json.loads((tmp_path / "out/labels/7.nii.gz.labels.json").read_text()) == {"1": "liver", "2": "spleen"}
    back, named = files.external_labels(spark, 7, labelmap=f"{out}/labels/7.nii.gz")
    assert {tuple(r) for r in back.collect()} == {(7, 0, 1, 2, 1), (7, 2, 3, 4, 2)} and {r["organ"] for r in named.collect()} == {"liver", "spleen"}
    values, g = files.decode_nifti((tmp_path / "out/masks/8/spleen.nii.gz").read_bytes())
    assert g.same_as(grid) and np.argwhere(values).tolist() == [[1, 1, 1]]
    for bad in (rows, rows.select("name", F.when(F.col("name").contains("masks/7"), F.raise_error(F.lit("killed")).cast("binary")).otherwise(F.col("content")).alias("content")), spark.createDataFrame([("../x", b"1")], "name string, content binary")):
        with pytest.raises(Exception):  # noqa: B017 names that are there, a task that fails, a name outside
            bad.write.format("file_rows").mode("append").save(out if bad is rows else str(tmp_path / "none"))
    assert [p for p in (tmp_path / "none").rglob("*") if p.is_file()] == [] if (tmp_path / "none").exists() else True
    assert sorted(p.relative_to(out).as_posix() for p in (tmp_path / "out").rglob("*") if p.is_file()) == found


def slice_file(uid, position, values, orientation="1\\0\\0\\0\\1\\0", spacing="0.5\\0.25"):
    def element(group, tag, vr, v):
        size = np.array([len(v)], "<u2").tobytes() if vr != "OW" else b"\0\0" + np.array([len(v)], "<u4").tobytes()
        return np.array([group, tag], "<u2").tobytes() + vr.encode() + size + v

    text = lambda s: (s + " " * (len(s) % 2)).encode()
    short = lambda n: np.array([n], "<u2").tobytes()
    body = element(2, 0x10, "UI", b"1.2.840.10008.1.2.1\0") + element(8, 0x60, "CS", b"CT") + element(0x20, 0xE, "UI", text(uid)) + (element(0x20, 0x32, "DS", text(position)) if position else b"") + element(0x20, 0x37, "DS", text(orientation))
    rows, columns = values.shape
    body += element(0x28, 0x10, "US", short(rows)) + element(0x28, 0x11, "US", short(columns)) + element(0x28, 0x30, "DS", text(spacing)) + element(0x28, 0x103, "US", short(1)) + element(0x28, 0x1052, "DS", b"-10 ") + element(0x28, 0x1053, "DS", b"2 ")
    return b"\0" * 128 + b"DICM" + body + element(0x7FE0, 0x10, "OW", values.astype("<i2").tobytes())


def test_series_are_made_into_volumes(spark, tmp_path):
    """Slices in no order, of one series in several folders, along an oblique normal, and series that are no volumes."""
    rng = np.random.default_rng(2)
    a = rng.integers(-100, 100, (5, 3, 4))
    turn = tf.rotation((20, 0, 0))
    o = "\\".join(f"{v:.8f}" for v in [*turn[:, 0], *turn[:, 1]])
    names = rng.permutation(5)
    for k in range(5):
        folder = tmp_path / f"f{k % 2}"
        folder.mkdir(exist_ok=True)
        p = np.array([10.0, 20, 30]) + turn[:, 2] * 2.5 * k
        (folder / f"{names[k]}.dcm").write_bytes(slice_file("1.2.1", "\\".join(f"{v:.6f}" for v in p), a[k], o))
    for k, at in enumerate((0, 1, 1)):
        (tmp_path / f"twice{k}.dcm").write_bytes(slice_file("1.2.2", f"0\\0\\{at}", a[0]))
    (tmp_path / "one.dcm").write_bytes(slice_file("1.2.3", "0\\0\\0", a[0]))
    (tmp_path / "odd0.dcm").write_bytes(slice_file("1.2.4", "0\\0\\0", a[0]))
    (tmp_path / "odd1.dcm").write_bytes(slice_file("1.2.4", "0\\0\\1", a[0][:2]))
    (tmp_path / "none0.dcm").write_bytes(slice_file("1.2.5", "", a[0]))
    (tmp_path / "none1.dcm").write_bytes(slice_file("1.2.5", "0\\0\\1", a[0]))
    geometry, voxels_ = series.read_series(spark, str(tmp_path))
    got = {r["series_uid"]: r for r in geometry.collect()}
    assert {k: list(r["problems"]) for k, r in got.items()} == {"1.2.1": [], "1.2.2": ["several slices at one place"], "1.2.3": ["fewer than two slices"], "1.2.4": ["slices of several sizes, spacings or orientations"], "1.2.5": ["a slice without position, orientation or size"]}
    g = grid_from(got["1.2.1"]["grid"])
    want = Grid((4, 3, 5), (0.25, 0.5, 2.5), (10.0, 20.0, 30.0), tuple(turn.ravel().tolist()))
    assert g.size == want.size and np.allclose(g.matrix, want.matrix, atol=1e-5)
    assert {r["series_uid"] for r in voxels_.select("series_uid").distinct().collect()} == {"1.2.1"}
    assert np.allclose(array(voxels_, a.shape), a * 2.0 - 10)
    assert all(r["grid"] is None for k, r in got.items() if k != "1.2.1")


def test_encoded_volumes_of_several_grids(spark):
    made = {"x": Grid((3, 4, 5), (1.0, 2.0, 3.0)), "y": Grid((5, 2, 2))}
    table, df, arrays = None, None, {}
    for k, g in made.items():
        arrays[k] = np.random.default_rng(len(k)).normal(size=g.size[::-1]).astype(np.float32)
        row = spark.range(1).select(F.lit(k).alias("id"), g.column().alias("grid"))
        one = voxels(spark, arrays[k]).select(F.lit(k).alias("id"), "z", "y", "x", "v")
        table, df = (row, one) if table is None else (table.unionByName(row), df.unionByName(one))
    for suffix in ("nii", "mha", "nrrd"):
        rows = {r["name"]: bytes(r["content"]) for r in volumes.encoded(df, "id", table, suffix).collect()}
        assert set(rows) == {f"x.{suffix}", f"y.{suffix}"}
        if suffix == "mha":
            stored = volumes.meta_header(rows["y.mha"], "y.mha")
            assert stored.grid.same_as(made["y"]) and np.allclose(np.frombuffer(rows["y.mha"], "<f4", -1, stored.offset), arrays["y"].ravel())


def test_derived_series_and_registrations(spark, tmp_path):
    volumes.register(spark)
    a = np.random.default_rng(3).integers(-100, 100, (4, 3, 5)).astype(float)
    grid = Grid((5, 3, 4), (0.5, 0.75, 2.0), (1.0, 2.0, 3.0), tuple(tf.rotation((10, 0, 0)).ravel().tolist()))
    nested = {(0x0008, 0x0016): dicom.text("UI", "1.2.840.10008.5.1.4.1.1.4"), (0x0008, 0x0018): dicom.text("UI", "1.2.3.4"), (0x0008, 0x0060): dicom.text("CS", "MR"), (0x0010, 0x0020): dicom.text("LO", "P1"), (0x0020, 0x0011): dicom.text("IS", 7), (0x0020, 0x0052): dicom.text("UI", "1.2.9"), (0x0028, 0x1050): dicom.text("DS", 40), (0x0008, 0x1140): ("SQ", [{(0x0008, 0x1155): dicom.text("UI", "1.2"), (0x0040, 0xA170): ("SQ", [{(8, 0x100): dicom.text("SH", "x")}, {}])}])}
    template = dicom.file_of(nested)
    assert dicom.parsed(template)[0x0008, 0x1140][1][0][0x0040, 0xA170][1][0][8, 0x100][1].strip() == b"x"
    df = voxels(spark, a, 1, "case_id").unionByName(voxels(spark, a * 0 + 3, 2, "case_id"))
    templates = spark.createDataFrame([(1, bytearray(template), "1.2.77"), (2, bytearray(template), None)], "case_id long, template binary, frame string")
    rows = dicom.derived_series(df, grid, templates)
    rows.write.format("file_rows").mode("append").save(str(tmp_path / "out"))
    geometry, back = series.read_series(spark, str(tmp_path / "out/1"))
    g = geometry.first()
    assert g["problems"] == [] and np.allclose(grid_from(g["grid"]).matrix, grid.matrix, atol=1e-5)
    assert np.abs(array(back, a.shape) - a).max() <= (a.max() - a.min()) / 32000
    assert np.allclose(array(series.read_series(spark, str(tmp_path / "out/2"))[1], a.shape), 3)
    e = dicom.parsed((tmp_path / "out/1/00002.dcm").read_bytes())
    assert dicom.value_of(e, (0x0020, 0x0011)) == "9007" and dicom.value_of(e, (0x0020, 0x0052)) == "1.2.77" and (0x0028, 0x1050) not in e and dicom.value_of(e, (0x0010, 0x0020)) == "P1" and e[0x0008, 0x1140][1][0][0x0040, 0xA170][1][1] == {}
    ids = {dicom.value_of(dicom.parsed(p.read_bytes()), (0x0008, 0x0018)) for p in (tmp_path / "out").rglob("*.dcm")}
    assert len(ids) == 8 and dicom.value_of(dicom.parsed((tmp_path / "out/2/00001.dcm").read_bytes()), (0x0020, 0x0052)) == "1.2.9"
    rigid, scaled = tf.from_parameters("rigid", [0.1, -0.2, 0.3, 1, 2, 3], (5, 5, 5)), tf.from_parameters("similarity", [0.1, 0, 0, 1, 2, 3, 1.2])
    affine = tf.from_parameters("affine", [1.1, 0.05, 0, 0, 0.9, 0.02, 0.01, 0, 1.2, 3, -4, 5])
    moves = spark.createDataFrame([(k, [float(v) for v in m.ravel()]) for k, m in enumerate((rigid, scaled, affine))], "case_id long, matrix array<double>")
    sides = spark.createDataFrame([(k, bytearray(template), bytearray(template)) for k in range(3)], "case_id long, fixed binary, moving binary")
    for r in dicom.registrations(moves, sides).collect():
        k = int(r["name"][0])
        kind, m = dicom.read_registration(bytes(r["content"]))
        assert kind == ("RIGID", "RIGID_SCALE", "AFFINE")[k] and np.allclose(m, (rigid, scaled, affine)[k], atol=1e-7)
        assert dicom.value_of(dicom.parsed(bytes(r["content"])), (0x0010, 0x0020)) == "P1"
    with pytest.raises(ValueError):
        dicom.parsed(b"x" * 200)


def test_sequences_of_unknown_length():
    inner = dicom.encoded({(8, 0x100): dicom.text("SH", "ab")})
    end, over, item = b"\xfe\xff\x0d\xe0\0\0\0\0", b"\xfe\xff\xdd\xe0\0\0\0\0", b"\xfe\xff\x00\xe0\xff\xff\xff\xff"
    raw = b"\x08\0\x40\x11SQ\0\0\xff\xff\xff\xff" + item + inner + b"\x08\0\x41\x11SQ\0\0\xff\xff\xff\xff" + item + inner + end + over + end + item + end + over + dicom.encoded({(16, 32): dicom.text("LO", "id")})
    e = dicom.parsed(b"\0" * 128 + b"DICM" + raw)
    assert [len(i) for i in e[8, 0x1140][1]] == [2, 0] and e[8, 0x1140][1][0][8, 0x1141][1][0][8, 0x100][1] == b"ab" and dicom.value_of(e, (16, 32)) == "id"


def test_jobs_end_in_one_state(spark, tmp_path):
    from stratavox.streaming import lifecycle

    (tmp_path / "in").mkdir()

    def batch(name, rows):
        (tmp_path / f"in/{name}.json").write_text("".join(json.dumps({"job_id": j, "kind": k, "at": f"2024-01-01T{t}:00Z"}) + "\n" for j, k, t in rows))
        made = lifecycle.changes(lifecycle.events(spark, str(tmp_path / "in"), "10 minutes"), 3_600_000)
        made.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(180)
        states = spark.read.parquet(str(tmp_path / "out"))
        return states, {r["job_id"]: r["status"] for r in lifecycle.latest(states).collect()}

    _, now = batch("a", [("1", "running", "08:05"), ("1", "queued", "08:00"), ("1", "queued", "08:00"), ("2", "queued", "08:10"), ("3", "queued", "08:00"), ("3", "error", "08:20"), ("3", "done", "08:30"), ("4", "running", "08:15"), ("5", "odd", "08:00")])
    assert now == {"1": "running", "2": "queued", "3": "error", "4": "running"}
    _, now = batch("b", [("1", "done", "08:40"), ("1", "running", "08:39"), ("4", "queued", "08:14"), ("3", "done", "08:45"), ("4", "running", "08:50")])
    assert now == {"1": "done", "2": "queued", "3": "error", "4": "running"}
    batch("c", [("6", "queued", "11:00")])
    states, now = batch("d", [("6", "running", "11:01")])
    assert now == {"1": "done", "2": "expired", "3": "error", "4": "expired", "6": "running"}
    assert states.where("job_id = '1'").count() == 3 and states.where("status IN ('done', 'error', 'expired')").groupBy("job_id").count().where("count > 1").count() == 0
