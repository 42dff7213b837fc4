"""Files of volumes and their companions: NIfTI and uncompressed DICOM, landmarks, case lists, label names and parameter files.

Files are read whole by Spark (``binaryFile`` or ``text``), so any store that Spark reaches will do, and decoded in Arrow batches.
"""

from __future__ import annotations

import gzip
import json
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import canonical
from ..model import Grid
from ..operators.overlap import first_come
from ..operators.resample import resampled
from ..shared import bound_batches

HEADER = "path string, size array<int>, spacing array<double>, origin array<double>, direction array<double>"
VOLUME = "path string, z int, y int, x int, v double"
# Codes of NIfTI-1 data types.
NIFTI_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}
# DICOM tags that describe a series, by name.
TAGS = {"modality": (0x0008, 0x0060), "description": (0x0008, 0x103E), "series_uid": (0x0020, 0x000E), "study_uid": (0x0020, 0x000D), "patient_id": (0x0010, 0x0020), "slice_thickness": (0x0018, 0x0050), "tilt_deg": (0x0018, 0x1120), "position": (0x0020, 0x0032), "orientation": (0x0020, 0x0037), "rows": (0x0028, 0x0010), "columns": (0x0028, 0x0011), "pixel_spacing": (0x0028, 0x0030), "slope": (0x0028, 0x1053), "intercept": (0x0028, 0x1052), "signed": (0x0028, 0x0103), "date": (0x0008, 0x0022)}


def decode_nifti(content: bytes) -> tuple[np.ndarray, Grid]:
    """Values (z, y, x) and the grid in LPS; of a 4-D file the first time point."""
    raw = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
    order = "<" if struct.unpack("<i", raw[:4])[0] == 348 else ">"
    if struct.unpack(order + "i", raw[:4])[0] != 348:
        raise ValueError("not a NIfTI-1 file")
    dim = struct.unpack(order + "8h", raw[40:56])
    code = struct.unpack(order + "h", raw[70:72])[0]
    if code not in NIFTI_TYPES or dim[0] < 3:
        raise ValueError(f"unsupported NIfTI data type {code} or {dim[0]} dimensions")
    size = tuple(int(n) for n in dim[1:4])
    start, slope, inter = (int(struct.unpack(order + "f", raw[108:112])[0]), *struct.unpack(order + "2f", raw[112:120]))
    values = np.frombuffer(raw, order + NIFTI_TYPES[code], int(np.prod(size)), start).reshape(size[::-1]).astype(float)
    values = values * slope + inter if slope not in (0.0, 1.0) or inter else values
    pix = struct.unpack(order + "8f", raw[76:108])
    if struct.unpack(order + "h", raw[254:256])[0] > 0:
        m = np.array(struct.unpack(order + "12f", raw[280:328])).reshape(3, 4)
    else:
        b, c, d = struct.unpack(order + "3f", raw[256:268])
        a = max(0.0, 1 - b * b - c * c - d * d) ** 0.5
        r = np.array([[a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)], [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)], [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c]])
        r[:, 2] *= -1 if pix[0] < 0 else 1
        m = np.column_stack([r * pix[1:4], struct.unpack(order + "3f", raw[268:280])])
    m = np.diag([-1.0, -1.0, 1.0]) @ m
    spacing = np.linalg.norm(m[:, :3], axis=0)
    return values, Grid(size, tuple(map(float, spacing)), tuple(map(float, m[:, 3])), tuple(map(float, (m[:, :3] / spacing).ravel())))


def encode_nifti(values: np.ndarray, grid: Grid, compress: bool = True) -> bytes:
    head = bytearray(352)
    code = {"u1": 2, "i2": 4, "f8": 64}.get(values.dtype.str[1:], 16)
    data = values.astype("<" + NIFTI_TYPES[code])
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 3, *grid.size, 1, 1, 1, 1)
    struct.pack_into("<2h", head, 70, code, data.itemsize * 8)
    struct.pack_into("<8f", head, 76, 1.0, *grid.spacing, 1, 1, 1, 1)
    struct.pack_into("<3f", head, 108, 352.0, 1.0, 0.0)
    struct.pack_into("<2h", head, 252, 0, 1)
    struct.pack_into("<12f", head, 280, *(np.diag([-1.0, -1.0, 1.0]) @ grid.matrix[:3]).ravel())
    head[344:348] = b"n+1\x00"
    raw = bytes(head) + data.tobytes()
    return gzip.compress(raw, mtime=0) if compress else raw


def read_nifti(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(headers, voxels) of all NIfTI files under a path."""
    bound_batches(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.nii*").load(path).select("path", "content")

    def headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            grids = [decode_nifti(c)[1] for c in batch["content"]]
            yield pd.DataFrame({"path": batch["path"], "size": [list(g.size) for g in grids], "spacing": [list(g.spacing) for g in grids], "origin": [list(g.origin) for g in grids], "direction": [list(g.direction) for g in grids]})

    def voxels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, c in zip(batch["path"], batch["content"], strict=True):
                values, _ = decode_nifti(c)
                for k, plane in enumerate(values):
                    y, x = (i.ravel() for i in np.indices(plane.shape, dtype=np.int32))
                    yield pd.DataFrame({"path": p, "z": np.int32(k), "y": y, "x": x, "v": plane.ravel()})

    return files.mapInPandas(headers, HEADER), files.mapInPandas(voxels, VOLUME)


def nifti_files(voxels: DataFrame, by: str, grid: Grid, value: str = "v") -> DataFrame:
    """by, content: a compressed NIfTI file for each volume, to be stored with any writer for binary rows."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros(tuple(reversed(grid.size)), np.float32)
        a[pdf["z"], pdf["y"], pdf["x"]] = pdf[value]
        return pd.DataFrame({by: [pdf[by].iloc[0]], "content": [encode_nifti(a, grid)]})

    return voxels.groupBy(by).applyInPandas(one, f"{by} {voxels.schema[by].dataType.simpleString()}, content binary")


def dicom_elements(content: bytes) -> dict[tuple[int, int], bytes]:
    """Top-level elements of an explicit little-endian file; sequences are passed over, compressed pixels are refused."""
    if content[128:132] != b"DICM":
        raise ValueError("not a DICOM file")
    at, out = 132, {}
    long_form = {b"OB", b"OW", b"OF", b"OD", b"OL", b"SQ", b"UN", b"UT", b"UC", b"UR"}
    while at + 8 <= len(content):
        tag, kind = struct.unpack("<2H", content[at : at + 4]), content[at + 4 : at + 6]
        if kind in long_form:
            size, head = struct.unpack("<I", content[at + 8 : at + 12])[0], 12
        else:
            size, head = struct.unpack("<H", content[at + 6 : at + 8])[0], 8
        if size == 0xFFFFFFFF:
            if tag == (0x7FE0, 0x0010):
                raise ValueError("compressed pixels are not supported")
            end = content.find(b"\xfe\xff\xdd\xe0\x00\x00\x00\x00", at)
            if end < 0:
                raise ValueError("a sequence has no end")
            at = end + 8
            continue
        out[tag] = content[at + head : at + head + size]
        at += head + size
    syntax = out.get((0x0002, 0x0010), b"1.2.840.10008.1.2.1").rstrip(b"\x00 ")
    if syntax != b"1.2.840.10008.1.2.1":
        raise ValueError(f"unsupported transfer syntax {syntax.decode()}")
    return out


def _dicom_row(path: str, content: bytes) -> dict[str, object]:
    e = dicom_elements(content)
    short = {"rows", "columns", "signed"}
    read = lambda n, t: (None if t not in e else struct.unpack("<H", e[t][:2])[0] if n in short else e[t].decode("latin-1").strip("\x00 "))
    return {"path": path} | {n: (None if (v := read(n, t)) is None else str(v)) for n, t in TAGS.items()}


def dicom_headers(spark: SparkSession, path: str) -> DataFrame:
    """path and the tags of every DICOM file under a path, as text; files that are not DICOM are left out."""
    bound_batches(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [_dicom_row(p, c) for p, c in zip(batch["path"], batch["content"], strict=True) if bytes(c[128:132]) == b"DICM"]
            yield pd.DataFrame(rows, columns=["path", *TAGS])

    return files.mapInPandas(parsed, "path string, " + ", ".join(f"{n} string" for n in TAGS))


def dicom_slices(content: bytes) -> tuple[np.ndarray, float]:
    """Values of one slice by its slope and intercept, and its position along the slice normal."""
    e = dicom_elements(content)
    number = lambda n, default: float(e[TAGS[n]].decode().strip("\x00 ")) if TAGS[n] in e else default
    rows, columns = (struct.unpack("<H", e[TAGS[n]][:2])[0] for n in ("rows", "columns"))
    kind = "<i2" if struct.unpack("<H", e.get(TAGS["signed"], b"\x00\x00")[:2])[0] else "<u2"
    values = np.frombuffer(e[0x7FE0, 0x0010], kind, rows * columns).reshape(rows, columns) * number("slope", 1.0) + number("intercept", 0.0)
    o = [float(v) for v in e[TAGS["orientation"]].decode().strip("\x00 ").split("\\")]
    p = [float(v) for v in e[TAGS["position"]].decode().strip("\x00 ").split("\\")]
    return values, float(np.dot(np.cross(o[:3], o[3:]), p))


def read_landmarks(spark: SparkSession, path: str) -> DataFrame:
    """path, idx, x, y, z: the first three numbers of every line, split at spaces, commas or semicolons; ``#`` starts a comment.

    A first line ``point`` or ``index`` and the number after it are left out. A line with fewer numbers is an error.
    """
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.split("value", r"\r?\n").alias("l"))
    lines = F.filter(F.transform("l", lambda x: F.trim(F.regexp_replace(x, "#.*", ""))), lambda x: x != "")
    rows = rows.select("path", lines.alias("l"))
    head = F.lower(F.get("l", F.lit(0))).isin("point", "index")
    rows = rows.select("path", F.posexplode(F.when(head, F.slice("l", 3, 1 << 30)).otherwise(F.col("l"))).alias("idx", "line"))
    parts = F.split("line", r"[\s,;]+")
    number = lambda i: F.coalesce(F.get(parts, F.lit(i)).try_cast("double"), F.raise_error(F.concat(F.lit("not a landmark: "), F.col("line"))).cast("double"))
    return rows.select("path", "idx", number(0).alias("x"), number(1).alias("y"), number(2).alias("z"))


def landmark_lines(points: DataFrame, header: bool = False) -> DataFrame:
    """One text row of all points (idx, x, y, z) of a case, in order, with six digits."""
    line = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", F.format_string("%.6f %.6f %.6f", "x", "y", "z").alias("t")))), lambda p: p["t"]), "\n")
    text = F.concat(F.lit("point\n"), F.count("*").cast("string"), F.lit("\n"), line) if header else line
    return points.groupBy("case_id").agg(text.alias("value"))


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """A list of pairs: fixed and moving are required; name defaults to case and the row's number of four digits."""
    rows = spark.read.csv(path, header=True)
    rows = rows.withColumnsRenamed({c: c.strip().lstrip("﻿") for c in rows.columns})
    if missing := {"fixed", "moving"} - set(rows.columns):
        raise ValueError(f"missing columns: {sorted(missing)}")
    for c in ("name", "fixed_mask", "moving_mask"):
        rows = rows if c in rows.columns else rows.withColumn(c, F.lit(None).cast("string"))
    # File order numbers the rows; ids grow with it.
    from pyspark.sql import Window

    number = F.row_number().over(Window.orderBy(F.monotonically_increasing_id()))
    safe = F.regexp_replace(F.trim("name"), r"[^A-Za-z0-9._-]+|\.\.+", "_")
    return rows.withColumn("case_id", number.cast("long")).withColumn("name", F.coalesce(F.nullif(safe, F.lit("")), F.format_string("case%04d", "case_id")))


def label_names(text: str) -> dict[int, str]:
    """Names by label from JSON, or from lines of a number and a name."""
    try:
        return {int(k): str(v) for k, v in json.loads(text).items()}
    except (ValueError, AttributeError):
        pairs = (line.replace(",", " ").replace(":", " ").split(None, 1) for line in text.splitlines() if line.strip() and not line.lstrip().startswith("#"))
        return {int(a[0]): a[1].strip() for a in pairs if len(a) == 2 and a[0].isdigit()}


def external_labels(spark: SparkSession, volume_id: int, labelmap: str | None = None, mask: str | None = None, directory: str | None = None, label_names_: dict[int, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(labels, names) of one volume from a label map, else a mask, else a directory with a mask for each organ.

    A label map takes its names from the argument, else from ``<file>.labels.json`` beside it, else they are label_N, as numbers
    mean nothing by themselves. A mask is every value above 0, named target. In a directory the file names are the organs, in their
    order, and the first file has a voxel; masks on another grid than the first file's are resampled to it by nearest neighbour.
    """
    if not (labelmap or mask or directory):
        raise ValueError("a label map, a mask or a directory is needed")
    keep = [F.lit(volume_id).cast("long").alias("volume_id"), "z", "y", "x", "label"]
    if labelmap:
        labels = read_nifti(spark, labelmap)[1].where("v <> 0").withColumn("label", F.col("v").cast("int")).select(*keep)
        if label_names_ is None:
            folder, _, name = labelmap.rpartition("/")
            beside = spark.read.format("binaryFile").option("pathGlobFilter", f"{name}.labels.json").load(folder or ".").select("content").first()
            label_names_ = label_names(bytes(beside["content"]).decode("utf-8")) if beside else None
        if label_names_ is None:
            found = labels.select("volume_id", "label").distinct()
            return labels, found.withColumn("organ", F.concat(F.lit("label_"), F.col("label").cast("string")))
    elif mask:
        labels = read_nifti(spark, mask)[1].where("v > 0").withColumn("label", F.lit(1)).select(*keep)
        label_names_ = label_names_ or {1: "target"}
    else:
        headers, voxels = read_nifti(spark, directory)
        heads = sorted(headers.collect(), key=lambda r: r["path"])  # one small row an organ
        if not heads:
            raise ValueError(f"no masks in {directory}")
        grids = {r["path"]: Grid(*[tuple(r[c]) for c in ("size", "spacing", "origin", "direction")]) for r in heads}
        first = grids[heads[0]["path"]]
        voxels = voxels.withColumn("v", (F.col("v") > 0).cast("double"))
        odd = [p for p, g in grids.items() if not g.same_as(first)]
        parts = voxels.where(~F.col("path").isin(*odd)) if odd else voxels
        for p in odd:
            own = voxels.where(F.col("path") == p)
            parts = parts.unionByName(resampled(own, spark.createDataFrame([(p,)], "path string"), ["path"], first, grids[p], None, "nearest", 0.0))
        numbers = spark.createDataFrame([(r["path"], k) for k, r in enumerate(heads, 1)], "path string, label int")
        labels = first_come(parts.where("v > 0").join(F.broadcast(numbers), "path").select(*keep))
        named = numbers.select("label", canonical(F.element_at(F.split("path", "/"), -1)).alias("organ"))
        return labels, named.select(F.lit(volume_id).cast("long").alias("volume_id"), "label", "organ")
    return labels, spark.createDataFrame([(volume_id, k, v) for k, v in sorted(label_names_.items())], "volume_id long, label int, organ string")


def parse_parameters(text: str) -> dict[str, tuple[str, ...]]:
    """A parameter file of lines ``(Key value ...)``; ``//`` starts a comment, quotes keep spaces."""
    import shlex

    out = {}
    for line in text.splitlines():
        line = line.split("//")[0].strip()
        if line.startswith("(") and line.endswith(")"):
            key, *values = shlex.split(line[1:-1])
            out[key] = tuple(values)
    return out


def write_parameters(values: dict[str, tuple[str, ...]]) -> str:
    """Sorted keys; numbers bare, everything else quoted."""

    def shown(v: str) -> str:
        try:
            float(v)
        except ValueError:
            return f'"{v.lower() if v.lower() in ("true", "false") else v}"'
        return v

    return "".join(f"({k} {' '.join(map(shown, v))})\n" for k, v in sorted(values.items()))
