"""DICOM bytes: nested elements read and written, derived series of moved volumes, and objects that hold a registration.

Only what is needed of the format: explicit little-endian files with uncompressed 16-bit pixels. Unique identifiers are made of a
hash of what they identify, so a task that runs twice writes the same file.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Grid, Grids, grid_from, with_grid
from ..operators.planes import _cells
from ..operators.transforms import inverted
from ..shared import bound_batches
from .series import stored

SYNTAX = "1.2.840.10008.1.2.1"
#: Class of objects that hold a registration, and of a study, by which one is referred to.
REGISTRATION, STUDY, CT_IMAGE = "1.2.840.10008.5.1.4.1.1.66.1", "1.2.840.10008.3.1.2.3.1", "1.2.840.10008.5.1.4.1.1.2"
LONG = {b"OB", b"OW", b"OF", b"OD", b"OL", b"SQ", b"UN", b"UT", b"UC", b"UR"}
_ITEM, _ITEM_END, _SEQUENCE_END = (0xFFFE, 0xE000), (0xFFFE, 0xE00D), (0xFFFE, 0xE0DD)
#: Tags of a template that do not hold for other pixels: window, least and largest value, pixels.
DROPPED = {(0x0028, 0x1050), (0x0028, 0x1051), (0x0028, 0x0106), (0x0028, 0x0107), (0x7FE0, 0x0010)}
#: Tags of patient and study that a registration takes from the fixed series.
IDENTITY = ((0x0010, 0x0010), (0x0010, 0x0020), (0x0010, 0x0030), (0x0010, 0x0040), (0x0020, 0x000D), (0x0020, 0x0010), (0x0008, 0x0050), (0x0008, 0x0090))

Element = tuple[str, "bytes | list[dict]"]


def parsed(content: bytes) -> dict[tuple[int, int], Element]:
    """(representation, value) by tag; the value of a sequence is a list of such dictionaries. Pixels in fragments are refused."""
    if content[128:132] != b"DICM":
        raise ValueError("not a DICOM file")
    found, _ = _elements(content, 132, len(content))
    syntax = found.get((0x0002, 0x0010), ("UI", SYNTAX.encode()))[1].rstrip(b"\0 ").decode()
    if syntax != SYNTAX:
        raise ValueError(f"unsupported transfer syntax {syntax}")
    return found


def _elements(raw: bytes, at: int, end: int) -> tuple[dict, int]:
    """Elements from a place to an end, or to the end of an item of unknown length."""
    out: dict = {}
    while at + 8 <= end:
        tag = struct.unpack_from("<2H", raw, at)
        if tag == _ITEM_END:
            return out, at + 8
        vr = raw[at + 4 : at + 6]
        size, head = (struct.unpack_from("<I", raw, at + 8)[0], 12) if vr in LONG else (struct.unpack_from("<H", raw, at + 6)[0], 8)
        at += head
        if vr == b"SQ" or vr == b"UN" and size == 0xFFFFFFFF:
            value, at = _items(raw, at, end if size == 0xFFFFFFFF else at + size)
            out[tag] = ("SQ", value)
            continue
        if size == 0xFFFFFFFF:
            raise ValueError("compressed pixels are not supported")
        out[tag] = (vr.decode("latin-1"), raw[at : at + size])
        at += size
    return out, at


def _items(raw: bytes, at: int, end: int) -> tuple[list[dict], int]:
    out = []
    while at + 8 <= end:
        group, element, size = struct.unpack_from("<2HI", raw, at)
        at += 8
        if (group, element) == _SEQUENCE_END:
            return out, at
        if (group, element) != _ITEM:
            raise ValueError("a sequence holds something that is no item")
        item, after = _elements(raw, at, end if size == 0xFFFFFFFF else at + size)
        out.append(item)
        at = after
    return out, at


def text(vr: str, *values: object) -> Element:
    return vr, "\\".join(str(v) for v in values).encode("latin-1", "replace")


def short(value: int) -> Element:
    return "US", struct.pack("<H", value)


def encoded(elements: dict[tuple[int, int], Element]) -> bytes:
    """Elements in order of their tags; sequences and items have their lengths."""
    out = []
    for tag in sorted(elements):
        vr, value = elements[tag]
        if vr == "SQ":
            items = [encoded(i) for i in value]
            value = b"".join(struct.pack("<2HI", *_ITEM, len(i)) + i for i in items)
        value = value + (b"\0" if vr in ("UI", "OB", "UN") else b" ") * (len(value) % 2)
        head = vr.encode()
        out.append(struct.pack("<2H", *tag) + (head + b"\0\0" + struct.pack("<I", len(value)) if head in LONG else head + struct.pack("<H", len(value))) + value)
    return b"".join(out)


def file_of(elements: dict[tuple[int, int], Element]) -> bytes:
    """A whole file; the elements of group 2 are made here."""
    body = {t: e for t, e in elements.items() if t[0] > 2 and t[1] != 0}
    meta = encoded({(2, 1): ("OB", b"\0\1"), (2, 2): body[0x0008, 0x0016], (2, 3): body[0x0008, 0x0018], (2, 0x10): text("UI", SYNTAX), (2, 0x12): text("UI", uid("stratavox"))})
    return bytes(128) + b"DICM" + encoded({(2, 0): ("UL", struct.pack("<I", len(meta)))}) + meta + encoded(body)


def uid(*parts: object) -> str:
    """A unique identifier for these parts, below the root for those made of random or hashed numbers of 128 bits."""
    return f"2.25.{int.from_bytes(hashlib.sha256('/'.join(map(str, parts)).encode()).digest()[:16], 'big')}"


def value_of(elements: dict[tuple[int, int], Element], tag: tuple[int, int]) -> str:
    return elements[tag][1].decode("latin-1").strip("\0 ") if tag in elements else ""


def derived_file(template: bytes, grid: Grid, z: int, pixels: np.ndarray, slope: float, intercept: float, key: str, frame: str | None, suffix: str) -> bytes:
    """One slice of a derived series: the template's tags with the geometry of the grid, new identifiers and these stored values."""
    e = {t: v for t, v in parsed(template).items() if t not in DROPPED and t[0] > 2}
    d = np.array(grid.direction).reshape(3, 3)
    place = np.array(grid.origin) + d[:, 2] * grid.spacing[2] * z
    six = lambda v: [f"{x:.6f}" for x in v]
    number = value_of(e, (0x0020, 0x0011))
    e |= {
        (0x0008, 0x0008): text("CS", "DERIVED", "SECONDARY", "REGISTERED"), (0x0008, 0x0016): e.get((0x0008, 0x0016), text("UI", CT_IMAGE)), (0x0008, 0x0018): text("UI", uid(key, "instance", z)), (0x0020, 0x000E): text("UI", uid(key, "series")),
        (0x0020, 0x000D): e.get((0x0020, 0x000D), text("UI", uid(key, "study"))), (0x0020, 0x0052): text("UI", frame or value_of(e, (0x0020, 0x0052)) or uid(key, "frame")), (0x0020, 0x0011): text("IS", (int(number) if number.lstrip("-").isdigit() else 1) + 9000),
        (0x0020, 0x0013): text("IS", z + 1), (0x0008, 0x103E): text("LO", f"{value_of(e, (0x0008, 0x103E)) or 'series'} - {suffix}"[:64]), (0x0008, 0x2111): text("ST", "Resampled by research software, not a medical device"),
        (0x0020, 0x0032): text("DS", *six(place)), (0x0020, 0x0037): text("DS", *[f"{x:.9f}" for x in [*d[:, 0], *d[:, 1]]]), (0x0020, 0x1041): text("DS", f"{float(place @ d[:, 2]):.6f}"),
        (0x0028, 0x0030): text("DS", *six([grid.spacing[1], grid.spacing[0]])), (0x0018, 0x0050): text("DS", *six([grid.spacing[2]])), (0x0018, 0x0088): text("DS", *six([grid.spacing[2]])), (0x0028, 0x0002): short(1), (0x0028, 0x0004): text("CS", "MONOCHROME2"),
        (0x0028, 0x0010): short(grid.size[1]), (0x0028, 0x0011): short(grid.size[0]), (0x0028, 0x0100): short(16), (0x0028, 0x0101): short(16), (0x0028, 0x0102): short(15), (0x0028, 0x0103): short(1),
        (0x0028, 0x1053): text("DS", f"{slope:.9g}"), (0x0028, 0x1052): text("DS", f"{intercept:.9g}"), (0x7FE0, 0x0010): ("OW", pixels.astype("<i2").tobytes()),
    }
    return file_of(e)


def derived_series(voxels: DataFrame, grids: Grid | Grids, templates: DataFrame, by: str = "case_id", suffix: str = "registered") -> DataFrame:
    """name and content of a DICOM file for each plane of each volume, for ``file_rows``.

    voxels: by, z, y, x, v; templates: by, template (a file of the series that the values come from), frame (the identifier of the
    frame of reference that the volume is in now, or NULL). Values are stored as whole numbers of each volume's own slope.
    """
    bound_batches(voxels.sparkSession)
    rows = stored(voxels.select(by, "z", "y", "x", "v"), [by])
    planes = rows.groupBy(by, F.col("z").cast("int").alias("z"), "slope", "intercept").agg(F.collect_list(F.struct("y", "x", F.col("stored").alias("v"))).alias("_cells"))
    planes, _ = with_grid(planes, grids)
    planes = planes.join(templates.select(by, "template", "frame"), by)

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {c: batch.column(c).to_pylist() for c in (by, "z", "slope", "intercept", "_grid", "template", "frame")}
            for i in range(batch.num_rows):
                g, c = grid_from(cols["_grid"][i]), _cells(batch.column("_cells"), i)
                a = np.zeros((g.size[1], g.size[0]), np.int16)
                a[c["y"].to_numpy(zero_copy_only=False), c["x"].to_numpy(zero_copy_only=False)] = c["v"].to_numpy(zero_copy_only=False)
                z, key = cols["z"][i], cols[by][i]
                made = derived_file(cols["template"][i], g, z, a, cols["slope"][i], cols["intercept"][i], f"{key}/{suffix}", cols["frame"][i], suffix)
                yield pa.RecordBatch.from_arrays([pa.array([f"{key}/{z + 1:05d}.dcm"]), pa.array([made], pa.binary())], names=["name", "content"])

    return planes.mapInArrow(files, "name string, content binary")


def registration_type(m: np.ndarray, tolerance: float = 1e-3) -> str:
    """RIGID, RIGID_SCALE (one scale for all axes) or AFFINE."""
    a = m[:3, :3]
    scale = np.cbrt(abs(np.linalg.det(a)))
    if scale == 0 or np.linalg.det(a) < 0 or np.abs(a.T @ a / scale**2 - np.eye(3)).max() > tolerance:
        return "AFFINE"
    return "RIGID" if abs(scale - 1) <= tolerance else "RIGID_SCALE"


def registration_file(matrix: Sequence[float], fixed: bytes, moving: bytes, key: str, label: str = "stratavox") -> bytes:
    """An object that says how the moving series' frame of reference is brought into the fixed one's. matrix goes from fixed to
    moving, as everywhere here; the object holds its inverse, which takes a moving point to its fixed one."""
    m = inverted(np.array(matrix, float).reshape(4, 4))
    sides = [parsed(fixed), parsed(moving)]

    def item(e: dict, kind: str, values: np.ndarray) -> dict:
        image = {(0x0008, 0x1150): e.get((0x0008, 0x0016), text("UI", CT_IMAGE)), (0x0008, 0x1155): e.get((0x0008, 0x0018), text("UI", uid(key, "image")))}
        one = {(0x0070, 0x030C): text("CS", kind), (0x3006, 0x00C6): text("DS", *[f"{v:.10g}" for v in values.ravel()])}
        return {(0x0020, 0x0052): e.get((0x0020, 0x0052), text("UI", uid(key, "frame", kind))), (0x0008, 0x1140): ("SQ", [image]), (0x0070, 0x0309): ("SQ", [{(0x0070, 0x030A): ("SQ", [one])}])}

    e: dict = {t: sides[0][t] for t in IDENTITY if t in sides[0]}
    e |= {
        (0x0008, 0x0016): text("UI", REGISTRATION), (0x0008, 0x0018): text("UI", uid(key, "registration")), (0x0008, 0x0060): text("CS", "REG"), (0x0020, 0x000E): text("UI", uid(key, "registrations")), (0x0020, 0x0011): text("IS", 9900), (0x0020, 0x0013): text("IS", 1),
        (0x0008, 0x103E): text("LO", f"{label} spatial registration"[:64]), (0x0070, 0x0080): text("CS", label[:16].upper().replace(" ", "_")), (0x0070, 0x0081): text("LO", "Registration by research software"), (0x0020, 0x0052): sides[0].get((0x0020, 0x0052), text("UI", uid(key, "frame"))),
        (0x0070, 0x0308): ("SQ", [item(sides[0], "RIGID", np.eye(4)), item(sides[1], registration_type(m), m)]),
    }
    return file_of(e)


def registrations(transforms: DataFrame, templates: DataFrame, by: str = "case_id") -> DataFrame:
    """name and content of an object for each case. transforms: by, matrix; templates: by, fixed, moving (a file of either series)."""
    rows = transforms.select(by, "matrix").join(templates.select(by, "fixed", "moving"), by)

    def files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [registration_file(m, bytes(f), bytes(v), str(k)) for k, m, f, v in zip(batch[by], batch["matrix"], batch["fixed"], batch["moving"], strict=True)]
            yield pd.DataFrame({"name": [f"{k}/registration.dcm" for k in batch[by]], "content": made}, dtype=object)

    return rows.mapInPandas(files, "name string, content binary")


def read_registration(content: bytes) -> tuple[str, np.ndarray]:
    """(type, matrix from fixed to moving) of such an object: the inverse of its last one."""
    item = parsed(content)[0x0070, 0x0308][1][-1]
    one = item[0x0070, 0x0309][1][0][0x0070, 0x030A][1][0]
    values = [float(v) for v in value_of(one, (0x3006, 0x00C6)).split("\\")]
    return value_of(one, (0x0070, 0x030C)), inverted(np.array(values).reshape(4, 4))
