"""Volumes as a Spark data source, and files of rows as a sink with a commit.

``spark.read.format("volume").load(path)`` reads NIfTI, MetaImage and NRRD files, the voxels of some planes a partition, and only
those planes and files that filters on z and path leave. ``df.write.format("file_rows").mode("append").save(path)`` writes rows of a
name and a content as files, which appear all together when the job commits. Both reach what pyarrow's file systems reach; for any
other store there are ``files.read_nifti`` and Spark's own writers.
"""

from __future__ import annotations

import gzip
import posixpath
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage

from ..model import GRID, Grid
from .files import decode_nifti, encode_nifti

SUFFIXES = (".nii", ".nii.gz", ".mha", ".mhd", ".nrrd", ".nhdr")
# Element types of MetaImage and NRRD headers, as numpy names.
META_TYPES = {"MET_CHAR": "i1", "MET_UCHAR": "u1", "MET_SHORT": "i2", "MET_USHORT": "u2", "MET_INT": "i4", "MET_UINT": "u4", "MET_FLOAT": "f4", "MET_DOUBLE": "f8"}
NRRD_TYPES = {"signed char": "i1", "int8": "i1", "unsigned char": "u1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "unsigned short": "u2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "unsigned int": "u4", "uint": "u4", "uint32": "u4", "float": "f4", "double": "f8"}
#: Bytes of a header at most, and planes of a partition.
HEAD, PLANES = 1 << 16, 64


@dataclass(frozen=True)
class Stored:
    """Where and how the voxels of a volume are stored; NIfTI decodes itself and has no type here."""

    grid: Grid
    kind: str
    data: str
    offset: int
    packed: bool


def _fields(text: str, separator: str) -> dict[str, str]:
    pairs = (line.split(separator, 1) for line in text.splitlines() if separator in line and not line.startswith("#"))
    return {k.strip().lower(): v.strip() for k, v in pairs}


def _numbers(text: str) -> list[float]:
    return [float(v) for v in text.replace("(", " ").replace(")", " ").replace(",", " ").split()]


def meta_header(head: bytes, name: str) -> Stored:
    """A MetaImage header; the data follow it or are in a file beside it."""
    end = head.find(b"\n", head.find(b"ElementDataFile")) + 1
    if end < 1:
        raise ValueError(f"{name}: no ElementDataFile in the header")
    h = _fields(head[:end].decode("latin-1"), "=")
    if h.get("ndims") != "3" or h.get("elementnumberofchannels", "1") != "1":
        raise ValueError(f"{name}: not a scalar volume of three dimensions")
    size = tuple(int(v) for v in h["dimsize"].split())
    # Each of the three rows of the matrix is the direction of an axis.
    m = np.array(_numbers(h.get("transformmatrix", h.get("orientation", "1 0 0 0 1 0 0 0 1")))).reshape(3, 3).T
    grid = Grid(size, tuple(_numbers(h.get("elementspacing", "1 1 1"))), tuple(_numbers(h.get("offset", h.get("position", "0 0 0")))), tuple(m.ravel().tolist()))
    order = ">" if h.get("elementbyteordermsb", h.get("binarydatabyteordermsb", "false")).lower() == "true" else "<"
    local = h["elementdatafile"].lower() == "local"
    if h["elementtype"] not in META_TYPES:
        raise ValueError(f"{name}: unsupported type {h['elementtype']}")
    return Stored(grid, order + META_TYPES[h["elementtype"]], name if local else posixpath.join(posixpath.dirname(name), h["elementdatafile"]), end if local else int(h.get("headersize", 0)), h.get("compresseddata", "false").lower() == "true")


def nrrd_header(head: bytes, name: str) -> Stored:
    """A NRRD header, in any of its frames; positions become left-posterior-superior."""
    end = head.find(b"\n\n")
    end = end + 2 if end >= 0 else len(head)
    h = _fields(head[:end].decode("latin-1").replace("\r", "").replace(":=", "="), ":")
    if h.get("dimension") != "3":
        raise ValueError(f"{name}: not a volume of three dimensions")
    size = tuple(int(v) for v in h["sizes"].split())
    if "space directions" in h:
        m = np.array(_numbers(h["space directions"])).reshape(3, 3).T
        origin = np.array(_numbers(h.get("space origin", "(0,0,0)")))
    else:
        m, origin = np.diag(_numbers(h.get("spacings", "1 1 1"))), np.zeros(3)
    frame = h.get("space", "left-posterior-superior").lower()
    words = frame.split("-") if "-" in frame else {"ras": ["right", "anterior", "superior"], "las": ["left", "anterior", "superior"]}.get(frame, ["left", "posterior", "superior"])
    turn = np.diag([-1.0 if w in ("right", "anterior", "inferior") else 1.0 for w in words])
    m, origin = turn @ m, turn @ origin
    spacing = np.linalg.norm(m, axis=0)
    grid = Grid(size, tuple(spacing.tolist()), tuple(origin.tolist()), tuple((m / spacing).ravel().tolist()))
    if h["type"] not in NRRD_TYPES or h.get("encoding", "raw") not in ("raw", "gzip", "gz"):
        raise ValueError(f"{name}: unsupported type or encoding")
    order = ">" if h.get("endian", "little") == "big" else "<"
    beside = h.get("data file", h.get("datafile"))
    return Stored(grid, order + NRRD_TYPES[h["type"]], posixpath.join(posixpath.dirname(name), beside) if beside else name, 0 if beside else end, h.get("encoding", "raw") != "raw")


def encode_meta(values: np.ndarray, grid: Grid, compress: bool = False) -> bytes:
    """A MetaImage with its data behind the header."""
    kind = next((k for k, v in META_TYPES.items() if v == values.dtype.str[1:]), None)
    if kind is None:
        values, kind = values.astype("<f4"), "MET_FLOAT"
    data = values.astype("<" + values.dtype.str[1:]).tobytes()
    data = zlib.compress(data) if compress else data
    turn = " ".join(repr(float(v)) for v in np.array(grid.direction).reshape(3, 3).T.ravel())
    line = lambda v: " ".join(map(repr, v))
    head = f"ObjectType = Image\nNDims = 3\nBinaryData = True\nBinaryDataByteOrderMSB = False\nCompressedData = {compress}\nTransformMatrix = {turn}\nOffset = {line(grid.origin)}\nElementSpacing = {line(grid.spacing)}\nDimSize = {line(grid.size)}\nElementType = {kind}\nElementDataFile = LOCAL\n"
    return head.encode() + data


def encode_nrrd(values: np.ndarray, grid: Grid, compress: bool = False) -> bytes:
    """A NRRD with its data behind the header."""
    kind = {"i1": "int8", "u1": "uint8", "i2": "int16", "u2": "uint16", "i4": "int32", "u4": "uint32", "f4": "float", "f8": "double"}.get(values.dtype.str[1:])
    if kind is None:
        values, kind = values.astype("<f4"), "float"
    data = values.astype("<" + values.dtype.str[1:]).tobytes()
    m = (np.array(grid.direction).reshape(3, 3) * np.array(grid.spacing)).T
    vector = lambda v: "(" + ",".join(repr(float(x)) for x in v) + ")"
    head = f"NRRD0004\ntype: {kind}\ndimension: 3\nspace: left-posterior-superior\nsizes: {' '.join(map(str, grid.size))}\nspace directions: {' '.join(map(vector, m))}\nkinds: domain domain domain\nendian: little\nencoding: {'gzip' if compress else 'raw'}\nspace origin: {vector(grid.origin)}\n\n"
    return head.encode() + (gzip.compress(data, mtime=0) if compress else data)


ENCODERS = {"nii.gz": lambda v, g: encode_nifti(v, g), "nii": lambda v, g: encode_nifti(v, g, False), "mha": encode_meta, "nrrd": encode_nrrd}


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _bytes(store: fs.FileSystem, path: str, start: int = 0, size: int | None = None) -> bytes:
    with store.open_input_file(path) as f:
        f.seek(start)
        return f.read(size)


def described(store: fs.FileSystem, path: str) -> Stored:
    low = path.lower()
    if low.endswith((".nii", ".nii.gz")):
        raw = _bytes(store, path, 0, HEAD if not low.endswith(".gz") else None)
        raw = zlib.decompressobj(31).decompress(raw, HEAD) if raw[:2] == b"\x1f\x8b" else raw
        return Stored(nifti_grid(raw), "", path, 0, low.endswith(".gz"))
    return (meta_header if low.endswith((".mha", ".mhd")) else nrrd_header)(_bytes(store, path, 0, HEAD), path)


def nifti_grid(head: bytes) -> Grid:
    """The grid alone: the header decodes as a file of that size without its voxels would."""
    order = "<" if head[:4] == b"\x5c\x01\x00\x00" else ">"
    size = np.frombuffer(head, order + "i2", 3, 42)
    small = bytearray(head[:352])
    small[42:48] = np.ones(3, order + "i2").tobytes()
    small[108:112] = np.array([352], order + "f4").tobytes()
    grid = decode_nifti(bytes(small) + bytes(8))[1]
    return Grid(tuple(int(n) for n in size), grid.spacing, grid.origin, grid.direction)


def planes(store: fs.FileSystem, stored: Stored, low: int, high: int) -> np.ndarray:
    """The planes low..high - 1 of a volume; of one that is not packed only their bytes are read."""
    nx, ny, nz = stored.grid.size
    if not stored.kind:
        return decode_nifti(_bytes(store, stored.data))[0][low:high]
    kind = np.dtype(stored.kind)
    if stored.packed:
        raw = zlib.decompressobj(47).decompress(_bytes(store, stored.data, stored.offset))[low * ny * nx * kind.itemsize :]
    else:
        raw = _bytes(store, stored.data, stored.offset + low * ny * nx * kind.itemsize, (high - low) * ny * nx * kind.itemsize)
    return np.frombuffer(raw, kind, (high - low) * ny * nx).reshape(high - low, ny, nx).astype(np.float64)


@dataclass
class Slab(InputPartition):
    path: str
    low: int
    high: int


class VolumeReader(DataSourceReader):
    """Reads the files below a path; filters on z and path choose planes and files before anything is read."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.planes = options["path"], int(options.get("planes", PLANES))
        self.low, self.high, self.paths = 0, 1 << 31, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("z",):
                self.low, self.high = max(self.low, f.value), min(self.high, f.value + 1)
            elif isinstance(f, GreaterThan | GreaterThanOrEqual) and f.attribute == ("z",):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            elif isinstance(f, LessThan | LessThanOrEqual) and f.attribute == ("z",):
                self.high = min(self.high, f.value + isinstance(f, LessThanOrEqual))
            elif isinstance(f, EqualTo | In) and f.attribute == ("path",):
                some = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.paths = some if self.paths is None else self.paths & some
            elif not (isinstance(f, IsNotNull) and f.attribute[0] in ("path", "z")):  # these never are
                yield f

    def partitions(self) -> list[Slab]:
        store, top = _opened(self.path)
        info = store.get_file_info(top)
        found = [info] if info.is_file else store.get_file_info(fs.FileSelector(top, recursive=True))
        names = sorted(i.path for i in found if i.is_file and i.path.lower().endswith(SUFFIXES))
        out = []
        for name in names:
            if self.paths is None or name in self.paths:
                stored = described(store, name)
                low, high = max(0, self.low), min(stored.grid.size[2], self.high)
                step = max(1, high - low) if stored.packed else self.planes
                out += [Slab(name, at, min(at + step, high)) for at in range(low, high, step)]
        return out or [Slab("", 0, 0)]

    def read(self, slab: Slab) -> Iterator[pa.RecordBatch]:
        if not slab.path:
            return
        store, _ = _opened(self.path)
        stored = described(store, slab.path)
        nx, ny, _ = stored.grid.size
        y, x = (pa.array(i.ravel()) for i in np.indices((ny, nx), dtype=np.int32))
        for k, plane in enumerate(planes(store, stored, slab.low, slab.high), slab.low):
            n = plane.size
            path = pa.array([slab.path]).take(pa.array(np.zeros(n, np.int64)))
            yield pa.RecordBatch.from_arrays([path, pa.array(np.full(n, k, np.int32)), y, x, pa.array(plane.ravel())], names=["path", "z", "y", "x", "v"])


class VolumeSource(DataSource):
    """Format ``volume``: path, z, y, x, v of every voxel. Option ``planes``: planes of a partition."""

    @classmethod
    def name(cls) -> str:
        return "volume"

    def schema(self) -> str:
        return "path string, z int, y int, x int, v double"

    def reader(self, schema: Any) -> DataSourceReader:
        return VolumeReader(self.options)


class HeaderReader(VolumeReader):
    def read(self, slab: Slab) -> Iterator[tuple]:
        if slab.path and slab.low == 0:
            g = described(_opened(self.path)[0], slab.path).grid
            yield slab.path, (list(g.size), list(g.spacing), list(g.origin), list(g.direction))


class HeaderSource(DataSource):
    """Format ``volume_grid``: path and grid of every volume, to be used as ``Grids``."""

    @classmethod
    def name(cls) -> str:
        return "volume_grid"

    def schema(self) -> str:
        return f"path string, grid {GRID}"

    def reader(self, schema: Any) -> DataSourceReader:
        return HeaderReader(dict(self.options) | {"planes": str(1 << 30)})


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class FileWriter(DataSourceWriter):
    """Files are written to a folder of the job's own and moved into place by the commit, so a failed task or job leaves none."""

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.path, self.overwrite = options["path"], overwrite
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Any]) -> Written:
        store, top = _opened(self.path)
        out = []
        for row in rows:
            name = row["name"]
            if not name or name.startswith(("/", "_staging-")) or ".." in name.split("/"):
                raise ValueError(f"not a file name: {name!r}")
            at = f"{top}/{self.staging}/{uuid.uuid4().hex}"
            store.create_dir(posixpath.dirname(at))
            with store.open_output_stream(at) as f:
                f.write(bytes(row["content"]))
            out.append((at, name))
        return Written(out)

    def commit(self, messages: list[Written | None]) -> None:
        store, top = _opened(self.path)
        moves = [m for message in messages if message for m in message.files]
        names = [name for _, name in moves]
        taken = [] if self.overwrite else [i.path for i in store.get_file_info([f"{top}/{n}" for n in names]) if i.type != fs.FileType.NotFound]
        if taken or len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError(f"names that are there already or twice: {taken or sorted({n for n in names if names.count(n) > 1})}")
        for at, name in moves:
            store.create_dir(posixpath.dirname(f"{top}/{name}"))
            store.move(at, f"{top}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, top = _opened(self.path)
        if store.get_file_info(f"{top}/{self.staging}").type == fs.FileType.Directory:
            store.delete_dir(f"{top}/{self.staging}")


class FileSink(DataSource):
    """Format ``file_rows``: rows of name (a path below the target) and content (binary) as files."""

    @classmethod
    def name(cls) -> str:
        return "file_rows"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: Any, overwrite: bool) -> DataSourceWriter:
        return FileWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make the formats known to a session, and let it push filters down to them."""
    for source in (VolumeSource, HeaderSource, FileSink):
        spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def encoded(voxels: DataFrame, by: str, grids: DataFrame, suffix: str = "nii.gz", kind: str = "f4", value: str = "v") -> DataFrame:
    """name (by and suffix) and content of a file for each volume. voxels: by, z, y, x, value; missing ones are 0. grids: by, grid."""
    encode, dtype = ENCODERS[suffix], np.dtype("<" + kind)
    planes_ = voxels.groupBy(by, "z").agg(F.collect_list(F.struct("y", "x", F.col(value).cast("double").alias("v"))).alias("cells"))
    rows = planes_.unionByName(grids.select(by, "grid"), allowMissingColumns=True)
    schema = pa.schema([("name", pa.string()), ("content", pa.binary())])

    def one(t: pa.Table) -> pa.Table:
        from ..model import grid_from
        from ..operators.planes import _cells

        head = [g for g in t.column("grid").to_pylist() if g is not None]
        if not head:
            return schema.empty_table()
        grid = grid_from(head[0])
        a = np.zeros(grid.size[::-1], dtype)
        column = t.column("cells").combine_chunks()
        for i, z in enumerate(t.column("z").to_pylist()):
            if z is not None:
                c = _cells(column, i)
                a[z, c["y"].to_numpy(zero_copy_only=False), c["x"].to_numpy(zero_copy_only=False)] = c["v"].to_numpy(zero_copy_only=False)
        return pa.table([pa.array([f"{t.column(by)[0].as_py()}.{suffix}"]), pa.array([encode(a, grid)], pa.binary())], schema=schema)

    return rows.groupBy(by).applyInArrow(one, "name string, content binary")


def segmentation_files(labels: DataFrame, names: DataFrame, grids: DataFrame, suffix: str = "nii.gz") -> DataFrame:
    """name and content of what a segmentation is stored as: for each volume a label map, the names of its labels as JSON, and a mask
    for each organ. labels: volume_id, z, y, x, label; names: volume_id, label, organ; grids: volume_id, grid."""
    maps = encoded(labels, "volume_id", grids, suffix, "i2", "label").select(F.concat(F.lit("labels/"), "name").alias("name"), "content")
    pairs = F.sort_array(F.collect_list(F.struct("label", "organ")))
    texts = names.groupBy("volume_id").agg(pairs.alias("p")).select(F.concat(F.lit("labels/"), F.col("volume_id").cast("string"), F.lit(f".{suffix}.labels.json")).alias("name"), F.to_json(F.map_from_entries(F.transform("p", lambda x: F.struct(x["label"].cast("string"), x["organ"])))).cast("binary").alias("content"))
    key = F.concat(F.lit("masks/"), F.col("volume_id").cast("string"), F.lit("/"), F.col("organ")).alias("mask")
    masks = labels.join(names, ["volume_id", "label"]).select(key, "z", "y", "x", F.lit(1).alias("v")).distinct()
    where = names.join(grids, "volume_id").select(key, "grid").distinct()
    return maps.unionByName(texts).unionByName(encoded(masks, "mask", where, suffix, "u1"))
