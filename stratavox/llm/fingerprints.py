"""Document fingerprints: one-permutation MinHash with optimal densification, of which only low-order bits are kept.

A text's shingles (five words, A-Z lower-cased; a shorter text is one shingle) are hashed once. The upper bits of a hash say its
bin, the rest is its value, and a bin keeps its least value. An empty bin takes the value of another one: bins are tried in an order
of the empty bin's own, which is the same for all texts, until one is not empty. Of each value, mixed with its bin, ``BITS`` bits are
kept and packed as hexadecimal text. Two unlike values agree in these bits with probability 2**-BITS, so of a share e of equal
entries the likeness is (e - 2**-BITS) / (1 - 2**-BITS), at least 0: an estimate of the Jaccard similarity whose standard error is
about sqrt(j (1 - j) / BINS).

Neighbours: rows are dealt by ranges of descending id and sorted there, so a task sees each row and its next one in a stream; only
the first and last row of each range are kept with their text, and paired afterwards. So texts are shuffled once, and no window
over all rows is needed.

Defined results: null, empty and blank texts have the empty fingerprint, whose likeness is 1 with itself and 0 with any other; rows
without id come last; rows of one id are in the order of a hash of their text; equal rows follow each other; the last row is
followed by the first, a single row by itself. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, load, written
from .shingling import batch_shingles, mixed

#: Bins (a power of two) and bits kept of each.
BINS, BITS = 512, 4
_SHIFT = np.uint64(64 - (BINS.bit_length() - 1))
_NONE = np.uint64(2**64 - 1)
_SALT = mixed(np.arange(1, BINS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
#: The other bins in the order in which each bin tries them.
TRIED = np.argsort(mixed(_SALT[:, None] ^ _SALT * np.uint64(0x9E3779B97F4A7C15)), axis=1).astype(np.int32)


def bins_of(shingles: list[np.ndarray]) -> np.ndarray:
    """The least value of each bin (columns) of each text, none where it is empty."""
    out = np.full(len(shingles) * BINS, _NONE)
    sizes = np.array([len(s) for s in shingles], np.int64)
    h = mixed(np.concatenate([*shingles, np.zeros(0, np.uint64)]) ^ np.uint64(0xA0761D6478BD642F))
    at = np.repeat(np.arange(len(sizes)) * BINS, sizes) + (h >> _SHIFT).astype(np.int64)
    np.minimum.at(out, at, h & ((np.uint64(1) << _SHIFT) - np.uint64(1)))
    return out.reshape(len(shingles), BINS)


def densified(bins: np.ndarray) -> np.ndarray:
    """bins with every empty one filled from the first one that it tries and that is not empty; a text without any stays so."""
    have, out = bins != _NONE, bins.copy()
    row, empty = np.nonzero(~have & have.any(1)[:, None])
    turn = 0
    while len(row):
        there = TRIED[empty, turn]
        ok = have[row, there]
        out[row[ok], empty[ok]] = bins[row[ok], there[ok]]
        row, empty, turn = row[~ok], empty[~ok], turn + 1
    return out


def packed(texts: list[bytes | None]) -> np.ndarray:
    """The kept bits of each text, two entries a byte, and whether it has any, as one more byte of 0 or 1."""
    bins = bins_of(batch_shingles(texts))
    some = (bins != _NONE).any(1)
    low = (mixed(densified(bins) ^ _SALT) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    low[~some] = 0
    return np.concatenate([low[:, 0::2] << BITS | low[:, 1::2], some[:, None].astype(np.uint8)], 1)


def raw_of(rows: np.ndarray) -> list[bytes]:
    return [bytes(r[:-1]) if r[-1] else b"" for r in rows]


def text_of(rows: np.ndarray) -> list[str]:
    return [r.hex() for r in raw_of(rows)]


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The likeness of packed fingerprints, row by row."""
    differ = a[:, :-1] ^ b[:, :-1]
    equal = (((differ & 15) == 0).sum(1) + ((differ >> BITS) == 0).sum(1)) / BINS
    chance = 2.0**-BITS
    found = np.maximum(0.0, (equal - chance) / (1 - chance))
    return np.where(a[:, -1] & b[:, -1], found, (a[:, -1] == b[:, -1]).astype(float))


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text column, as hexadecimal text."""
    return F.pandas_udf(lambda raws: pd.Series(text_of(packed(list(raws))), dtype=object), "string")(text.cast("binary"))


def likeness(a: Column, b: Column) -> Column:
    """The likeness of two fingerprint columns, 0 to 1; null if one is null."""

    def judged(x: pd.Series, y: pd.Series) -> pd.Series:
        rows = lambda c: np.stack([np.frombuffer(bytes.fromhex(v) + b"\1" if v else bytes(BINS // 2 + 1), np.uint8) for v in c]) if len(c) else np.zeros((0, BINS // 2 + 1), np.uint8)
        return pd.Series(alike(rows(x), rows(y))).where(x.notna().to_numpy() & y.notna().to_numpy())

    return F.pandas_udf(judged, "double")(a, b)


#: Digests and fingerprints are bytes until the result, which has them as hexadecimal text.
FIGURES = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def edited(text: str, other: str) -> str:
    """The last third of the text replaced by as many first characters of the other one."""
    n = len(text) // 3
    return text[: len(text) - n] + other[:n]


def _figures(ids: list, texts: list[str], own: np.ndarray, others: list[str], theirs: np.ndarray) -> pd.DataFrame:
    raws = [edited(t, o).encode("utf-8", "surrogatepass") for t, o in zip(texts, others, strict=True)]
    made = packed(raws)
    values = {"n_chars": [len(t) for t in texts], "edited_sha256": [hashlib.sha256(r).digest() for r in raws], "fingerprint": raw_of(own), "edited_fingerprint": raw_of(made), "near_edited": alike(own, made), "near_next": alike(own, theirs)}
    return pd.DataFrame({"doc_id": pd.array(ids, "Int64")} | values)


def _ids(batch: pd.DataFrame) -> list[int | None]:
    """Ids come as text, since whole numbers beside nulls would reach pandas as floats."""
    return [None if i is None else int(i) for i in batch["doc_id"]]


def _packed(texts: list[str]) -> np.ndarray:
    return packed([t.encode("utf-8", "surrogatepass") for t in texts])


def _stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The figures of all rows of a sorted range but its last one; the first and the last with their texts."""
    part, held = TaskContext.get().partitionId(), None
    edge = lambda i, t, end: pd.DataFrame({"part": [part], "end": [end], "doc_id": pd.array([i], "Int64"), "text": [t]})
    for batch in batches:
        ids = _ids(batch)
        texts = [t if t is not None else "" for t in batch["text"]]
        if not ids:
            continue
        own = _packed(texts)
        if held is None:
            yield edge(ids[0], texts[0], "first")
        else:
            ids, texts, own = [held[0], *ids], [held[1], *texts], np.concatenate([held[2], own])
        if len(ids) > 1:
            yield _figures(ids[:-1], texts[:-1], own[:-1], texts[1:], own[1:]).assign(part=part)
        held = ids[-1], texts[-1], own[-1:]
    if held is not None:
        yield edge(held[0], held[1], "last")


def _aligned(frames: Iterator[pd.DataFrame], schema: str) -> Iterator[pd.DataFrame]:
    columns = [c.split() for c in schema.split(", ")]
    for frame in frames:
        yield pd.DataFrame({name: frame[name].astype(object if kind in ("string", "binary") else frame[name].dtype) if name in frame else pd.Series([None] * len(frame), dtype=object) for name, kind in columns})


def _pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts, others = list(batch["text"]), list(batch["other"])
        yield _figures(_ids(batch), texts, _packed(texts), others, _packed(others))


def neighbours(docs: DataFrame) -> DataFrame:
    """Of every document its fingerprint, that of its text with the last third taken from the next document (by descending id),
    and how like it is to that edited text and to the next document."""
    bound_batches(docs.sparkSession)
    # Equal rows are told apart by their place, so that many of them are not one range.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_hash"), F.monotonically_increasing_id().alias("_row"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("_hash"), F.col("_row")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    schema = f"{FIGURES}, part int, end string, text string"
    out = written(rows.mapInPandas(lambda batches: _aligned(_stream(batches), schema), schema), "ranges")
    done = out.where(F.col("end").isNull()).select(*[c.split()[0] for c in FIGURES.split(", ")])
    # Two rows a task, whatever the table's size; the windows are over one row a task.
    firsts = out.where(F.col("end") == "first")
    following = F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy()))
    after = firsts.select("part", following.alias("next"))
    lasts = out.where(F.col("end") == "last").select("part", "doc_id", "text").join(after, "part")
    met = lasts.join(firsts.select(F.col("part").alias("next"), F.col("text").alias("other")), "next")
    rows = done.unionByName(met.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "other").mapInPandas(_pairs, FIGURES))
    return rows.withColumns({c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")})


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(load(spark, sf_dir, "documents"))


QUERIES = {"op12_fingerprints": op12_fingerprints}
