"""Periodic runs of words, and texts without their repetitions.

A run is a stretch of consecutive words with smallest period q (words q apart are equal) that holds at least ``ratio`` periods and
``least`` words and that no neighbouring word extends. Two copies of it, q words apart, overlap in at least ``overlap(ratio, least)``
words: the least of max(least, ratio * q) - q over all q. So every word of a run lies in a k-gram of that length that the text has
again, and words outside of repeated k-grams are masked. What survives are a few stretches, and no run leaves one.

On these the halving of Main and Lorentz finds the runs: a run that crosses the middle of a block and holds four periods has, for
its period p, a square of period p that ends or starts at the middle. All periods of all blocks of one depth are tested at once on
prefix hashes, and the squares found are extended to both sides by binary search over the same hashes. Every run is then compared
word by word, so a collision of prefix hashes changes nothing; words themselves are told apart by 64-bit hashes.

Defined results: null, empty and short texts (under ``least`` words) have no run; of equal stretches the smallest period counts;
rows are judged one by one, so null and repeated ids change nothing; other columns are not read; an empty table gives an empty
result. Memory is a few numbers a word of the longest text, or of ``TOGETHER`` bytes of texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, load
from .shingling import buffers, mixed, word_hashes

#: Periods and words that a run has at least; squares are only tested on both sides of a middle, which needs four periods.
RATIO, LEAST = 4, 6
#: Squares tested at a time; words of a text joined at a time.
TESTED, JOINED = 4_000_000, 100_000
SAME = bytes(range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)
RUNS = "array<struct<start: long, length: long, period: long>>"


def overlap(ratio: int = RATIO, least: int = LEAST) -> int:
    """Words that the two copies of the shortest run share; longer periods share more."""
    return min(max(least, ratio * q) - q for q in range(1, least + 1))


def edges_of(held: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the maximal stretches of places that are held, each within one text."""
    if not len(held):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.concatenate([[True], text[1:] != text[:-1]])
    before, after = np.concatenate([[False], held[:-1]]), np.concatenate([held[1:], [False]])
    last = np.concatenate([new[1:], [True]])
    return np.flatnonzero(held & (~before | new)), np.flatnonzero(held & (~after | last)) + 1


def surviving(x: np.ndarray, text: np.ndarray, k: int) -> np.ndarray:
    """Whether each word lies in a k-gram that its text has more than once. x: word hashes of texts one after another."""
    n = len(x) - k + 1
    held = np.zeros(len(x), bool)
    if n < 1:
        return held
    gram = np.zeros(n, np.uint64)
    for i in range(k):
        gram = mixed(gram ^ x[i : i + n]) + np.uint64(i)
    gram = np.where(text[:n] == text[k - 1 :], mixed(gram ^ mixed(text[:n].astype(np.uint64) + np.uint64(1))), np.uint64(0))
    ordered = np.sort(gram)
    twice = ordered[1:][(ordered[1:] == ordered[:-1]) & (ordered[1:] != 0)]
    if not len(twice):
        return held
    at = np.minimum(np.searchsorted(twice, gram), len(twice) - 1)
    edge = np.zeros(len(x) + 1, np.int32)
    found = np.flatnonzero(twice[at] == gram)
    edge[found] += 1
    edge[found + k] -= 1
    return np.cumsum(edge)[:-1] > 0


class Prefixes:
    """Prefix hashes of a sequence, on which equal stretches are compared at once for many places."""

    def __init__(self, x: np.ndarray) -> None:
        self.power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(x), _BASE)]))
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(x * self.power[:-1], dtype=np.uint64)])

    def repeat(self, at: np.ndarray, p: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the stretches of this size at these places are found again p words later."""
        s = self.sums
        return (s[at + size] - s[at]) * self.power[p] == s[at + p + size] - s[at + p]

    def reach(self, at: np.ndarray, p: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
        """How many words from (or, going back, before) these places are found again p words later, at most ``most``."""
        low, high = np.zeros(len(at), np.int64), most.astype(np.int64)
        while (low < high).any():
            middle = (low + high + 1) // 2
            ok = self.repeat(at - middle if back else at, p, middle)
            low, high = np.where(ok, middle, low), np.where(ok, high, middle - 1)
        return low


def squares(low: np.ndarray, high: np.ndarray, ratio: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(block, place, period) of all squares within each block that end or start at its middle, some at a time."""
    middle = (low + high) // 2
    for side in (0, 1):
        most = np.minimum((middle - low if side == 0 else high - middle) // 2, (high - low) // ratio)
        first = np.cumsum(most) - most
        total = int(most.sum())
        for at in range(0, total, TESTED):
            i = np.arange(at, min(at + TESTED, total))
            block = np.searchsorted(first + most, i, side="right")
            p = i - first[block] + 1
            yield block, middle[block] - 2 * p if side == 0 else middle[block], p


def repetitions(x: np.ndarray, begin: np.ndarray, end: np.ndarray, ratio: int = RATIO, least: int = LEAST) -> np.ndarray:
    """Rows (start, end, period) of the runs in the stretches begin..end of a sequence of hashes."""
    hashes, low, high, left, right = Prefixes(x), begin, end, begin, end
    found = [np.zeros((0, 3), np.int64)]
    while True:
        wide = high - low >= least
        low, high, left, right = low[wide], high[wide], left[wide], right[wide]
        if not len(low):
            break
        for block, at, p in squares(low, high, ratio):
            some = np.flatnonzero(x[at] == x[at + p])
            some = some[hashes.repeat(at[some], p[some], p[some])]
            block, at, p = block[some], at[some], p[some]
            start = at - hashes.reach(at, p, at - left[block], back=True)
            stop = at + p + hashes.reach(at, p, right[block] - at - p)
            long = stop - start >= np.maximum(least, ratio * p)
            found.append(smallest(np.column_stack([start[long], stop[long], p[long]])))
        middle = (low + high) // 2
        low, high, left, right = (np.concatenate(v) for v in ((low, middle), (middle, high), (left, left), (right, right)))
    out, sure = smallest(np.concatenate(found)), []
    for start, stop, p in out.tolist():
        same = x[start : stop - p] == x[start + p : stop]
        if same.all():
            sure.append((start, stop, p))
        else:  # hashes of different stretches were equal: what is equal word by word, each piece for itself
            for a, b in zip(*edges_of(same, np.zeros(len(same))), strict=True):
                if b - a + p >= max(least, ratio * p):
                    sure.append((start + int(a), start + int(b) + p, p))
    return smallest(np.array(sure, np.int64).reshape(-1, 3))


def smallest(rows: np.ndarray) -> np.ndarray:
    """Of rows with equal start and end the one with the smallest period, in this order."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    return rows[first]


def runs_of(words: list[np.ndarray], ratio: int = RATIO, least: int = LEAST) -> list[np.ndarray]:
    """For each sequence of word hashes the rows (start, length, period) of its runs, by start and then period."""
    sizes = np.array([len(w) for w in words], np.int64)
    starts = np.cumsum(sizes) - sizes
    x, text = np.concatenate([*words, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(sizes)), sizes)
    begin, end = edges_of(surviving(x, text, overlap(ratio, least)), text)
    wide = end - begin >= least
    begin, end = begin[wide], end[wide]
    if not len(begin):
        return [np.zeros((0, 3), np.int64)] * len(words)
    # Only what survives is kept, stretch after stretch.
    size = end - begin
    offset = np.cumsum(size) - size
    place = np.arange(int(size.sum())) + np.repeat(begin - offset, size)
    rows = repetitions(x[place], offset, offset + size, ratio, least)
    owner = text[place[rows[:, 0]]]
    rows = np.column_stack([place[rows[:, 0]] - starts[owner], rows[:, 1] - rows[:, 0], rows[:, 2]])
    order = np.lexsort((rows[:, 2], rows[:, 0], owner))
    return np.split(rows[order], np.searchsorted(owner[order], np.arange(1, len(words))))


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Whether each of n words stays: those that some run contains after its first period go."""
    kept = np.ones(n, bool)
    for start, length, period in runs.tolist():
        kept[start + period : start + length] = False
    return kept


def collapse_batches(batches: Iterator[pd.DataFrame], ratio: int = RATIO, least: int = LEAST) -> Iterator[pd.DataFrame]:
    """doc_id, n_words, runs and collapsed (the kept words, joined by one space) of batches with doc_id (as text, since whole numbers
    beside nulls would reach pandas as floats) and raw."""
    for batch in batches:
        ids, at = [None if i is None or i != i else int(i) for i in batch["doc_id"]], 0
        for buffer, some in buffers(list(batch["raw"]), SAME):
            start, size, h = word_hashes(buffer)
            edge = np.concatenate([[0], np.searchsorted(start, 1 + np.cumsum([len(t) + 1 for t in some]))])
            words = [h[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]
            found, out = runs_of(words, ratio, least), []
            for k, runs in enumerate(found):
                stay = np.flatnonzero(kept_words(len(words[k]), runs)) + edge[k]
                parts = []
                for few in np.array_split(stay, len(stay) // JOINED + 1):
                    parts.append(b" ".join([buffer[a:b] for a, b in zip(start[few].tolist(), (start[few] + size[few]).tolist(), strict=True)]))
                out.append((ids[at + k], len(words[k]), [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs.tolist()], b" ".join(parts)))
            at += len(some)
            made = pd.DataFrame([o[1:] for o in out], columns=["n_words", "runs", "collapsed"])
            made.insert(0, "doc_id", pd.array([o[0] for o in out], "Int64"))
            yield made


COLLAPSED = f"doc_id long, n_words long, runs {RUNS}, collapsed binary"


def collapse(docs: DataFrame, ratio: int = RATIO, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs (start, length, period, by start and then period) and the collapsed text in UTF-8 of every row."""
    if ratio < 4 or least < ratio:
        raise ValueError("a run has four periods or more, and no fewer words than periods")
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col("text").cast("binary").alias("raw"))
    return rows.mapInPandas(lambda batches: collapse_batches(batches, ratio, least), COLLAPSED)


def planted(doc_id: int | str | None, raw: bytes | None) -> bytes | None:
    """The text as the query takes it: of one document in ten, by the checksum of its id, the words from a place on repeat."""
    if doc_id is None or raw is None:
        return raw
    h = zlib.crc32(str(int(doc_id)).encode())
    if h % 10:
        return raw
    words, g = raw.split(), h // 10
    n = len(words)
    if not n:
        return raw
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return b" ".join(words[:a] + (unit * ((n - a) // p + 1))[: n - a])


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs and the collapsed text of every document, after the planted repetitions, as figures and digests."""
    docs = load(spark, sf_dir, "documents")
    bound_batches(spark)

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from collapse_batches(b.assign(raw=[planted(i, r) for i, r in zip(b["doc_id"], b["raw"], strict=True)]) for b in batches)

    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col("text").cast("binary").alias("raw")).mapInPandas(made, COLLAPSED)
    return digests(rows)


def digests(rows: DataFrame) -> DataFrame:
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("a"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length"))))
    lines: Column = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    rows = rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    # 1000 * length stays below 2**53, so the quotient of doubles has the right floor for all lengths of texts.
    milli = F.floor(F.lit(1000) * F.col("b.length") / F.col("b.period")).cast("long")
    return rows.select("doc_id", "n_runs", "b.start", "b.length", "b.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


QUERIES = {"op13_periodic_runs": op13_periodic_runs}
