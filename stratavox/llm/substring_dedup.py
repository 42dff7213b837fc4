"""Substring deduplication by compact windows.

A document is the sequence of its 5-word shingle hashes. For each of ``HASHES`` min-hash functions the Cartesian tree over the
sequence gives compact windows (low, c, high): every run of 46 shingles (50 words) within low..high has its min-hash at c. These
are the tree's subtrees that span 46 or more, cut to 45 on either side of their root c; as each is a stretch of starts whose
runs have one minimum, sliding minima find them all without nodes. There are about 2 n / 46 a function, and each run of 46 lies
in exactly one. Windows whose min-hash value several documents have are compared in two ways, both linear in their number.

Verbatim passages, exactly: a run of 46 shingles (50 words) lies in one window of the first function, and has 13 shingles next to
its minimum on one side. The runs of all windows that share value and such a context with another document are hashed, and
documents with one run hash share it. So the first one of a hash stands for all, and none is lost.

Near copies, by min-hash: a window of 50 words of similarity 0.8 with one word changed, put in or left out inside has at least 20
equal shingles in a row. Windows with equal value and equal context of 13 shingles to the left or to the right are a group, and
each is first joined with the group's two pivots (smallest doc_id, smallest hash of it). Then the windows of a group that passages
found so far do not hold in one class are joined by rare shingles: two similar runs of 46 have one of their first n // 5 + 1 distinct
shingles in common, in any order of all shingles; in ours, those that most windows of the group have are last. By these windows meet
two pivots once more, and at last all others, so texts that share but the line that makes the group do not meet. Where
the intervals intersect in 46 shingles or more on the diagonal c - c', both stretches are fetched and verified: segments of matching
shingles of 50 words or more whose sets have a Jaccard similarity of 0.8, and in any other segment all windows of 50 words that have
it. Texts with equal words are one document for all that.

Defined results: null, empty and short texts (under 50 words) hold no passage and are classes of their own. A document is an id
and a text: equal rows are one document, and a passage counts if another document has it. Documents are in the order of their ids;
further texts of a repeated id, and rows without id, are documents of their own that come after all others, in the order of a
hash. A class is named by the least id in it, by null only if it has none. Periodic texts, where a minimum occurs again and again,
get a window for every 46 starts; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, bound_batches, bucketed, load, written
from .components import components
from .shingling import WIDTH, batch_shingles, distinct, fingerprint, mixed

#: Least words and shingles of a passage; hash functions.
WORDS = 50
LEAST = WORDS - WIDTH + 1
HASHES = 4
#: Similarity of a verified passage; shingles without match between two parts of one (one changed word spoils five).
SIMILAR, GAP = 0.8, 12
#: Shingles of a context.
CONTEXT = 13
_ODD = mixed(np.arange(1, CONTEXT + 1, dtype=np.uint64)) | np.uint64(1)
#: Base of run hashes, and its inverse.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Fetched intervals are widened to multiples of this; ids and spans (two or three numbers each) up to which they are broadcast.
STEP, BROADCAST_ROWS = 64, 1_000_000
#: Windows of a group beyond which its shingles are counted, in so many parts of them at most.
COUNTED = 32
#: Rounds in which windows meet pivots by rare shingles, before all that are left meet each other.
ROUNDS = 1


def compact_windows(h: np.ndarray, valid: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, ...]:
    """value, low, c, high of the compact windows of hashes of many texts one after another. valid: whether a run of ``least``
    that starts there is within one text. A stretch of more than ``least`` starts, which only equal minima make, is cut."""
    n = len(h) - least + 1
    if n < 1:
        return h[:0], *[np.zeros(0, np.int64)] * 3
    m, width = h, 1
    while 2 * width <= least:
        m, width = np.minimum(m[:-width], m[width:]), 2 * width
    m, ok = np.minimum(m[:n], m[least - width :][:n]), valid[:n]
    same = ok[1:] & ok[:-1] & (m[1:] == m[:-1])
    first, last = np.flatnonzero(ok & np.concatenate([[True], ~same])), np.flatnonzero(ok & np.concatenate([~same, [True]]))
    pieces = -(-(last - first + 1) // least)
    if (pieces > 1).any():
        end = np.repeat(last, pieces)
        first = np.repeat(first, pieces) + least * (np.arange(len(end)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        last = np.minimum(first + least - 1, end)
    value, c = m[first], first + least - 1  # a run's minimum is the shingle that came last, or is looked for
    seek = np.flatnonzero(h[c] != value)
    for some in np.array_split(seek, len(seek) // 50_000 + 1):
        c[some] = first[some] + h[first[some][:, None] + np.arange(least)].argmin(1)
    return value, first, np.maximum(c, last), last + least - 1


def batch_windows(shingles: list[np.ndarray]) -> dict[str, np.ndarray]:
    """key (min-hash value and function), text, c, span (shingles of the window left and right of c as 64 * left + right), contexts
    and tie of many texts; tie says of windows of the first function whether the minimum occurs twice."""
    sizes = np.array([len(x) for x in shingles], np.int64)
    starts = np.cumsum(sizes) - sizes
    sh, text = np.concatenate([*shingles, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(sizes)), sizes)
    valid = np.arange(len(sh)) <= np.repeat(starts + sizes - LEAST, sizes)
    out: dict[str, list[np.ndarray]] = {name: [] for name in ("key", "text", "c", "span", "left", "right", "tie")}
    for i in range(HASHES):
        h = mixed(sh ^ np.uint64(0x9E3779B97F4A7C15 * (i + 1) % 2**64))
        value, low, c, high = compact_windows(h, valid)
        tie = np.zeros(len(c), bool)
        for some in np.array_split(np.arange(len(c)), len(c) // 20_000 + 1) if i == 0 else []:
            at = low[some][:, None] + np.arange(2 * LEAST - 1)
            tie[some] = ((h[np.minimum(at, len(h) - 1)] == value[some][:, None]) & (at <= high[some][:, None])).sum(1) > 1
        found = ((value & ~np.uint64(HASHES - 1)) | np.uint64(i)).view(np.int64), text[c], (c - starts[text[c]]).astype(np.int32), (64 * (c - low) + high - c).astype(np.int16), *contexts(sh, c, low, high), tie
        for name, x in zip(out, found, strict=True):
            out[name].append(x)
    return {name: np.concatenate(x) for name, x in out.items()}


def contexts(sh: np.ndarray, c: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the CONTEXT shingles left and right of the places c, 0 where the window (low to high) holds fewer."""
    out = []
    for start in (c - CONTEXT, c + 1):
        ok = np.flatnonzero((start >= low) & (start + CONTEXT - 1 <= high))
        h = np.zeros(len(c), np.uint64)
        if len(ok):
            h[ok] = mixed((sh[start[ok][:, None] + np.arange(CONTEXT)] * _ODD).sum(1)) | np.uint64(1 << 32)
        out.append((h >> np.uint64(32)).astype(np.uint32).view(np.int32))
    return out[0], out[1]


def run_hashes(sh: np.ndarray, length: int = LEAST) -> np.ndarray:
    """The hash of every run of ``length`` shingles, by one sum over all: of two equal runs it is equal wherever they are."""
    if len(sh) < length:
        return np.zeros(0, np.uint64)
    power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(sh) - 1, _BASE)]))
    back = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(sh) - length, _INVERSE)]))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(sh * power, dtype=np.uint64)])
    return mixed((sums[length:] - sums[:-length]) * back)


def text_hash() -> Column:
    return F.xxhash64(F.col("text").cast("binary"))


def _raw(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("raw"), *more)


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        made = batch_shingles(list(batch["raw"]))
        # A text of less than five words is one shingle; its words are counted.
        words = [len(s) + WIDTH - 1 if len(s) > 1 else len(x.split()) if x else 0 for s, x in zip(made, batch["raw"], strict=True)]
        # Ids come as text, since whole numbers beside nulls would reach pandas as floats.
        yield pd.DataFrame({"doc_id": pd.array([None if i is None else int(i) for i in batch["doc_id"]], "Int64"), "_hash": batch["_hash"], "cid": pd.array([fingerprint(s) for s in made], "Int64"), "n_words": words})


def shared_ids(members: DataFrame) -> DataFrame:
    """_own, _least: the ids that several texts have, and the least hash of these. Hashes are compared in the map tasks first."""
    both = members.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("_hash").alias("_least"), F.max("_hash").alias("_most"))
    return both.where("_least != _most").select(F.col("doc_id").alias("_own"), "_least")


def keyed(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """rows (doc_id, _hash and others) with _key: the document's number, its id but for rows without one and for further texts of
    an id, which get numbers above 2**62 by hash. Rows without id are numbered by themselves, so that they are no key of the join."""
    late = F.lit(1 << 62) + F.pmod(F.xxhash64(F.lit("late"), F.col("doc_id").cast("long"), "_hash"), F.lit(1 << 62))
    named, count = rows.where(F.col("doc_id").isNotNull()), shared.count()
    own: Column = F.col("doc_id").cast("long")
    if count:
        named = named.join(_small(shared, count), own == F.col("_own"), "left")
        own = F.when(F.col("_least") != F.col("_hash"), late).otherwise(own)
    named = named.withColumn("_key", own).drop("_own", "_least")
    return named.unionByName(rows.where(F.col("doc_id").isNull()).withColumn("_key", late))


def _windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), 500):
            some = batch.iloc[at : at + 500]
            made = batch_windows(batch_shingles(list(some["raw"])))
            yield pd.DataFrame({"key": made.pop("key"), "doc_id": some["doc_id"].to_numpy()[made.pop("text")]} | made)


WINDOWS = "key long, doc_id long, c int, span short, left int, right int, tie boolean"


def together(rows: DataFrame, key: str) -> DataFrame:
    """The rows whose key several documents have, in one shuffle. A document has few rows of one key, so however many documents
    share it, it holds a small part of all rows; the window reads them in a stream and spills."""
    same = Window.partitionBy(key)
    rows = rows.withColumn("_first", F.min("doc_id").over(same)).withColumn("_last", F.max("doc_id").over(same))
    return rows.where("_first != _last").drop("_first", "_last")


def grouped(met: DataFrame) -> DataFrame:
    """group, doc_id, c, low, high, exact: windows by value and context; low and high are the window's ends near c, exact says
    whether the window is one of the first function. The lowest bit of a group says on which side of c its context lies."""
    sides = [F.struct(F.lit(i).alias("side"), F.col(n).alias("context")) for i, n in enumerate(("left", "right"))]
    rows = met.withColumn("s", F.explode(F.array(*sides))).where("s.context != 0")
    exact = F.col("key").bitwiseAND(HASHES - 1) == 0
    low, high = F.col("c") - F.floor(F.col("span") / 64).cast("int"), F.col("c") + F.col("span") % 64
    return together(rows.select(F.xxhash64("key", "s.context").bitwiseAND(-2).bitwiseOR(F.col("s.side").cast("long")).alias("group"), "doc_id", "c", low.alias("low"), high.cast("int").alias("high"), exact.alias("exact")), "group")


def still_open(groups: DataFrame, spans: DataFrame) -> DataFrame:
    """The rows of groups whose place c is in no span (words, from a passage's first to its end) of their document."""
    spans = spans.select("doc_id", "start", "end")
    held = (groups["doc_id"] == spans["doc_id"]) & (F.col("c") >= F.col("start")) & (F.col("c") <= F.col("end") - WIDTH)
    return groups.join(spans, held, "left_anti")


def candidates(groups: DataFrame, left: DataFrame, turn: int = 0) -> DataFrame:
    """a, b, d, low, high: shingles low to high of document a may repeat low - d to high - d of document b, of smaller id. Each
    window of ``left`` meets its group's two pivots, which are aggregated in the map tasks first: at first that of the smallest id and
    that of the smallest hash, at a later turn those of the smallest and the greatest of another hash."""
    row = F.struct("doc_id", "c", "low", "high")
    hashed = F.xxhash64("doc_id", F.lit(turn)) if turn else F.xxhash64("doc_id")
    turned = F.struct(hashed.alias("turn"), "doc_id", "c", "low", "high")
    bare = lambda q: F.struct(*[F.col(f"{q}.{n}").alias(n) for n in ("doc_id", "c", "low", "high")])
    pivots = groups.groupBy("group").agg((F.max(turned) if turn else F.min(row)).alias("p"), F.min(turned).alias("q"))
    pivots = pivots.select("group", F.explode(F.array(bare("p"), bare("q"))).alias("p"))
    return aligned(left.join(pivots, "group"))


def aligned(rows: DataFrame) -> DataFrame:
    """a, b, d, low, high of rows of a window (doc_id, c, low, high) and another, p, that intersect in a passage or more."""
    rows = rows.where(F.col("doc_id") != F.col("p.doc_id"))
    reach = F.least(F.col("c") - F.col("low"), F.col("p.c") - F.col("p.low")), F.least(F.col("high") - F.col("c"), F.col("p.high") - F.col("p.c"))
    rows = rows.where(reach[0] + reach[1] + 1 >= LEAST)
    later = F.col("doc_id") > F.col("p.doc_id")
    c, other = F.when(later, F.col("c")).otherwise(F.col("p.c")), F.when(later, F.col("p.c")).otherwise(F.col("c"))
    rows = rows.select(F.greatest("doc_id", "p.doc_id").alias("a"), F.least("doc_id", "p.doc_id").alias("b"), (c - other).alias("d"), (c - reach[0]).alias("low"), (c + reach[1]).alias("high"))
    return rows.groupBy("a", "b", "d").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def unsettled(groups: DataFrame, spans: DataFrame, edges: DataFrame) -> DataFrame:
    """The rows of groups in which passages found so far do not hold all windows in one class, with n, the windows of the group, label,
    the class of a window whose place c is in a passage, else null, and other, which says that it is not the group's most frequent one."""
    classes = components(edges).select(F.col("id").alias("doc_id"), "component")
    held = written(_by_document(spans).join(classes, "doc_id"), "held")
    inside = F.exists("spans", lambda s: (F.col("c") >= s["start"]) & (F.col("c") <= s["end"] - WIDTH))
    rows = groups.join(_small(held, held.count()), "doc_id", "left").select(*groups.columns, F.when(inside, F.col("component")).alias("label"))
    same = Window.partitionBy("group")
    rows = rows.select("*", F.count("*").over(same).alias("n"), F.count("label").over(same).alias("held"), F.min("label").over(same).alias("_first"), F.max("label").over(same).alias("_last"))
    rows = rows.where("held < n or _first != _last").withColumn("_n", F.count("label").over(Window.partitionBy("group", "label")))
    most = F.max(F.when(F.col("label").isNotNull(), F.struct("_n", "label"))).over(same)
    other = F.coalesce(F.col("label") != most["label"], F.lit(True))
    return rows.select(*groups.columns, "n", "label", other.alias("other"))


def rare(codes: np.ndarray, order: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Of windows, a row each of codes (of the shingles from c - 45 to c + 45) and of their places in one order of all codes: whether a
    shingle is one of the first of a run of 46 that holds c and lies in the window: of its n distinct codes the first n // 5 + 1.

    A run that is similar to one of n distinct codes misses at most n // 5 of them. So of the first n // 5 + 1 of both, in any common
    order, one is the same.
    """
    column, start = np.arange(2 * LEAST - 1), np.arange(LEAST)
    inside = (column >= low[:, None]) & (column <= high[:, None])
    key = np.sort(np.where(inside, codes, -1 - column), axis=1)
    whole = (start >= low[:, None]) & (start + LEAST - 1 <= high[:, None])
    runs = np.lib.stride_tricks.sliding_window_view(order, LEAST, axis=1)
    last = np.where(whole, np.partition(runs, LEAST // 5, axis=2)[:, :, LEAST // 5], -1)
    most = np.concatenate([np.maximum.accumulate(last, 1), np.maximum.accumulate(last[:, :0:-1], 1)[:, ::-1]], axis=1)
    mark = inside & (order <= most)
    for i in np.flatnonzero((key[:, 1:] == key[:, :-1]).any(1)):  # a code occurs twice
        mark[i] = False
        for s in np.flatnonzero(whole[i]):
            at = s + np.unique(order[i, s : s + LEAST], return_index=True)[1]
            mark[i, at[: len(at) // 5 + 1]] = True
    return mark


def _stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), 500):
            out = []
            some = batch.iloc[at : at + 500]
            for doc, s, asked in zip(some["doc_id"], batch_shingles(list(some["raw"])), some["asked"], strict=True):
                code = (mixed(s) >> np.uint64(33)).astype(np.int32)
                for place, group in np.asarray(asked, np.int64).reshape(-1, 2).tolist():
                    c = place >> 32
                    low, high = c - (place >> 6 & 63), c + (place & 63)
                    out.append((group, doc, c, low, high, code[low : high + 1]))
            yield pd.DataFrame(out, columns=["group", "doc_id", "c", "low", "high", "codes"])


def _rare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["codes", "common", "times"]
    for batch in batches:
        for at in range(0, len(batch), 500):
            some = batch.iloc[at : at + 500]
            left, right = (LEAST - 1 + (some[n] - some["c"]).to_numpy() for n in ("low", "high"))
            codes = np.full((len(some), 2 * LEAST - 1), -1, np.int64)
            order = np.full(codes.shape, 1 << 62, np.int64)
            for i, (side, code, common, times) in enumerate(zip(some["group"] & 1, *(some[n] for n in names), strict=True)):
                shared = code[LEAST - 1 - left[i] :][: CONTEXT + 1] if side else code[: LEAST - left[i]][-CONTEXT - 1 :]
                here = slice(left[i], right[i] + 1)
                codes[i, here], order[i, here] = code, code + (np.isin(code, shared).astype(np.int64) << 60)
                if common is not None and len(common):
                    k = np.minimum(np.searchsorted(common, code), len(common) - 1)
                    order[i, here] += np.where(common[k] == code, times[k], 0).astype(np.int64) << 32
            mark = rare(codes, order, left, right)
            yield some.drop(columns=names).assign(rare=[np.unique(c[m]).astype(np.int32) for c, m in zip(codes, mark, strict=True)])


def stretches(single: DataFrame, rows: DataFrame) -> DataFrame:
    """group, doc_id, c, low, high, codes (of the shingles low to high) of windows."""
    place = reduce(Column.bitwiseOR, [F.shiftleft(F.col("c").cast("long"), 32), F.shiftleft((F.col("c") - F.col("low")).cast("long"), 6), (F.col("high") - F.col("c")).cast("long")])
    asked = rows.groupBy("doc_id").agg(F.flatten(F.collect_list(F.array(place, "group"))).alias("asked"))
    return single.join(written(asked, "asked_of"), "doc_id").mapInPandas(_stretches, "group long, doc_id long, c int, low int, high int, codes array<int>")


def rarest(single: DataFrame, rows: DataFrame) -> DataFrame:
    """group, doc_id, c, low, high, large, rare (codes as of ``rare``) of the windows ``rows`` (of ``unsettled``). The order of
    codes ends with those of the group's context, and in a large group, of more than COUNTED windows, with those that many windows
    have, the most frequent last; so a line that many texts have is no place where its windows meet."""
    made = "group long, doc_id long, c int, low int, high int, large boolean, rare array<int>"
    none = F.lit(None).cast("array<int>")
    small = stretches(single, rows.where(F.col("n") <= COUNTED)).withColumns({"large": F.lit(False), "common": none, "times": none})
    large = written(stretches(single, rows.where(F.col("n") > COUNTED)), "stretches")
    counts = large.select("group", F.explode(F.array_distinct("codes")).alias("code")).groupBy("group", "code").count()
    sizes = rows.where(F.col("n") > COUNTED).select("group", "n").distinct()
    common = counts.where("count > 3").join(sizes, "group").where(F.col("count") * COUNTED >= F.col("n"))
    common = common.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("code", F.col("count").cast("int").alias("times")))).alias("common"))
    large = large.withColumn("large", F.lit(True)).join(common.select("group", F.col("common.code").alias("common"), F.col("common.times").alias("times")), "group", "left")
    return written(small.mapInPandas(_rare, made).union(large.mapInPandas(_rare, made)), "rarest")


def meetings(rows: DataFrame) -> DataFrame:
    """The rows (of ``rarest``) by key: a group, with code null, or of a large group each rare code of a window."""
    many = rows.where("large").withColumn("code", F.explode("rare")).withColumn("key", F.xxhash64("group", "code"))
    return rows.where("not large").withColumns({"code": F.lit(None).cast("int"), "key": F.col("group")}).unionByName(many)


def others(rows: DataFrame, done: DataFrame) -> DataFrame:
    """The candidates, as of ``candidates``, of each other window of ``rows`` (of ``meetings``) and every window of its group with which
    it has a rare code in common, but for two that are held in one class, and for what ``done`` (candidates) has."""
    row = F.struct("doc_id", "c", "low", "high", "label", "other", "rare", "code")
    met = rows.select("key", row.alias("w")).join(rows.where("other").select("key", row.alias("p")), "key")
    met = met.where(F.coalesce(F.col("w.label") != F.col("p.label"), F.lit(True)) & (~F.col("w.other") | (F.col("w.doc_id") < F.col("p.doc_id"))))
    # Two windows of a large group meet at each code that both have, and are joined at the first of them.
    first = F.when(F.col("p.code").isNull(), F.arrays_overlap("w.rare", "p.rare")).otherwise(F.array_min(F.array_intersect("w.rare", "p.rare")) == F.col("p.code"))
    pairs = aligned(met.where(first).select("w.doc_id", "w.c", "w.low", "w.high", "p")).alias("n")
    have = done.alias("o")
    on = [F.col(f"n.{k}") == F.col(f"o.{k}") for k in ("a", "b", "d")] + [F.col("n.low") >= F.col("o.low"), F.col("n.high") <= F.col("o.high")]
    return pairs.join(have, reduce(Column.__and__, on), "left_anti")


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """run, doc_id, p: the hash and place of every run that lies in a window asked and holds its place."""
    for batch in batches:
        for at in range(0, len(batch), 500):
            some = batch.iloc[at : at + 500]
            runs, docs, places = [], [], []
            for doc, s, asked in zip(some["doc_id"], batch_shingles(list(some["raw"])), some["asked"], strict=True):
                h = run_hashes(s)
                edge = np.zeros(len(h) + 1, np.int64)
                low, high = unpacked(asked)
                high = np.minimum(high - LEAST + 1, len(h) - 1)
                some_runs = low <= high
                np.add.at(edge, low[some_runs], 1)
                np.add.at(edge, high[some_runs] + 1, -1)
                p = np.flatnonzero(np.cumsum(edge)[:-1] > 0)
                runs.append(h[p])
                docs.append(np.full(len(p), doc, np.int64))
                places.append(p)
            if runs:
                yield pd.DataFrame({"run": np.concatenate(runs).view(np.int64), "doc_id": np.concatenate(docs), "p": np.concatenate(places).astype(np.int32)})


def verbatim(single: DataFrame, met: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges: a, b; spans: doc_id, start, end, first) of all passages of 50 words or more that documents have word by word: b is
    the first document with a run of 50 words of a's; first says that the span's document is that one itself."""
    ties = met.where(F.col("tie") & (F.col("key").bitwiseAND(HASHES - 1) == 0))
    ties = ties.select("doc_id", (F.col("c") - F.floor(F.col("span") / 64)).cast("int").alias("low"), (F.col("c") + F.col("span") % 64).cast("int").alias("high"))
    places = written(groups.where("exact").select("doc_id", "low", "high").union(ties).distinct(), "places")
    rows = written(_with_asked(single, places, "low", "high").mapInPandas(_runs, "run long, doc_id long, p int"), "runs")
    # Of a run that many documents have, one row a task is left before the shuffle.
    # Written, it is a plain side of the join, whose other side Spark can split where a run is hot.
    first = written(rows.groupBy("run").agg(F.min("doc_id").alias("b"), F.max("doc_id").alias("z")).where("b != z").select("run", "b"), "firsts")
    shared = written(rows.join(first, "run").select("doc_id", "p", "b"), "shared")
    spans = shared.select("doc_id", "b", F.col("p").cast("long").alias("start"), (F.col("p") + WORDS).cast("long").alias("end"))
    # Two passages of one other document with one word between them are one passage, of far more than the least similarity.
    spans = disjoint(spans, "doc_id", "b", gap=1).withColumn("first", F.col("doc_id") == F.col("b"))
    spans = disjoint(spans, "doc_id", "first")
    return shared.where("doc_id != b").select(F.col("doc_id").alias("a"), "b").distinct(), spans.select("doc_id", "start", "end", "first")


def unpacked(asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both numbers of requests."""
    asked = np.asarray(asked, np.int64)
    return asked >> 32, asked & 0xFFFFFFFF


def _with_asked(single: DataFrame, asked: DataFrame, low: str, high: str) -> DataFrame:
    """The documents with the requests (two numbers below 2**31 in one long) that they have, as an array. ``single`` lies in buckets of
    documents, so only the requests are dealt."""
    one = F.shiftleft(F.col(low).cast("long"), 32).bitwiseOR(F.col(high).cast("long"))
    return single.join(written(asked.groupBy("doc_id").agg(F.collect_list(one).alias("asked")), "asked_of"), "doc_id")


def _places(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values of y, and the places of each as ascending numbers value * 2**32 + place, and the place before of the same value (-1)."""
    values, code = np.unique(y, return_inverse=True)
    order = np.argsort(code, kind="stable")
    before = np.full(len(y), -1)
    same = code[order[1:]] == code[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    return values, (code[order].astype(np.int64) << 32) + order, before


def similar_windows(x: np.ndarray, y: np.ndarray, d: int, low: int, high: int) -> np.ndarray:
    """The i from low to high - LEAST for which x[i:i + LEAST] and y[i - d:i - d + LEAST] as sets have the similarity of a passage."""
    i = np.arange(max(low, d, 0), min(high, len(x), len(y) + d) - LEAST + 1)
    if not len(i):
        return i
    values, places, before_y = _places(y)
    before_x = _places(x)[2]
    code = np.searchsorted(values, x)
    known = (code < len(values)) & (values[np.minimum(code, len(values) - 1)] == x)
    if (before_x < 0).all():  # no more than a fifth of the distinct shingles may be missing; here that is a fifth of all
        sums = np.concatenate([[0], np.cumsum(~known)])
        i = i[sums[i + LEAST] - sums[i] <= LEAST * (1 - SIMILAR)]
        if not len(i):
            return i
    out = []
    for some in np.array_split(i, len(i) // 2000 + 1):
        at = some[:, None] + np.arange(LEAST)
        new = before_x[at] < some[:, None]
        start = (code[at].astype(np.int64) << 32) + (some - d)[:, None]
        k = np.searchsorted(places, start)
        there = known[at] & (k < len(places)) & (places[np.minimum(k, len(places) - 1)] < start + LEAST)
        both = (new & there).sum(1)
        either = new.sum(1) + (before_y[at - d] < (some - d)[:, None]).sum(1) - both
        out.append(some[both >= SIMILAR * either])
    return np.concatenate(out)


def diagonals(x: np.ndarray, y: np.ndarray, d: int) -> list[int]:
    """d, and the diagonals on which shingles that y has once match often enough for a passage: of its at least 41 matching
    shingles one edit puts at least 20 on one diagonal."""
    values, first, n = np.unique(y, return_index=True, return_counts=True)
    once, first = values[n == 1], first[n == 1]
    if not len(once):
        return [d]
    k = np.minimum(np.searchsorted(once, x), len(once) - 1)
    i = np.flatnonzero(once[k] == x)
    found, times = np.unique(i - first[k[i]], return_counts=True)
    return [d, *(int(e) for e in found[times >= LEAST * 2 // 5 + 2] if e != d)]


def passages(x: np.ndarray, y: np.ndarray, d: int) -> list[tuple[int, int, int, int]]:
    """Verified passages as (from, to, from, to) in shingles of x and y; x[i] faces y[i - d].

    A stretch of matching shingles that is similar as a whole is one passage. In any other, all windows of 50 words that are similar
    are found, and each union of overlapping ones is a passage, without shingles at its ends that do not match.
    """
    out = []
    found = np.isin(x, y)
    hit = np.flatnonzero(found)
    if not len(hit):
        return out
    distinct_x = len(distinct(x.view(np.uint64))) == len(x)
    if distinct_x and len(hit) < SIMILAR * LEAST:
        return out
    for part in np.split(hit, np.flatnonzero(np.diff(hit) > GAP) + 1):
        low, high = int(part[0]), int(part[-1]) + 1
        if high - low >= LEAST:
            mine = np.unique(x[low:high])
            there = np.flatnonzero(np.isin(y, mine))
            yl, yh = int(there[0]), int(there[-1]) + 1
            if yh - yl > 2 * (high - low):  # the shingles also occur elsewhere: stay on the diagonal
                yl, yh = max(0, low - d), min(len(y), high - d)
            theirs = np.unique(y[yl:yh])
            both = len(np.intersect1d(mine, theirs, assume_unique=True))
            if yh > yl and both >= SIMILAR * (len(mine) + len(theirs) - both):
                out.append((low, high, yl, yh))
                continue
        edge = int(LEAST * (1 - SIMILAR))
        start, stop = max(0, low - edge), min(len(x), high + edge)
        if distinct_x and not _may_hold(found[start:stop]):
            continue
        for e in diagonals(x[low:high], y, d - low):
            e += low
            at = similar_windows(x, y, e, start, stop)
            for run in np.split(at, np.flatnonzero(np.diff(at) > LEAST) + 1) if len(at) else []:
                inside = np.flatnonzero(found[run[0] : run[-1] + LEAST]) + int(run[0])
                out.append((int(inside[0]), int(inside[-1]) + 1, int(inside[0]) - e, int(inside[-1]) + 1 - e))
    return out


def _may_hold(found: np.ndarray) -> bool:
    """Whether four fifths of some window of distinct shingles are matched."""
    sums = np.concatenate([[0], np.cumsum(found)])
    return len(found) >= LEAST and int((sums[LEAST:] - sums[:-LEAST]).max()) >= SIMILAR * LEAST


def _slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), 500):
            out = []
            some = batch.iloc[at : at + 500]
            for doc, s, asked in zip(some["doc_id"], batch_shingles(list(some["raw"])), some["asked"], strict=True):
                s = s.view(np.int64)
                out += [(doc, low, high, s[low:high]) for low, high in zip(*(v.tolist() for v in unpacked(asked)), strict=True)]
            yield pd.DataFrame(out, columns=["doc_id", "from", "to", "part"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads both parts of a pair in place from the Arrow buffers, so no copy of a batch is made."""
    names = ("a", "b", "start", "end", "there", "there_end")
    for batch in batches:
        a, b, d, fa, fb = (batch.column(c).to_pylist() for c in ("a", "b", "d", "fa", "fb"))
        (xs, xo), (ys, yo) = ((batch.column(c).values.to_numpy(), batch.column(c).offsets.to_numpy()) for c in ("x", "y"))
        out: list[tuple] = []
        for i in range(batch.num_rows):
            x, y = xs[xo[i] : xo[i + 1]], ys[yo[i] : yo[i + 1]]
            for low, high, yl, yh in passages(x, y, d[i] - fa[i] + fb[i]):
                out.append((a[i], b[i], fa[i] + low, fa[i] + high + WIDTH - 1, fb[i] + yl, fb[i] + yh + WIDTH - 1))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(6)], names=list(names))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(members: doc_id, own_id, cid, n_words; copies: doc_id, cid, first, of texts with equal words; edges: a, b, documents that
    share a passage; spans: doc_id, start, end, first, words of passages, which in the first document are no repeat; shared: the ids
    that several texts have). doc_id is the document's number throughout, own_id the row's id."""
    bound_batches(docs.sparkSession)
    rows = _raw(docs, text_hash().alias("_hash"))
    members = written(rows.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(_members, "doc_id long, _hash long, cid long, n_words long"), "members")
    shared = written(shared_ids(members), "shared")
    renumbered = lambda df: keyed(df, shared).withColumnsRenamed({"doc_id": "own_id", "_key": "doc_id"}).drop("_hash")
    members, rows = renumbered(members), renumbered(rows).drop("own_id")
    classes = members.where(F.col("cid").isNotNull()).groupBy("cid").agg(F.min("doc_id").alias("first"))
    copies = written(members.join(classes, "cid").where((F.col("doc_id") != F.col("first")) & (F.col("n_words") >= WORDS)).select("doc_id", "cid", "first", "n_words").distinct(), "copies")
    ids = copies.select("doc_id").distinct()
    # Texts are dealt by document once, for both passes that fetch parts of them.
    single = bucketed(rows.join(_small(ids, ids.count()), "doc_id", "left_anti"), "doc_id", "single")
    met = written(together(single.mapInPandas(_windows, WINDOWS), "key"), "met")
    groups = written(grouped(met), "groups")
    edges, spans = verbatim(single, met, groups)
    spans = written(spans, "spans")
    pairs = written(candidates(groups, still_open(groups, spans)), "candidates")
    edges, spans = with_near(edges, spans, verified(single, pairs))
    rows = rarest(single, written(unsettled(groups.drop("exact"), spans, edges), "unsettled"))
    for turn in range(1, ROUNDS + 1):  # windows that share a rare shingle meet pivots first, so that few pairs are left
        left = meetings(written(unsettled(rows, spans, edges), "unsettled")).select(F.col("key").alias("group"), "doc_id", "c", "low", "high", "other")
        more = written(candidates(left, left.where("other"), turn), "candidates")
        edges, spans = with_near(edges, spans, verified(single, more))
        pairs = pairs.union(more)
    left = meetings(written(unsettled(rows, spans, edges), "unsettled"))
    edges, spans = with_near(edges, spans, verified(single, written(others(left, pairs), "others")))
    return members, copies, edges, spans, shared


def with_near(edges: DataFrame, spans: DataFrame, near: DataFrame) -> tuple[DataFrame, DataFrame]:
    """edges and spans with those of verified passages."""
    spans = spans.select("doc_id", "start", "end", "first").union(near.select("a", "start", "end", F.lit(False))).union(near.select("b", "there", "there_end", F.lit(True)))
    return written(edges.union(near.select("a", "b")).distinct(), "linked"), written(spans.distinct(), "spans")


def verified(single: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, start, end, there, there_end of the passages that the documents of candidate pairs share."""
    widened = [F.greatest(F.lit(0), F.floor(low / STEP) * STEP).cast("int").alias("from") for low in (F.col("low"), F.col("low") - F.col("d"))]
    ends = [(F.floor(high / STEP) * STEP + STEP).cast("int").alias("to") for high in (F.col("high"), F.col("high") - F.col("d"))]
    pairs = pairs.select("a", "b", "d", widened[0].alias("fa"), ends[0].alias("ta"), widened[1].alias("fb"), ends[1].alias("tb"))
    asked = pairs.select(F.col("a").alias("doc_id"), F.col("fa").alias("from"), F.col("ta").alias("to")).union(pairs.select("b", "fb", "tb")).distinct()
    parts = _with_asked(single, written(asked, "asked"), "from", "to").mapInPandas(_slices, "doc_id long, from int, to int, part array<long>")
    # Rows with equal doc_id give parts twice, and passages twice, which are counted once.
    parts = written(parts, "parts")
    mine = parts.select(F.col("doc_id").alias("a"), F.col("from").alias("fa"), F.col("to").alias("ta"), F.col("part").alias("x"))
    theirs = parts.select(F.col("doc_id").alias("b"), F.col("from").alias("fb"), F.col("to").alias("tb"), F.col("part").alias("y"))
    met = pairs.join(mine, ["a", "fa", "ta"]).join(theirs, ["b", "fb", "tb"])
    return written(met.select("a", "b", "d", "fa", "fb", "x", "y").mapInArrow(_verify, "a long, b long, start long, end long, there long, there_end long"), "found")


def disjoint(spans: DataFrame, *by: str, gap: int = 0) -> DataFrame:
    """The columns by, start and end: the unions of spans that overlap or have at most ``gap`` words between them."""
    mine = Window.partitionBy(*by).orderBy("start", "end")
    reached = F.max("end").over(mine.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.select(*by, "start", "end").distinct().withColumn("new", F.coalesce(F.col("start") > reached + gap, F.lit(True)).cast("int"))
    rows = rows.withColumn("island", F.sum("new").over(mine))
    return rows.groupBy(*by, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def _by_document(spans: DataFrame) -> DataFrame:
    """doc_id, spans: disjoint ones in order. Equal spans, of which the first document of a common passage has many, count once."""
    return disjoint(spans, "doc_id").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, class_id, n_passages, repeated_words of every row: class_id is the smallest doc_id that shared passages
    lead to, n_passages and repeated_words count the disjoint spans that other documents have too, and their words."""
    members, copies, edges, spans, _ = repeats(docs)
    classes = written(components(edges.union(copies.select("doc_id", "first"))), "components").withColumnRenamed("id", "doc_id")
    whole = copies.select(F.col("doc_id"), F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end"))
    firsts = copies.select(F.col("first").alias("doc_id"), F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end"))
    spans = spans.select("doc_id", "start", "end").union(whole).union(firsts)
    out = members.join(classes, "doc_id", "left").join(_by_document(spans), "doc_id", "left")
    words = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]), F.lit(0).cast("long"))
    # A class is named by the least id that a row of it has; its first document may have none.
    named = written(out.select("own_id", "n_words", "component", F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_passages"), words.alias("repeated_words")), "judged")
    names = named.where(F.col("component").isNotNull()).groupBy("component").agg(F.min("own_id").alias("class_id"))
    alone = named.where(F.col("component").isNull()).withColumn("class_id", F.col("own_id"))
    rows = named.join(names, "component").unionByName(alone, allowMissingColumns=True)
    return rows.select(F.col("own_id").alias("doc_id"), "n_words", "class_id", "n_passages", "repeated_words")


def without(text: str | None, spans: list) -> str | None:
    """The text without the words of the spans, and without the white space before each of them."""
    if text is None or len(spans) == 0:
        return text
    at = [m.span() for m in re.finditer(WORD, text)]
    out, done = [], 0
    for s in spans:
        start, end = s["start"], min(s["end"], len(at))
        if start < end:
            out.append(text[done : at[start - 1][1] if start else 0])
            done = at[end - 1][1]
    return "".join([*out, text[done:]])


def cut_repeats(docs: DataFrame) -> DataFrame:
    """The documents with all their columns; passages that an earlier document has are cut out of text, and n_chars, if there is
    such a column, is the length of what remains."""
    _, copies, _, spans, shared = repeats(docs)
    spans = spans.where("not first").select("doc_id", "start", "end").union(copies.select("doc_id", F.lit(0).cast("long"), F.col("n_words")))
    spans = written(_by_document(spans), "spans").select(F.col("doc_id").alias("_cut_id"), F.col("spans").alias("_cut_spans"))
    columns = docs.columns
    rows = keyed(docs.withColumn("_hash", text_hash()), shared)
    cut = F.pandas_udf(lambda t, s: pd.Series([without(x, y if y is not None else []) for x, y in zip(t, s, strict=True)], dtype=object), "string")
    rows = rows.join(_small(spans, spans.count()), F.col("_key") == F.col("_cut_id"), "left")
    there = F.col("_cut_spans").isNotNull()
    rows = rows.withColumn("_cut_text", F.when(there, cut(F.col("text"), F.col("_cut_spans"))).otherwise(F.col("text")))
    made = {"text": F.col("_cut_text")} | ({"n_chars": F.when(there, F.length("_cut_text")).otherwise(F.col("n_chars"))} if "n_chars" in columns else {})
    return rows.select(*[made[c].cast(docs.schema[c].dataType).alias(c) if c in made else F.col(c) for c in columns])


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(load(spark, sf_dir, "documents"))


QUERIES = {"op2_substring_dedup": op2_substring_dedup}
