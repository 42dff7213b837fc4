"""Hard negatives by a full sort of each anchor's scores.

Rows are dealt into blocks and anchors into groups, both of bounded size, and a pair of a group and a block is a task's unit of
work. A first pass has the anchors meet the rows of their own label in every block: the best of each block, merged by anchor, are
its positives. In a second pass each anchor's integer scores with all rows of a block are sorted by score and id; the upper limit
of each positive is found by binary search, and from there the first different-label rows down to the lower limit are read. Each
block returns at most that many a positive, which are merged by rank. So nothing grows with the rows of an anchor but the number of
blocks it meets, and no block is larger than ``MOST`` rows.

Scores are exact: in doubles where these hold all sums, and in Python integers elsewhere. A score beyond 64 bits is ranked and
compared exactly and returned as null.

Defined results: rows with a null id, label or vector, an empty vector, or a null or non-finite component take no part; only
vectors of equal dimension meet; repeated rows are anchors, positives and negatives each for itself; ties go to the smaller id;
an anchor without another row of its label has no result. Extra columns are ignored. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import load, written
from .topk import _matrix, place_of, quantised

EVERY, POSITIVES, NEGATIVES, LOW, HIGH = 50, 5, 3, 50, 95
#: Rows of a block, anchors of a group, and anchors whose scores are sorted at a time.
LEAST, MOST, GROUP, TOGETHER = 4096, 65_536, 4096, 64
FOUND = "own long, anchor_id long, positive_id long, positive_own long, positive_score long, positive_place binary, negative_id long, score long, place binary"


def score_of(place: bytes) -> int:
    """The score whose place it is."""
    if place[0]:
        return int.from_bytes(place[5:], "big")
    return -int.from_bytes(bytes(255 - x for x in place[5:]), "big")


def long_of(score: int) -> int | None:
    return score if -(1 << 63) <= score < 1 << 63 else None


class Sorted:
    """The scores of some anchors with all rows of a block, each in order of score (falling) and id. Rows come in order of id."""

    def __init__(self, q: np.ndarray, v: np.ndarray) -> None:
        if q.dtype != v.dtype or v.dtype != object and np.abs(v).max() * np.abs(q).max() * v.shape[1] >= 1 << 52:
            q, v = (x if x.dtype == object else np.array([[int(y) for y in row] for row in x], dtype=object) for x in (q, v))
        s = q @ v.T
        if s.dtype != object:
            s = s.astype(np.int64)
            top, bits = int(s.max()), max(1, (s.shape[1] - 1).bit_length())
            if (top - int(s.min())).bit_length() + bits <= 62:  # score and row in one number: one sort
                key = np.sort(((top - s) << bits) | np.arange(s.shape[1]), axis=1)
                self.order, self.scores = key & ((1 << bits) - 1), top - (key >> bits)
                return
            self.order = np.argsort(-s, axis=1, kind="stable")
        else:
            self.order = np.array([sorted(range(s.shape[1]), key=lambda j, row=row: -row[j]) for row in s], np.int64)
        self.scores = np.take_along_axis(s, self.order, 1)

    def first_at_most(self, i: int, limit: int) -> int:
        """The place of the first score of row i that is no more than the limit."""
        if self.scores.dtype != object:
            return int(np.searchsorted(-self.scores[i], -limit))
        low, high = 0, self.scores.shape[1]
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if self.scores[i, middle] <= limit else (middle + 1, high)
        return low


def read(s: Sorted, row: np.ndarray, start: np.ndarray, least: np.ndarray, use: Callable[[np.ndarray, np.ndarray], np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the reading, place in the order) of the first k entries of each reading that may be used: from a start, down to a
    least score. use(reading, block row) says which. Readings that have too few yet are widened."""
    n, width, todo, out = s.order.shape[1], 8 * k, np.arange(len(row)), []
    while len(todo):
        at = start[todo][:, None] + np.arange(width)
        there = np.minimum(at, n - 1)
        r = row[todo][:, None]
        enough = (at < n) & (s.scores[r, there] >= least[todo][:, None]).astype(bool)
        ok = enough & use(todo[:, None], s.order[r, there])
        count = ok.cumsum(1)
        done = (count[:, -1] >= k) | ~enough[:, -1]
        i, j = np.nonzero(ok & (count <= k) & done[:, None])
        out.append((todo[i], there[i, j]))
        todo, width = todo[~done], 4 * width
    return tuple(np.concatenate([o[c] for o in out]) if out else np.zeros(0, np.int64) for c in (0, 1))


def _positives(k: int) -> Callable:
    def cell(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(anchors) and len(rows):
            rows = rows.sort_values(["vec_id", "own"], kind="stable")
            labels = {label: part for label, part in rows.groupby("label")}
            for label, some in anchors.groupby("label"):
                part = labels.get(label)
                if part is None:
                    continue
                v, ids, owns = _matrix(part["v"]), part["vec_id"].to_numpy(), part["own"].to_numpy()
                for at in range(0, len(some), TOGETHER):
                    few = some.iloc[at : at + TOGETHER]
                    own, s = few["own"].to_numpy(), Sorted(_matrix(few["v"]), v)
                    n = np.arange(len(few))
                    least = np.array([int(s.scores[i, -1]) for i in n], s.scores.dtype)
                    i, j = read(s, n, np.zeros(len(few), np.int64), least, lambda r, c: owns[c] != own[r], k)  # noqa: B023
                    for a, b in zip(i.tolist(), j.tolist(), strict=True):
                        row, score = s.order[a, b], int(s.scores[a, b])
                        out.append((own[a], ids[row], owns[row], long_of(score), place_of(score)))
        made = pd.DataFrame(out, columns=["own", "positive_id", "positive_own", "score", "place"])
        return made.astype({"own": "int64", "positive_id": "int64", "positive_own": "int64", "score": "Int64"})

    return cell


def _negatives(k: int, low: int, high: int) -> Callable:
    def cell(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(anchors) and len(rows):
            rows = rows.sort_values(["vec_id", "own"], kind="stable")
            v, ids, labels = _matrix(rows["v"]), rows["vec_id"].to_numpy(), rows["label"].to_numpy()
            for at in range(0, len(anchors), TOGETHER):
                few = anchors.iloc[at : at + TOGETHER]
                s, label = Sorted(_matrix(few["v"]), v), few["label"].to_numpy()
                asked = [(i, p, score_of(bytes(p["place"]))) for i, found in enumerate(few["positives"]) for p in found]
                row = np.array([i for i, _, _ in asked], np.int64)
                start = np.array([s.first_at_most(i, high * x // 100) for i, _, x in asked], np.int64)
                least = np.array([-(-low * x // 100) for _, _, x in asked], s.scores.dtype)
                r, j = read(s, row, start, least, lambda r, c: labels[c] != label[row[r]], k)  # noqa: B023
                for a, b in zip(r.tolist(), j.tolist(), strict=True):
                    i, p, x = asked[a]
                    score = int(s.scores[i, b])
                    out.append((few["own"].iloc[i], few["anchor_id"].iloc[i], p["positive_id"], p["positive_own"], long_of(x), bytes(p["place"]), ids[s.order[i, b]], long_of(score), place_of(score)))
        made = pd.DataFrame(out, columns=[c.split()[0] for c in FOUND.split(", ")])
        return made.astype({c: "int64" for c in ("own", "anchor_id", "positive_id", "positive_own", "negative_id")} | {"positive_score": "Int64", "score": "Int64"})

    return cell


def mine(vectors: DataFrame, asked: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. vectors: vec_id, label, v (integers as doubles);
    asked says which rows are anchors; low and high are the limits of a negative's score in hundredths of the positive's."""
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()
    rows = vectors.where(fine).select("vec_id", F.col("label").cast("long").alias("label"), "v", F.coalesce(asked, F.lit(False)).alias("asked"), F.size("v").alias("dim"))
    # The place of a row tells it from a repeated one; it is fixed by the written table.
    rows = written(rows.withColumn("own", F.monotonically_increasing_id()), "vectors")
    block = min(MOST, max(LEAST, rows.count() // 64))
    # One row a dimension: an array is as long as its dimension, so there are few.
    sizes = rows.groupBy("dim").agg(F.ceil(F.count("*") / block).alias("parts"), F.ceil(F.count(F.when(F.col("asked"), 1)) / GROUP).alias("groups"))
    sizes = F.broadcast(written(sizes, "sizes"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    anchors = written(rows.where("asked").select(F.col("vec_id").alias("anchor_id"), "own", "label", "v", "dim"), "anchors")
    anchors = anchors.join(sizes, "dim").withColumn("group", F.pmod(F.xxhash64(F.lit("group"), "own"), F.col("groups")))
    dealt = rows.join(sizes, "dim").where("groups > 0").withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "own"), F.col("parts"))).withColumn("group", each("groups"))
    keys = ("group", "dim", "part")
    dealt = dealt.select(*keys, "vec_id", "own", "label", "v").groupBy(*keys)
    best = anchors.withColumn("part", each("parts")).select(*keys, "own", "label", "v").groupBy(*keys).cogroup(dealt).applyInPandas(_positives(positives), "own long, positive_id long, positive_own long, score long, place binary")
    rank = F.row_number().over(Window.partitionBy("own").orderBy(F.col("place").desc(), "positive_id", "positive_own"))
    best = best.withColumn("rank", rank).where(F.col("rank") <= positives)
    # As many entries an anchor as it has positives.
    best = written(best.groupBy("own").agg(F.collect_list(F.struct("positive_id", "positive_own", "place")).alias("positives")), "positives")
    sent = anchors.join(best, "own").withColumn("part", each("parts")).select(*keys, "own", "anchor_id", "label", "v", "positives")
    found = sent.groupBy(*keys).cogroup(dealt).applyInPandas(_negatives(negatives, low, high), FOUND)
    rank = F.row_number().over(Window.partitionBy("own", "positive_own").orderBy(F.col("place").desc(), "negative_id"))
    found = found.withColumn("rank", rank).where(F.col("rank") <= negatives)
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = load(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), quantised(F.col("embedding")).alias("v"))
    return mine(rows, F.col("vec_id") % EVERY == 0)


SQL = {
    "op11_hard_negatives": """
WITH ints AS (
  SELECT row_number() OVER () AS own, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.own, q.vec_id AS anchor_id, c.own AS other, c.vec_id, q.label = c.label AS same, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM ints q JOIN ints c ON q.vec_id % 50 = 0 AND c.own <> q.own AND len(c.v) = len(q.v)),
pos AS (SELECT *, row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS place FROM pairs WHERE same),
neg AS (
  SELECT pos.anchor_id, pos.vec_id AS positive_id, n.vec_id AS negative_id, pos.score AS positive_score, n.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY pos.own, pos.other ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank
  FROM pos JOIN pairs n ON n.own = pos.own AND NOT n.same AND 50 * pos.score <= 100 * n.score AND 100 * n.score <= 95 * pos.score WHERE pos.place <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 3""",
}
QUERIES = {"op11_hard_negatives": op11_hard_negatives}
