"""Exact top-k inner products by norm-bucketed retrieval.

Candidates are grouped by length (norm): a bucket holds vectors whose lengths differ by a tenth at most, and large buckets are
parted by a hash into blocks of bounded size. A query first meets a bounded set of seeds, the longest vectors, whose k-th best
product is its floor. It is then sent only to buckets whose greatest length can reach that floor, and a block is copied only to
those groups of queries of which one can reach it, so what lengths exclude is never shuffled. In a block the queries have a local
cosine threshold: where it is high enough, candidates are pruned by ranges of the query's largest coordinates, else by length
alone. What is left is verified by whole products; each cell of queries and candidates returns at most k a query.

Components are integers kept as doubles, which are exact, and products are taken in doubles where these are exact and in Python
integers elsewhere, so any finite vector takes part. Order is exact throughout; a score beyond 64 bits is returned as null.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do rows without id; only vectors
of equal dimension meet. Candidates of a query are all rows but its own: repeated rows are queries and candidates each for
itself, and find each other. Ties go to the smaller id. Extra columns are ignored. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import load, written

SCALE, K, EVERY = 256, 5, 50
#: Vectors in a block of candidates, between these bounds for small and large tables; queries in a group; seeds; queries whose
#: products with a block are held at a time.
LEAST, MOST, QUERIES_IN_GROUP, SEEDS, TOGETHER = 512, 65_536, 4096, 1024, 256
#: Ratio of lengths within a bucket; cosine from which coordinates prune.
RATIO, COSINE = 1.1, 0.3
#: Pairs of a group of queries and a bucket, of four numbers each, up to which they are broadcast.
BROADCAST_ROWS = 500_000
FOUND = "query_id long, own long, vec_id long, score long, place binary"


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * component), an integer as double; null for a vector that takes no part."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    made = F.transform(vector, lambda x: _floor(x.cast("double") * float(scale)))
    return F.when(vector.isNotNull() & fine & (F.size(vector) > 0), made)


def _floor(x: Column) -> Column:
    """The floor as double: beyond 2**53 every double is an integer."""
    return F.when(F.abs(x) < float(1 << 53), F.floor(x).cast("double")).otherwise(x)


def _matrix(vectors: pd.Series) -> np.ndarray:
    """Components as doubles if products of them are exact in doubles, else as Python integers."""
    m = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    if np.abs(m).max() ** 2 * m.shape[1] < 1 << 52:
        return m
    return np.array([[int(x) for x in row] for row in m], dtype=object)


def lengths_of(m: np.ndarray) -> np.ndarray:
    """Euclidean lengths, without leaving the doubles for large components."""
    m = m.astype(np.float64)
    top = np.maximum(np.abs(m).max(1), 1e-300)
    return np.sqrt(((m / top[:, None]) ** 2).sum(1)) * top


def place_of(score: int) -> bytes:
    """Bytes that are in the order of the scores: sign, number of bytes, and magnitude."""
    size = (abs(score).bit_length() + 7) // 8
    raw = b"\x01" + size.to_bytes(4, "big") + abs(score).to_bytes(size, "big")
    return raw if score >= 0 else bytes(255 - x if i else 0 for i, x in enumerate(raw))


def search(q: np.ndarray, q_own: np.ndarray, floors: np.ndarray, v: np.ndarray, v_ids: np.ndarray, v_own: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(row of q, id, score) of the k best of v for every row of q but the row itself (equal own), none below the row's floor."""
    if v.dtype != q.dtype or v.dtype != object and np.abs(v).max() * np.abs(q).max() * v.shape[1] >= 1 << 52:
        v, q = (x if x.dtype == object else np.array([[int(y) for y in row] for row in x], dtype=object) for x in (v, q))
    lengths, q_lengths = lengths_of(v), lengths_of(q)
    bucket = np.where(lengths > 0, np.floor(np.log(np.maximum(lengths, 1e-9)) / np.log(RATIO)), -1e9)
    best: list[list[tuple[int, int]]] = [[] for _ in q]
    floors = floors.astype(np.float64).copy()
    for b in sorted(set(bucket), reverse=True):
        rows = np.flatnonzero(bucket == b)
        part, longest = v[rows], lengths[rows].max() * (1 + 1e-9)
        unit = part.astype(np.float64) / np.maximum(lengths[rows], 1e-9)[:, None]
        live = np.flatnonzero(q_lengths * longest * (1 + 1e-9) >= floors)
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where(q_lengths[live] > 0, floors[live] / (q_lengths[live] * longest), -np.inf)
        plain = live[~(cosine >= COSINE)]
        for at in range(0, len(plain), TOGETHER):
            for i, products in zip(plain[at : at + TOGETHER], q[plain[at : at + TOGETHER]] @ part.T, strict=True):
                _keep(best, floors, i, np.flatnonzero(v_own[rows] != q_own[i]), products, v_ids[rows], k)
        for i, c in zip(live[cosine >= COSINE], cosine[cosine >= COSINE], strict=True):
            if c > 1 + 1e-9:
                continue
            unit_q = q[i].astype(np.float64) / q_lengths[i]
            left = np.arange(len(rows))
            for f in np.argsort(-np.abs(unit_q))[:2]:
                wide = np.sqrt(max(0.0, (1 - unit_q[f] ** 2) * (1 - min(c, 1.0) ** 2))) + 1e-7
                x = unit[left, f]
                left = left[(x >= unit_q[f] * c - wide) if unit_q[f] >= 0 else (x <= unit_q[f] * c + wide)]
            if len(left):
                products_left = np.full(len(rows), None, object) if part.dtype == object else np.empty(len(rows))
                products_left[left] = part[left] @ q[i]
                _keep(best, floors, i, left[v_own[rows][left] != q_own[i]], products_left, v_ids[rows], k)
    return [(i, vid, int(score)) for i, found in enumerate(best) for score, vid in found]


def _keep(best: list, floors: np.ndarray, i: int, at: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> None:
    """Merge the verified products at these places into the k best of row i, and raise its floor."""
    near = at[doubles(scores[at]) >= floors[i]]
    if len(near) > 4 * k and scores.dtype != object:
        least = np.partition(scores[near], len(near) - k)[len(near) - k]
        near = near[scores[near] >= least]
    best[i] = sorted(best[i] + [(int(scores[j]), int(ids[j])) for j in near], key=lambda x: (-x[0], x[1]))[:k]
    if len(best[i]) == k:
        floors[i] = max(floors[i], below(doubles(np.array([best[i][-1][0]], scores.dtype))[0]))


def doubles(scores: np.ndarray) -> np.ndarray:
    """Scores as doubles; those beyond them stay below what they are."""
    if scores.dtype != object:
        return scores
    return np.array([float(x) if abs(x) < 10**300 else 1e300 if x > 0 else -np.inf for x in scores], np.float64)


def below(x: float | np.ndarray) -> float | np.ndarray:
    """A little less, for floors that are compared in doubles."""
    return x - np.abs(x) * 1e-9 if np.isfinite(x).all() else np.where(np.isfinite(x), x - np.abs(np.nan_to_num(x)) * 1e-9, x)


def _cell(k: int) -> Callable:
    def cell(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(queries) and len(rows):
            found = search(_matrix(queries["v"]), queries["own"].to_numpy(), queries["floor"].to_numpy(), _matrix(rows["v"]), rows["vec_id"].to_numpy(), rows["own"].to_numpy(), k)
        at = [f[0] for f in found]
        score = pd.array([f[2] if -(1 << 63) <= f[2] < 1 << 63 else None for f in found], "Int64")
        return pd.DataFrame({"query_id": queries["query_id"].to_numpy()[at], "own": queries["own"].to_numpy()[at], "vec_id": [f[1] for f in found], "score": score, "place": [place_of(f[2]) for f in found]})

    return cell


def _floors(queries: DataFrame, seeds: list[tuple[int, list[float]]], k: int) -> DataFrame:
    """queries with floor: the k-th best product with the seeds (own, v) but the query itself, -inf with fewer of its dimension."""
    use = queries.sparkSession.sparkContext.broadcast(seeds)

    def floored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            floor = np.full(len(batch), -np.inf)
            for dim, some in batch.groupby("dim"):
                mine = [(i, v) for i, v in use.value if len(v) == dim]
                if len(mine) > k:
                    with np.errstate(over="ignore", invalid="ignore"):
                        products = np.stack([np.asarray(v) for v in some["v"]]) @ np.array([v for _, v in mine]).T
                    products[some["own"].to_numpy()[:, None] == np.array([i for i, _ in mine])[None, :]] = -np.inf
                    best = np.sort(products, axis=1)[:, -k]
                    floor[batch.index.get_indexer(some.index)] = np.where(np.abs(best) < 1e290, below(best), -np.inf)
            yield batch.assign(floor=floor)

    return queries.mapInPandas(floored, ", ".join(f"{c} {t}" for c, t in queries.dtypes) + ", floor double")


def top_k(vectors: DataFrame, asked: Column, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score. vectors: vec_id, v (integers as doubles); asked says which rows are queries."""
    spark = vectors.sparkSession
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).select("vec_id", "v", F.coalesce(asked, F.lit(False)).alias("asked"), F.size("v").alias("dim"))
    # The place of a row tells it from a repeated one; it is fixed by the written table.
    rows = written(rows.withColumn("own", F.monotonically_increasing_id()).withColumn("length", _length(F.col("v"))), "vectors")
    bucket = F.when(F.col("length") > 0, F.floor(F.log("length") / float(np.log(RATIO)))).otherwise(-(1 << 20)).cast("long")
    rows = rows.withColumn("bucket", bucket)
    # A double's length lies in one of at most some 15,000 buckets, so their sizes are a bounded table.
    sizes = rows.groupBy("dim", "bucket").agg(F.count("*").alias("n"), (F.max("length") * (1 + 1e-9)).alias("longest"))
    block = min(MOST, max(LEAST, rows.count() // 64))
    sizes = written(sizes.withColumn("parts", F.ceil(F.col("n") / block)), "buckets")
    seeds = rows.orderBy(F.col("length").desc(), "vec_id", "own").limit(SEEDS).select("own", "v").collect()
    queries = rows.where("asked").select(F.col("vec_id").alias("query_id"), "own", "v", "dim", "length")
    queries = written(_floors(queries, [(r["own"], list(r["v"])) for r in seeds], k), "queries")
    groups = max(1, -(-queries.count() // QUERIES_IN_GROUP))
    queries = queries.withColumn("group", F.pmod(F.xxhash64(F.lit("group"), "own"), F.lit(groups)))
    reach = F.col("length") * F.col("longest") * (1 + 1e-9) >= F.col("floor")
    sent = queries.join(F.broadcast(sizes.select("dim", "bucket", "longest", "parts")), "dim").where(reach)
    met = written(sent.select("group", "dim", "bucket", "parts").distinct(), "met")
    met = F.broadcast(met) if met.count() <= BROADCAST_ROWS else met
    sent = sent.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = rows.join(met, ["dim", "bucket"]).withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "own"), F.col("parts")))
    keys = ("group", "dim", "bucket", "part")
    found = sent.select(*keys, "query_id", "own", "v", "floor").groupBy(*keys).cogroup(dealt.select(*keys, "vec_id", "own", "v").groupBy(*keys)).applyInPandas(_cell(k), FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id", "own").orderBy(F.col("place").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _length(v: Column) -> Column:
    top = F.greatest(F.array_max(F.transform(v, lambda x: F.abs(x))), F.lit(1e-300))
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + (x / top) * (x / top))) * top


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "embeddings").select("vec_id", quantised(F.col("embedding")).alias("v"))
    return top_k(rows, F.col("vec_id") % EVERY == 0)


SQL = {
    "op10_top_k": """
WITH ints AS (
  SELECT row_number() OVER () AS own, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.own, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM ints q JOIN ints c ON q.vec_id % 50 = 0 AND c.own <> q.own AND len(c.v) = len(q.v)),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
}
QUERIES = {"op10_top_k": op10_top_k}
