"""Toxicity by maximum-scoring passages.

A token's score is its log-odds between toxic and clean texts under an informative Dirichlet prior: of the word or of one of its
beginnings, the highest of those whose sign is sure (``LEAST_Z`` standard errors), be it above or below zero. All other tokens
are one class with log-odds of its own, which is below zero, as toxic texts have fewer of them. One linear scan finds all maximal
passages (Ruzzo and Tompa). A passage of score S in a text of n tokens is expected K n exp(-lambda S) times by chance (Karlin and
Altschul): lambda is the root of sum p(s) exp(lambda s) = 1 over the scores s of clean tokens, K the likeliest for the best
passages of clean texts. A logistic curve over these figures, fitted on the training rows, gives the probability.

Learning reads a bounded sample of labelled rows (``sample`` rows about, chosen by a hash of doc_id; all rows while there are
fewer), so the weights that are broadcast are bounded by the words of that sample, and what the driver gets of its texts is a
histogram and three figures a row. Scoring reads every whole text.

Defined results: null and empty texts hold no token and have the score of a text without any passage; unlabelled rows and rows
without id only get scores; without both kinds of label every score is the share of toxic rows (0 without any). Repeated rows
get equal scores. Of passages with equal scores the first and shortest is the best. Extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, bound_batches, load, written
from .shingling import buffers, word_hashes
from .wordtable import WordTable

#: Labelled rows to learn from, at most (in expectation).
SAMPLE = 50_000
#: Prior tokens; prior texts as a share of the sample; least z-score of a feature that has a score of its own; most that other tokens
#: score; chance count of a significant passage.
PRIOR, PRIOR_SHARE, LEAST_Z, OTHER, SIGNIFICANT = 1000.0, 0.1, 3.0, -0.01, 0.05
#: Beginnings of words that are features besides words, in characters, and the words remembered by a worker at most.
SHORTEST, LONGEST, REMEMBERED = 4, 8, 1_000_000
#: Lower case; ASCII punctuation separates tokens.
TOKENS = bytes(32 if c < 128 and not chr(c).isalnum() else c for c in LOWER)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def passages(scores: list[tuple[int, int, float]]) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, start, end) of runs (start, end, score) in order, in linear time.

    Kept segments hold the sums before and after them and the place of the nearest one before that starts lower, so a search goes
    from link to link and never passes a segment twice. A new positive run is merged with the kept ones as long as the nearest one
    that starts lower also ends lower. Where none starts lower, no later run can reach the kept ones, and they are done.
    """
    done: list[tuple[float, float, int, int, int]] = []
    kept: list[tuple[float, float, int, int, int]] = []
    total = 0.0
    for start, end, score in scores:
        before, total = total, total + score
        if score <= 0:
            continue
        low, first, j = before, start, len(kept) - 1
        while True:
            while j >= 0 and kept[j][0] >= low:
                j = kept[j][4]
            if j < 0:
                done += kept
                kept = [(low, total, first, end, -1)]
                break
            if kept[j][1] >= total:
                kept.append((low, total, first, end, j))
                break
            low, first, link = kept[j][0], kept[j][2], kept[j][4]
            del kept[j:]
            j = link
    return [(b - a, int(s), int(e)) for a, b, s, e, _ in done + kept]


class Scores:
    """Scores of tokens by the weights of words and beginnings; remembers a bounded number of words."""

    def __init__(self, weights: dict[str, float], other: float = OTHER) -> None:
        self.weights, self.other, self.table, self.scores = weights, other, WordTable(), np.zeros(0)

    def __reduce__(self) -> tuple:
        return Scores, (self.weights, self.other)

    def of_word(self, word: str) -> float:
        return max((self.weights[f] for f in features_of(word) if f in self.weights), default=self.other)

    def of_texts(self, raws: list[bytes | None]) -> Iterator[np.ndarray]:
        """The scores of each text's tokens."""
        for buffer, some in buffers(raws, TOKENS):
            if self.table.size > REMEMBERED:
                self.table, self.scores = WordTable(), np.zeros(0)
            start, size, h = word_hashes(buffer)
            number, words = self.table.numbered(buffer, start, size, h)
            self.scores = np.concatenate([self.scores, [self.of_word(w.decode("utf-8", "replace")) for w in words]])
            ends = np.searchsorted(start, 1 + np.cumsum([len(x) + 1 for x in some]))
            yield from np.split(self.scores[number], ends[:-1])


def best_passage(scores: np.ndarray) -> tuple[float, int, int]:
    """(score, start, end) of the best passage, the first and shortest of equal ones; without a positive score (0, 0, 0)."""
    if not len(scores) or scores.max() <= 0:
        return 0.0, 0, 0
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    gain = sums[1:] - np.minimum.accumulate(sums)[:-1]
    end = int(gain.argmax())
    start = end - int(sums[end::-1].argmin())
    return float(gain[end]), start, end + 1


def all_passages(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal passages: the scan over runs of positive and other tokens."""
    if not len(scores):
        return []
    edge = np.concatenate([[0], np.flatnonzero(np.diff(scores > 0)) + 1, [len(scores)]])
    sums = np.add.reduceat(scores, edge[:-1])
    return passages(list(zip(edge[:-1].tolist(), edge[1:].tolist(), sums.tolist(), strict=True)))


def figures(scores: np.ndarray, lam: float, k: float) -> tuple[float, float, float, int, int]:
    """Of the best passage the negative log of its chance count, of all the sum over significant ones (log), their number, and the
    best one's start and end. The scan for all runs only where the best one is significant."""
    level, least = math.log(k * (len(scores) + 1)), -math.log(SIGNIFICANT)
    score, start, end = best_passage(scores)
    top, sure = lam * score - level, []
    if top > least:
        sure = [x for x in (lam * s - level for s, _, _ in all_passages(scores)) if x > least]
    return top, math.log1p(sum(sure)), len(sure), start, end


def features_of(word: str) -> list[str]:
    """The word and its beginnings, marked by a star."""
    return [word, *(word[:k] + "*" for k in range(SHORTEST, min(len(word), LONGEST) + 1))]


def _word_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Tokens, and documents that have them, by class, of each batch's words."""
    for batch in batches:
        counts = [Counter() for _ in range(4)]
        for raw, toxic in zip(batch["raw"], batch["toxic"], strict=True):
            tokens = (raw or b"").translate(TOKENS).split()
            counts[toxic].update(tokens)
            counts[2 + toxic].update(set(tokens))
        words = list(counts[0] | counts[1])
        yield pd.DataFrame({"raw": words} | {name: np.array([c[w] for w in words], "int64") for name, c in zip(("t0", "t1", "d0", "d1"), counts, strict=True)})


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a ridge logistic regression with a constant, by Newton's method."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w)), a.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _odds(clean: str, toxic: str, n0: int, n1: int, pseudo: float) -> tuple[Column, Column]:
    """Log-odds of a feature under the prior, and their z-score. Features of one text may overlap, so counts may exceed n."""
    y0, y1 = F.col(clean), F.col(toxic)
    prior = pseudo * (y1 + y0) / F.greatest(F.lit(1), F.lit(n1 + n0))
    rest0, rest1 = F.greatest(n0 + pseudo - y0 - prior, F.lit(1.0)), F.greatest(n1 + pseudo - y1 - prior, F.lit(1.0))
    odds = F.log((y1 + prior) / rest1) - F.log((y0 + prior) / rest0)
    return odds, odds / F.sqrt(1 / (y1 + prior) + 1 / (y0 + prior))


def decay(scores: np.ndarray, share: np.ndarray) -> float:
    """The positive root of sum share * exp(lambda * score) = 1; 1, that of exact log-odds, where the scores have none."""
    share = share / max(share.sum(), 1e-12)
    if not len(scores) or scores.max() <= 0 or (share * scores).sum() >= 0:
        return 1.0
    value = lambda x: float((share * np.exp(np.minimum(x * scores, 700.0))).sum()) - 1
    low, high = 0.0, 1.0
    while value(high) < 0 and high < 1e3:
        low, high = high, 2 * high
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if value(middle) < 0 else (low, middle)
    return high


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """The model: token scores, lambda, K and the curve. labels: doc_id, toxic; rows for the hold-out are left out."""
    bound_batches(docs.sparkSession)
    rows = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    total = rows.count()
    rows = rows.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 20)) < F.lit(math.ceil((1 << 20) * min(1.0, sample / max(total, 1)))))
    # The sample is bounded by its parameter, so its ids may be broadcast, and its texts are written once for the passes below.
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("raw")).join(F.broadcast(rows), "doc_id").select("raw", "toxic")
    texts = written(texts, "sample")
    sizes = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n1 or not n0:
        return {"scores": Scores({}), "lam": 1.0, "k": 1.0, "curve": None, "share": n1 / (n0 + n1) if n0 + n1 else 0.0}
    words = texts.mapInPandas(_word_counts, "raw binary, t0 long, t1 long, d0 long, d1 long").groupBy("raw").agg(*[F.sum(c).alias(c) for c in ("t0", "t1", "d0", "d1")])
    words = written(words, "words")
    word = F.col("raw").cast("string")
    starts = [F.when(F.length(word) >= k, F.concat(F.substring(word, 1, k), F.lit("*"))) for k in range(SHORTEST, LONGEST + 1)]
    counts = words.select(F.explode(F.array_compact(F.array(word, *starts))).alias("feature"), "t0", "t1", "d0", "d1").groupBy("feature").agg(*[F.sum(c).cast("double").alias(c) for c in ("t0", "t1", "d0", "d1")])
    total = words.agg(F.sum("t0").alias("t0"), F.sum("t1").alias("t1")).first()
    # Tokens are counted for the odds, and texts for their errors, as tokens of one text depend on each other.
    odds, z = _odds("t0", "t1", total["t0"] or 0, total["t1"] or 0, PRIOR)[0], _odds("d0", "d1", n0, n1, PRIOR_SHARE * (n0 + n1))[1]
    found = counts.select("feature", odds.alias("odds"), z.alias("z")).where((F.abs("z") >= LEAST_Z) & (F.signum("z") == F.signum("odds"))).collect()
    weights = {r["feature"]: r["odds"] for r in found}
    use = docs.sparkSession.sparkContext.broadcast(Scores(weights, math.nan))

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"score": [round(use.value.of_word(bytes(w).decode("utf-8", "replace")), 3) for w in batch["raw"]], "t0": batch["t0"], "t1": batch["t1"]})

    # The tokens by rounded score: a histogram of some thousand rows however many words there are; NaN has the other tokens.
    found = words.select("raw", "t0", "t1").mapInPandas(scored, "score double, t0 long, t1 long").groupBy(F.coalesce("score", F.lit(math.nan)).alias("score")).agg(F.sum("t0").alias("t0"), F.sum("t1").alias("t1")).collect()
    rest = next(((r["t0"], r["t1"]) for r in found if math.isnan(r["score"])), (0, 0))
    share = [(n + PRIOR * sum(rest) / max(total["t0"] + total["t1"], 1)) / (whole + PRIOR) for n, whole in zip(rest, (total["t0"], total["t1"]), strict=True)]
    other = min(math.log(share[1] / share[0]) if min(share) > 0 else OTHER, OTHER)
    lam = decay(np.array([other if math.isnan(r["score"]) else r["score"] for r in found]), np.array([r["t0"] for r in found], float))
    scores = Scores(weights, other)
    use = docs.sparkSession.sparkContext.broadcast(scores)

    def chance(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"x": [(len(s) + 1) * math.exp(-lam * best_passage(s)[0]) for s in use.value.of_texts(list(batch["raw"]))]})

    # P(best passage <= x) = exp(-K n exp(-lambda x)): the likeliest K is a quotient of sums.
    fit = texts.where("toxic = 0").select("raw").mapInPandas(chance, "x double").agg(F.count("*").alias("n"), F.sum("x").alias("x")).first()
    k = fit["n"] / max(fit["x"] or 0.0, 1e-9)

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [figures(s, lam, k)[:3] for s in use.value.of_texts(list(batch["raw"]))]
            yield pd.DataFrame(out, columns=["top", "sure", "n"]).assign(toxic=batch["toxic"].to_numpy())

    rows = texts.mapInPandas(measured, "top double, sure double, n double, toxic int").collect()
    x = np.array([[r["top"], r["sure"], math.log1p(r["n"])] for r in rows])
    return {"scores": scores, "lam": lam, "k": k, "curve": _logistic(x, np.array([r["toxic"] for r in rows], float)), "share": n1 / (n0 + n1)}


def score_column(spark: SparkSession, text: Column, model: dict) -> Column:
    """A struct of score, the number of significant passages and the first and end token of the best one (null without)."""
    use = spark.sparkContext.broadcast(model)

    def scored(raws: pd.Series) -> pd.DataFrame:
        m, out = use.value, []
        for scores in m["scores"].of_texts(list(raws)):
            top, sure, n, start, end = figures(scores, m["lam"], m["k"])
            z = 0.0 if m["curve"] is None else float(np.dot(m["curve"], (1.0, top, sure, math.log1p(n))))
            p = m["share"] if m["curve"] is None else 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
            out.append((p, n, start if end else None, end or None))
        return pd.DataFrame(out, columns=["score", "passages", "start", "end"]).astype({"passages": "int64", "start": "Int64", "end": "Int64"})

    return F.pandas_udf(scored, "score double, passages long, start long, end long")(text.cast("binary"))


def keep_clean(docs: DataFrame, labels: DataFrame, limit: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """The documents, with all their columns, whose score is below the limit."""
    model = learn(docs, labels, sample)
    return docs.where(score_column(docs.sparkSession, docs["text"], model)["score"] < limit)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = learn(docs, load(spark, sf_dir, "labels"))
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(spark, F.col("text"), model).alias("t"))
    return out.select("doc_id", "held_out", F.col("t.score").alias("score"), (F.col("t.score") >= 0.5).cast("int").alias("predicted"), F.col("t.passages").alias("passages"), F.col("t.start").alias("best_start"), F.col("t.end").alias("best_end"))


QUERIES = {"op4_toxicity": op4_toxicity}
