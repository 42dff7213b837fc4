"""Mixing sources to target weights by hash-threshold histograms.

Each document has a 36-bit key, a hash of its id and text. A source takes the documents whose key is below the source's threshold, so
the mix needs no sort and a larger budget always contains a smaller one. The threshold comes from histograms of size by source
and key digit: the first gives the bucket in which the budget ends, and only that bucket is refined by the next digits.

Defined results: null text has size 0; null source is a source of its own, last in order; rows with equal doc_id and
text share a key and are taken together, and only these (a null doc_id counts as an empty id, null text as an empty one); an empty table gives an empty result; a source of size 0 has
target 0. Extra columns are ignored. Sources are a dimension: one row for each is aggregated before any ordering of sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, load, written

WEIGHTS = (5, 2, 1)
LIMIT = 3
#: Sources up to which their thresholds, one row each, are broadcast to the documents; more are joined by shuffle.
BROADCAST_ROWS = 10_000
#: Hexadecimal digits of the key and of each level of refinement.
DIGITS, STEP = 9, 3


def key_column(doc_id: Column, text: Column) -> Column:
    named = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("/mix/"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, DIGITS), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words and the key of each document."""
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), key_column(F.col("doc_id"), F.col("text")).alias("key"))


def targets(by_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """source, source_size -> target: weights repeat in source order and share the whole; what exceeds limit sizes is reshared.

    The repeated resharing ends where target = min(limit * size, level * weight). In order of limit * size / weight the
    sources at their limit come first, so running sums give the level without a loop.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    fill = Window.orderBy("ratio", F.col("source").isNull(), "source")
    whole = Window.partitionBy()
    rows = by_source.withColumn("weight", weight).withColumn("most", F.col("source_size") * limit)
    rows = rows.withColumn("ratio", F.col("most") / F.col("weight"))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0))) / F.sum("weight").over(rest)
    rows = rows.withColumn("level", level).withColumn("full", F.col("ratio") <= F.col("level"))
    level = F.min(F.when(~F.col("full"), F.struct("ratio", "level"))).over(whole)["level"]
    target = F.when(F.col("full"), F.col("most").cast("double")).otherwise(F.col("weight") * level)
    return rows.select("source", "source_size", target.alias("target"))


def thresholds(docs: DataFrame, plan: DataFrame, few: bool = False) -> DataFrame:
    """plan (source, source_size, target) with passes, the whole times the source is taken, and below: documents with a smaller
    key are taken once more. docs: source, size and key; few: whether the sources are few enough to be broadcast."""
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = plan.withColumn("passes", passes.cast("long")).withColumn("left", F.col("target") - F.col("passes") * F.col("source_size"))
    plan = plan.withColumn("low", F.lit(0).cast("long")).withColumn("reached", F.lit(0).cast("long"))
    for level in range(1, DIGITS // STEP + 1):
        width = 16 ** (DIGITS - level * STEP)
        mine = plan.select(F.col("source").alias("s"), "low", "left", "reached")
        inside = F.col("source").eqNullSafe(F.col("s")) & (F.col("key") >= F.col("low")) & (F.col("key") < F.col("low") + width * 16**STEP)
        sums = docs.join(F.broadcast(mine) if few else mine, inside).groupBy("source", "left", "reached", F.floor(F.col("key") / width).alias("bucket")).agg(F.sum("size").alias("sum"))
        upto = F.col("reached") + F.sum("sum").over(Window.partitionBy("source").orderBy("bucket"))
        ends = sums.withColumn("upto", upto).where((F.col("upto") > F.col("left")) & (F.col("upto") - F.col("sum") <= F.col("left")) & (F.col("sum") > 0))
        ends = ends.select(F.col("source").alias("s"), "bucket", "upto", (F.col("upto") - F.col("sum")).alias("from"))
        at = plan.join(ends, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
        low = F.coalesce(F.col("bucket") * width, F.col("low"))
        if level == DIGITS // STEP:
            low = low + F.when(F.col("upto") - F.col("left") < F.col("left") - F.col("from"), 1).otherwise(0)
        plan = at.select("source", "source_size", "target", "passes", "left", low.alias("low"), F.coalesce("from", "reached").alias("reached"))
    return plan.select("source", "source_size", "target", "passes", F.col("low").alias("below"))


def _plan(rows: DataFrame, weights: tuple[int, ...], limit: int) -> tuple[DataFrame, bool]:
    """Thresholds by source, and whether they are few."""
    by_source = written(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    few = by_source.count() <= BROADCAST_ROWS
    return written(thresholds(rows, targets(by_source, weights, limit), few), "thresholds"), few


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """doc_id, size, source_size, target, times and taken = times * size of every document."""
    rows = written(sized(docs), "sized")
    plan, few = _plan(rows, weights, limit)
    plan = plan.withColumnRenamed("source", "s")
    times = F.col("passes") + F.when(F.col("key") < F.col("below"), 1).otherwise(0)
    out = rows.join(F.broadcast(plan) if few else plan, F.col("source").eqNullSafe(F.col("s")))
    return out.select("doc_id", "size", "source_size", "target", times.alias("times"), (times * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """The documents of the mix with all their columns, each as often as it is taken; those that are not taken go.

    The times come from thresholds by source, so documents keep their columns in place and only one row a source is joined.
    """
    rows = written(sized(docs), "sized")
    plan, few = _plan(rows, weights, limit)
    plan = plan.select(F.col("source").alias("_mix_source"), F.col("passes").alias("_mix_passes"), F.col("below").alias("_mix_below"))
    times = F.col("_mix_passes") + F.when(key_column(docs["doc_id"], docs["text"]) < F.col("_mix_below"), 1).otherwise(0)
    out = docs.join(F.broadcast(plan) if few else plan, docs["source"].eqNullSafe(F.col("_mix_source"))).withColumn("_mix_times", times.cast("int"))
    out = out.where("_mix_times > 0").withColumn("_mix_time", F.explode(F.sequence(F.lit(1), F.col("_mix_times"))))
    return out.select(*[out[c] for c in docs.columns])


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(load(spark, sf_dir, "documents"))


SQL = {
    "op5_mix_sources": r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '/mix/' || md5(coalesce(text, ''))), 1, 9) AS BIGINT) AS key
  FROM documents),
by_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT source, source_size, 3 * source_size AS most,
         [5, 2, 1][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS weight FROM by_source),
ratios AS (SELECT *, most / weight AS ratio FROM weighted),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY ratio, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY ratio, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ratios),
goal AS (
  SELECT source, source_size, CASE WHEN ratio <= level THEN CAST(most AS DOUBLE) ELSE weight * (SELECT arg_min(level, ratio) FROM levels WHERE ratio > level) END AS target
  FROM levels),
plan AS (SELECT *, CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS BIGINT) AS passes FROM goal),
by_key AS (SELECT source, key, sum(size) AS s FROM sized GROUP BY source, key),
running AS (SELECT source, key, s, sum(s) OVER (PARTITION BY source ORDER BY key) AS upto FROM by_key),
picked AS (
  SELECT r.source, r.key, (p.target - p.passes * p.source_size) AS room, upto, upto - s AS before
  FROM running r JOIN plan p ON r.source IS NOT DISTINCT FROM p.source)
SELECT d.doc_id, d.size, p.source_size, p.target,
       p.passes + CASE WHEN k.upto <= k.room OR (k.before <= k.room AND k.upto - k.room < k.room - k.before) THEN 1 ELSE 0 END AS times,
       d.size * (p.passes + CASE WHEN k.upto <= k.room OR (k.before <= k.room AND k.upto - k.room < k.room - k.before) THEN 1 ELSE 0 END) AS taken
FROM sized d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source
JOIN picked k ON k.source IS NOT DISTINCT FROM d.source AND k.key = d.key""",
}
QUERIES = {"op5_mix_sources": op5_mix_sources}
