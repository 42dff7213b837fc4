"""N-gram Jaccard join with set-relation skipping, exact.

A document's set holds the hashes of its 5-word shingles. Equal sets are one class; only one row of a class goes on. Two sets
of similarity 0.8 share a token among the first n / 5 + 1 of either in any common order. Two orders are used. The first counts
only tokens whose hash lies in the low ``SHARE`` of the range, which come first, by the number of sets that hold them; a set
that has no shared token in its prefix is done. The sets that are left, which are few, are counted in full among themselves, and
index lists are kept for their prefixes, rarest tokens first.

Index-level skipping: the entries of a list are blocks of one set size and position, and two blocks whose sizes or remaining
positions cannot reach the overlap are skipped whole. Answer-level skipping: every set is first verified against the most
central set that shares a prefix token with it, which settles groups of near copies in one comparison a member; sets whose
answers already lie in one component are skipped wherever they meet again, and of the others those that the triangle
inequality over a common verified set excludes. What remains of every list is compared in full, so no link between components
is lost, and pairs within a group are never all written out.

Words are hashed to 64 bits, and sets compared by hashes of 64 bits; a collision would have to fall within one pair of sets.
Class ids are hashes of 64 bits of the whole set.

Defined results: null text, empty text and white space give the empty set, linked with nothing; with 1 to 4 words the whole
sequence is one shingle; rows with equal doc_id are judged each by its text; extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, load, written
from .components import components
from .shingling import batch_shingles, distinct, fingerprint

#: Similarity as a fraction: 4 / 5.
NUM, DEN = 4, 5
#: Share of the hash range whose tokens are counted; rows (two numbers each) up to which a table is broadcast.
SHARE, BROADCAST_ROWS = 0.26, 500_000
#: Star rounds, pairs for each index entry at which the full comparison starts at once, members of a block.
ROUNDS, FEW, BLOCK = 4, 4, 128


def _sets(docs: DataFrame, what: str) -> DataFrame:
    """doc_id, text_hash, cid (null for the empty set), n, low, and of the tokens: nothing, the first ones (low and as many as the
    prefix), or all."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        edge = np.uint64(int(SHARE * 2**64))
        for batch in batches:
            for at in range(0, len(batch), 500):
                some = batch.iloc[at : at + 500]
                sets = [distinct(x) for x in batch_shingles(list(some["raw"]))]
                low = [int(np.searchsorted(s, edge)) for s in sets]
                out = {"doc_id": some["doc_id"].to_numpy(), "text_hash": some["text_hash"].to_numpy(), "cid": pd.array([fingerprint(s) for s in sets], "Int64"), "n": [len(s) for s in sets], "low": low}
                if what == "first":
                    out["tokens"] = [s[: max(k, len(s) // DEN + 1)].view(np.int64) for s, k in zip(sets, low, strict=True)]
                elif what == "all":
                    out["tokens"] = [s.view(np.int64) for s in sets]
                yield pd.DataFrame(out)

    names = "doc_id long, text_hash long, cid long, n int, low int" + (", tokens array<long>" if what else "")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("raw"))
    return rows.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID))).mapInPandas(made, names)


#: Stands for a null doc_id within tasks, where integers have no null; and where rows without id come last.
NO_ID, LAST_ID = -(1 << 63), (1 << 63) - 1


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _counted(sets: DataFrame) -> DataFrame:
    """token, cid, n, low, high, df: the entries of tokens that two sets or more hold. high: the place of a token that is not low."""
    rows = sets.select("cid", "n", "low", F.posexplode("tokens").alias("at", "token"))
    rows = rows.select("token", "cid", "n", "low", F.when(F.col("at") >= F.col("low"), F.col("at")).alias("high"))
    # A set has a token once, so however many sets share one, it holds a small part of all rows, which a window reads in a stream.
    return rows.withColumn("df", F.count("*").over(Window.partitionBy("token"))).where(F.col("df") > 1)


def may_have_links(sets: DataFrame) -> DataFrame:
    """cid of the sets whose prefix holds a token that another set has too, by the low tokens (all first tokens of short sets)."""
    found = _counted(sets).groupBy("cid", "n", "low").agg(F.count(F.when(F.col("high").isNull(), 1)).alias("shared"), F.count("high").alias("high"))
    alone = F.col("low") - F.col("shared")
    return found.where((alone < F.floor(F.col("n") / DEN) + 1) & ((F.col("shared") > 0) | (F.col("high") > 0))).select("cid")


def prefixes(sets: DataFrame) -> DataFrame:
    """token, cid, n, pos, own: the index entries. sets: cid, n, tokens (all). own: the share of a set's tokens that no other has;
    the lower it is, the more central is the set. Sets whose own tokens alone exclude every partner have no entries."""
    rows = _counted(sets.withColumn("low", F.col("n")))
    mine = Window.partitionBy("cid")
    rows = rows.withColumn("alone", F.col("n") - F.count("*").over(mine))
    rows = rows.where(F.col("alone") < F.floor(F.col("n") / DEN) + 1)
    rows = rows.withColumn("pos", (F.col("alone") + F.row_number().over(mine.orderBy("df", "token")) - 1).cast("int"))
    return rows.where(F.col("pos") < F.floor(F.col("n") / DEN) + 1).select("token", "cid", "n", "pos", F.round(F.col("alone") / F.col("n"), 4).alias("own"))


def may_link(n: Column, pos: Column, m: Column, at: Column) -> Column:
    """Whether sets of sizes n and m whose first common token is at these positions can overlap enough."""
    sizes = (F.least(n, m) * DEN >= F.greatest(n, m) * NUM)
    return sizes & (F.least(n - pos, m - at) * (NUM + DEN) >= (n + m) * NUM)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, d of pairs a, b that link: d is the Jaccard distance. All pairs are returned, link says which do."""
    left = sets.select(F.col("cid").alias("a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("cid").alias("b"), F.col("tokens").alias("y"))
    rows = pairs.join(left, "a").join(right, "b")
    both = F.size(F.array_intersect("x", "y"))
    rows = rows.select("a", "b", both.cast("long").alias("both"), (F.size("x") + F.size("y")).cast("long").alias("sum"))
    either = F.col("sum") - F.col("both")
    return rows.select("a", "b", (F.col("both") * DEN >= either * NUM).alias("link"), (1 - F.col("both") / either).alias("d"))


def _star(entries: DataFrame, turn: int) -> DataFrame:
    """a, b: for every set the most central set of another component among the pivots of its index lists.

    entries: token, cid, n, pos, own, comp. The pivot of a list is its most central set at first; later the choice turns among
    the components by a hash, so that lists which hold several are looked at from several sides.
    """
    by = F.struct("own", (-F.col("n")).alias("size"), "cid") if not turn else F.struct(F.xxhash64("comp", F.lit(turn)).alias("turn"), "own", "cid")
    pivot = entries.groupBy("token").agg(F.min(F.struct(by.alias("by"), F.struct("cid", "n", "pos", "own", "comp").alias("p"))).alias("q"), F.count("*").alias("k"), F.min("comp").alias("c0"), F.max("comp").alias("c1"))
    pivot = pivot.where((F.col("k") > 1) & (F.col("c0") != F.col("c1"))).select("token", "q.p")
    met = entries.join(pivot, "token").where((F.col("p.comp") != F.col("comp")) & may_link(F.col("n"), F.col("pos"), F.col("p.n"), F.col("p.pos")))
    return met.groupBy(F.col("cid").alias("a")).agg(F.min(F.struct("p.own", "p.cid")).alias("p")).select("a", F.col("p.cid").alias("b"))


def _rest(entries: DataFrame, known: DataFrame) -> DataFrame:
    """a, b: all pairs of different components that index lists leave after skipping. known: a, b, d verified."""
    near = known.groupBy(F.col("a").alias("cid")).agg(F.min(F.struct("d", "b")).alias("near"))
    lists = entries.groupBy("token").agg(F.count("*").alias("k"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where((F.col("k") > 1) & (F.col("c0") != F.col("c1")))
    rows = entries.join(lists.select("token", "k"), "token").join(near, "cid", "left")
    part = F.pmod(F.xxhash64("cid"), F.ceil(F.col("k") / BLOCK)).alias("part")
    blocks = rows.groupBy("token", "n", "pos", "comp", part).agg(F.collect_list(F.struct("cid", F.col("near.b").alias("p"), F.col("near.d").alias("d"))).alias("sets"))
    other = blocks.select("token", F.col("n").alias("m"), F.col("pos").alias("at"), F.col("comp").alias("comp2"), F.col("sets").alias("sets2"))
    met = blocks.join(other, "token").where((F.col("comp") < F.col("comp2")) & may_link(F.col("n"), F.col("pos"), F.col("m"), F.col("at")))
    met = met.select(F.explode("sets").alias("s"), "sets2").select("s", F.explode("sets2").alias("t"))
    # Both were verified against one set: distances that differ by more than 1 - 0.8 exclude a link.
    far = F.coalesce((F.col("s.p") == F.col("t.p")) & (F.abs(F.col("s.d") - F.col("t.d")) > 1 - NUM / DEN + 1e-9), F.lit(False))
    return met.where(~far).select(F.least("s.cid", "t.cid").alias("a"), F.greatest("s.cid", "t.cid").alias("b")).distinct()


def _with_components(entries: DataFrame, links: DataFrame) -> DataFrame:
    comp = components(links).withColumnRenamed("id", "cid")
    return entries.drop("comp").join(comp, "cid", "left").withColumn("comp", F.coalesce("component", "cid")).drop("component")


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members: doc_id, text_hash, cid, n of every row; edges: a, b between classes whose components are those of all links)."""
    bound_batches(docs.sparkSession)
    members = written(_sets(docs, ""), "members").drop("low")
    classes = members.where(F.col("cid").isNotNull()).groupBy("cid").agg(F.min("doc_id").alias("doc_id"))
    spare = written(members.where(F.col("cid").isNotNull()).join(classes.withColumnRenamed("doc_id", "first"), "cid").where(F.col("doc_id") != F.col("first")).select("doc_id", "cid").distinct(), "spare")
    first = _sets(docs, "first").where(F.col("cid").isNotNull()).join(_small(spare, spare.count()), ["doc_id", "cid"], "left_anti")
    needed = written(may_have_links(first).join(classes, "cid"), "needed")
    sets = written(_sets(docs, "all").join(_small(needed, needed.count()), ["doc_id", "cid"], "left_semi").select("cid", "n", "tokens").dropDuplicates(["cid"]), "sets")
    entries = written(prefixes(sets), "entries")
    entries = entries.withColumn("comp", F.col("cid"))
    total, known = entries.count(), None
    for turn in range(ROUNDS):
        found = written(verified(_star(entries, turn), sets), "verified")
        known = found if known is None else known.unionByName(found)
        if not found.where("link").limit(1).count():
            break
        entries = written(_with_components(entries, known.where("link")), "entries")
        each = entries.groupBy("token", "comp").agg(F.count("*").alias("k")).groupBy("token").agg(((F.pow(F.sum("k"), 2) - F.sum(F.col("k") * F.col("k"))) / 2).alias("pairs"))
        if (each.agg(F.sum("pairs")).first()[0] or 0) <= FEW * total:
            break
    rest = written(verified(_rest(entries, known), sets), "rest")
    return members, known.unionByName(rest).where("link").select("a", "b")


def _with_comp(docs: DataFrame) -> DataFrame:
    """members with comp, the least class id of a row's component; null for the empty set."""
    members, edges = links(docs)
    found = written(components(edges), "components").withColumnRenamed("id", "cid")
    return members.join(found, "cid", "left").withColumn("comp", F.coalesce("component", "cid"))


def join_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    rows = _with_comp(docs).withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))
    # The smallest id is aggregated before the shuffle; a hot component meets one row in the join.
    least = rows.where(F.col("comp").isNotNull()).groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    out = rows.join(least, "comp", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents, with all their columns, one row of each component: that of smallest doc_id (rows without id are last), and
    of several rows with this id one. A row is judged by its id and text, so other rows of its id do not go with it."""
    rows = written(_with_comp(docs).where(F.col("comp").isNotNull()).withColumn("rank", F.when(F.col("doc_id") == NO_ID, LAST_ID).otherwise(F.col("doc_id"))), "ranked")
    least = rows.groupBy("comp").agg(F.min("rank").alias("least"))
    best = rows.join(least, "comp").where(F.col("rank") == F.col("least")).groupBy("comp", "least").agg(F.min("text_hash").alias("kept"))
    rows = rows.join(best, "comp").withColumn("go", (F.col("rank") != F.col("least")) | (F.col("text_hash") != F.col("kept")))
    gone = written(rows.where("go").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct(), "gone")
    again = written(rows.where("not go").groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).count().where("count > 1").drop("count"), "again")
    key = [F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)).alias("_id"), F.xxhash64(docs["text"]).alias("_hash")]
    left = docs.select("*", *key).join(_small(gone, gone.count()), ["_id", "_hash"], "left_anti")
    several = again.count()
    if several:  # equal rows, of which one stays
        once = left.join(_small(again, several), ["_id", "_hash"], "left_semi").dropDuplicates(["_id", "_hash"])
        left = left.join(_small(again, several), ["_id", "_hash"], "left_anti").unionByName(once)
    return left.select(*docs.columns)


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_groups(load(spark, sf_dir, "documents"))


SQL = {
    "op7_ngram_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(array_to_string(ws[i:i + 4], ' ')) AS k
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
link AS MATERIALIZED (SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, (SELECT min(b) FROM reach WHERE reach.a = w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id""",
}
QUERIES = {"op7_ngram_join": op7_ngram_join}
