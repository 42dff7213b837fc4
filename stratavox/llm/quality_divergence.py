"""Quality rules: base rules of repetition, then divergence from the document's language.

A document's histograms of character classes and of common words are compared to those of its language by the Jensen-Shannon
distance (base 2, 0 to 1). The references are sums over all documents of the language; a common word is one that makes up
``COMMON`` of the language's words, so there are at most 1 / COMMON of them. Documents below a minimum length are not judged
by a histogram that they are too short for.

Everything runs as Spark expressions: words become hashes, five-word windows hashes of these, and repeated windows are found
by sorting a document's own window hashes, only where there are any.

Defined results: null text has no words, and fails the base rules as every text below 10 words; null lang is a language of its
own; repeated rows get equal results and count as often as they occur; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, load, written

WINDOW = 5
#: Base rules: least words, and most percent of words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 10, 20
#: Share that makes a word common; least characters and words to be judged; most distance of classes and of words.
COMMON, LEAST_CHARS, LEAST_JUDGED, MOST_CLASS, MOST_WORD = 0.01, 200, 50, 0.3, 0.4
CLASSES = {"upper": "[A-Z]", "digit": "[0-9]", "mark": "[.,;:!?'\"()-]", "symbol": r"[#*$%&|<>+/=@\[\]\\^_`{}~]", "space": r"[\x20\x09-\x0D]", "wide": r"[^\x00-\x7F]"}
#: Languages up to which their references (one row of bounded size each) are broadcast.
BROADCAST_ROWS = 2000


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, also inside of other lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words_column(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """The number of words in windows that occur twice or more in the text."""

    def windows(h: Column) -> Column:
        last = F.size(h) - width
        return F.when(last < 1, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)])))

    def covered(w: Column) -> Column:
        pairs = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = lambda x, j: F.coalesce(x["h"] == F.get(s, j)["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))

        def length(p: Column) -> Column:
            return F.aggregate(F.transform(p, lambda x, j: F.coalesce(F.least(F.get(p, j + 1) - x, F.lit(width)), F.lit(width))), F.lit(0).cast("long"), lambda a, x: a + x)

        return let(let(pairs, twice), length)

    hashes = F.transform(words, lambda x: F.xxhash64(x))
    return let(let(hashes, windows), lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(covered(w)))


def duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(WORD))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def class_counts(text: Column) -> Column:
    """Characters by class, the last being all other ASCII (letters a to z)."""
    counted = [F.coalesce(F.regexp_count(text, F.lit(p)), F.lit(0)).cast("double") for p in CLASSES.values()]
    return let(F.array(*counted), lambda c: F.concat(c, F.array(F.coalesce(F.length(text), F.lit(0)) - F.aggregate(c, F.lit(0.0), lambda a, x: a + x))))


def word_counts(words: Column, common: Column) -> Column:
    """How often each common word occurs, and the number of all others."""
    found = F.filter(words, lambda x: F.array_contains(common, x))
    return let(found, lambda f: F.concat(F.transform(common, lambda c: F.size(F.filter(f, lambda x: x == c)).cast("double")), F.array((F.size(words) - F.size(f)).cast("double"))))


def distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of two histograms given as counts; null if either is empty."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    part = lambda p, m: F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)

    def divergence(n: Column, r: Column) -> Column:
        terms = F.zip_with(counts, reference, lambda x, y: let(F.struct((x / n).alias("p"), (y / r).alias("q")), lambda z: (part(z["p"], (z["p"] + z["q"]) / 2) + part(z["q"], (z["p"] + z["q"]) / 2)) / 2))
        return F.sqrt(F.greatest(F.lit(0.0), total(terms)))

    return let(total(counts), lambda n: let(total(reference), lambda r: F.when((n > 0) & (r > 0), divergence(n, r))))


def common_words(docs: DataFrame) -> DataFrame:
    """l (lang), common: words in order that make up COMMON of all words of the language, and word_sums: their counts and that of all
    others. One row a language with words.

    Words are summed in the map tasks before the shuffle, so a language that most documents have is no hot key.
    """
    counts = docs.select("lang", F.explode(words_column(F.col("text"))).alias("word")).groupBy("lang", "word").agg(F.count("*").cast("double").alias("n"))
    # Words that occur once are never common: only their number is kept.
    counts = counts.groupBy("lang", F.when(F.col("n") > 1, F.col("word")).alias("word")).agg(F.sum("n").alias("n"))
    counts = written(counts, "words")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total")).withColumnRenamed("lang", "l")
    found = counts.join(totals, F.col("lang").eqNullSafe(F.col("l"))).drop("lang")
    # At most 1 / COMMON words of a language reach the share, so the list is bounded.
    is_common = F.col("word").isNotNull() & (F.col("n") >= F.greatest(F.col("total") * COMMON, F.lit(2.0)))
    found = found.groupBy("l", "total").agg(F.sort_array(F.collect_list(F.when(is_common, F.struct("word", "n")))).alias("common"))
    return found.select("l", F.col("common.word").alias("common"), F.concat("common.n", F.array(F.col("total") - F.aggregate("common.n", F.lit(0.0), lambda a, x: a + x))).alias("word_sums"))


def figures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the base figures, the counts of classes (null below LEAST_CHARS characters) and of common words (null below
    LEAST_JUDGED words) of every document, and the class counts that go into the references; words are taken from the text once."""
    found = _small(written(common_words(docs), "common"))
    rows = docs.select("doc_id", "lang", "text").join(found, F.col("lang").eqNullSafe(F.col("l")), "left")
    text, common = F.col("text"), F.coalesce("common", F.array().cast("array<string>"))

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.aggregate(words, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
            repeated_words(words).alias("n_repeat_words"),
            F.when(F.size(words) >= LEAST_JUDGED, word_counts(words, common)).alias("word_counts"),
        )

    symbols = F.coalesce(F.regexp_count(text, F.lit("[#*$%&|<>]")), F.lit(0)).cast("long")
    rows = rows.select("doc_id", "lang", let(words_column(text), of_words).alias("x"), symbols.alias("n_symbols"), duplicate_lines(text).alias("n_dup_lines"), F.coalesce(F.length(text), F.lit(0)).alias("chars"), class_counts(text).alias("class_counts"), F.coalesce("word_sums", F.array(F.lit(1.0))).alias("word_sums"))
    return rows.select("doc_id", "lang", "x.*", "n_symbols", "n_dup_lines", "chars", "class_counts", "word_sums")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the base figures, both distances and kept, for every document. Texts are read twice: for the common words of the
    languages, and for the figures, from whose table the class references are summed and documents are judged."""
    rows = written(figures(docs), "figures")
    sums = rows.groupBy("lang").agg(F.array(*[F.sum(F.get("class_counts", F.lit(i))) for i in range(len(CLASSES) + 1)]).alias("class_sums"))
    sums = _small(written(sums.withColumnRenamed("lang", "l"), "sums"))
    rows = rows.join(sums, F.col("lang").eqNullSafe(F.col("l")))
    n_words = F.col("n_words")
    rows = rows.withColumn("class_distance", F.when(F.col("chars") >= LEAST_CHARS, distance(F.col("class_counts"), F.col("class_sums"))))
    rows = rows.withColumn("word_distance", F.when(F.col("word_counts").isNotNull(), distance(F.col("word_counts"), F.col("word_sums"))))
    failed = (n_words < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * n_words)
    strange = (F.coalesce(F.col("class_distance"), F.lit(0.0)) > MOST_CLASS) | (F.coalesce(F.col("word_distance"), F.lit(0.0)) > MOST_WORD)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~strange).alias("kept"), F.round("class_distance", 6).alias("class_distance"), F.round("word_distance", 6).alias("word_distance"))


def op8_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(load(spark, sf_dir, "documents"))


_COUNTS = ", ".join(f"CAST(len(regexp_extract_all(t, '{p.replace(chr(39), chr(39) * 2)}')) AS DOUBLE)" for p in CLASSES.values())


def _distance_sql(counts: str, reference: str) -> str:
    """The same distance over two lists of counts."""
    p, q = f"({counts}[i] / list_sum({counts}))", f"({reference}[i] / list_sum({reference}))"
    half = lambda a: f"CASE WHEN {a} > 0 THEN {a} * log2({a} / (({p} + {q}) / 2)) ELSE 0 END"
    return f"round(sqrt(greatest(0, list_sum(list_transform(range(1, len({reference}) + 1), lambda i: ({half(p)} + {half(q)}) / 2)))), 6)"


SQL = {
    "op8_quality_divergence": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, [{_COUNTS}] AS c0 FROM d),
cc AS (SELECT *, list_append(c0, length(t) - list_sum(c0)) AS c FROM w),
sums AS (SELECT lang, [{", ".join(f"sum(c[{i + 1}])" for i in range(len(CLASSES) + 1))}] AS class_sums, CAST(sum(len(ws)) AS DOUBLE) AS total FROM cc GROUP BY lang),
each_word AS (SELECT lang, unnest(ws) AS word FROM w),
per_word AS (SELECT lang, word, CAST(count(*) AS DOUBLE) AS n FROM each_word GROUP BY lang, word HAVING count(*) > 1),
common AS (SELECT p.lang, list(p.word ORDER BY p.word) AS common, list(p.n ORDER BY p.word) AS ns
           FROM per_word p JOIN sums s ON p.lang IS NOT DISTINCT FROM s.lang WHERE p.n >= greatest(s.total * {COMMON}, 2) GROUP BY p.lang),
refs AS (SELECT s.lang, class_sums, coalesce(common, []) AS common, CASE WHEN ns IS NULL THEN [1.0] ELSE list_append(ns, total - list_sum(ns)) END AS word_sums
         FROM sums s LEFT JOIN common c ON c.lang IS NOT DISTINCT FROM s.lang),
win AS (SELECT r, i, array_to_string(ws[i:i + 4], ' ') AS k FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM win) WHERE c > 1),
cov AS (SELECT r, CAST(count(DISTINCT j) AS BIGINT) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 5)) AS j FROM rep) GROUP BY r),
f AS (SELECT cc.r, cc.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
        CAST(len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
        coalesce(cov.n_repeat_words, 0) AS n_repeat_words, length(t) AS chars, c, class_sums, word_sums, common,
        list_append(list_transform(common, lambda x: CAST(len(list_filter(ws, lambda y: y = x)) AS DOUBLE)), CAST(len(list_filter(ws, lambda y: NOT list_contains(common, y))) AS DOUBLE)) AS wc
      FROM cc JOIN refs ON refs.lang IS NOT DISTINCT FROM cc.lang LEFT JOIN cov ON cov.r = cc.r),
g AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
        CASE WHEN chars >= {LEAST_CHARS} THEN {_distance_sql("c", "class_sums")} END AS class_distance,
        CASE WHEN n_words >= {LEAST_JUDGED} THEN {_distance_sql("wc", "word_sums")} END AS word_distance FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (coalesce(class_distance, 0) > {MOST_CLASS} OR coalesce(word_distance, 0) > {MOST_WORD}) AS kept, class_distance, word_distance
FROM g""",
}
QUERIES = {"op8_quality_divergence": op8_quality_divergence}
