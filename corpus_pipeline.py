"""Corpus pipeline: toxicity filter, near duplicates, repeated passages, source mix and packing, each on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratavox.llm import mixing, ngram_join, packing, substring_dedup, toxicity
from stratavox.llm.common import load, written


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator scores below 0.5; it learns from the labels of documents that are not held out.

    Null and empty texts have the score of a text without any passage and stay; rows without id are scored like others; repeated rows
    stay or go together; an empty table stays empty. Columns are left as they are, in every stage.
    """
    return toxicity.keep_clean(docs, load(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near duplicates, rows without id last.

    Of equal rows one stays; null, empty and blank texts are linked with nothing and all stay but for equal rows; rows of one id with
    different texts are judged each by its text.
    """
    return ngram_join.keep_one(docs)


def cut(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that an earlier one has: of smaller id, or any with an id before rows without.

    Null and empty texts stay as they are; a text that is a copy of an earlier one becomes empty; equal rows (same id and text) are one
    document and stay whole; further texts of an id come after all other documents.
    """
    return substring_dedup.cut_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    Null and empty texts have size 0 and are taken or not by their key; null source is a source of its own; equal rows (same id and
    text) are taken together.
    """
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences.

    Null and empty texts are the closing id alone; repeated rows and rows without id are packed each for itself; an empty table gives
    no piece.
    """
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", clean), ("near_duplicates", one_of_each), ("substring_dedup", cut), ("mixing", mix), ("packing", pack)]
#: Scores, hashed sets and tokenizers have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet and read again as the next one's documents."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
