"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import bucketed, shared_folder, written  # noqa: F401

#: A word: a run of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"

#: A-Z to a-z, everything else unchanged, for bytes in UTF-8.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of texts that a Python worker gets at a time, where the session sets no bound of its own.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "2m"


def bound_batches(spark: SparkSession) -> None:
    """Rows hold whole texts, so Arrow batches are bounded by bytes rather than rows; a bound that the session has is kept."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else (``lower`` also maps other alphabets)."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: str | bytes | None, lower: bool = False) -> list[bytes]:
    """The words of a text as UTF-8; ``bytes.split`` cuts at exactly the characters that WORD leaves out."""
    if text is None:
        return []
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text
    return (raw.translate(LOWER) if lower else raw).split()


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/stratavox-{uuid.uuid4().hex}/{label}"
