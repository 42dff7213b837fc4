"""Tables in the folder that the driver and all executors share, for results that several steps read and for loops."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Bytes that a Python worker gets at a time, at least one row, where the session sets no bound of its own.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "2m"


def bound_batches(spark: SparkSession) -> None:
    """Rows hold whole planes, bricks or files, so Arrow batches are bounded by bytes rather than rows; a bound that the session has
    is kept."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where that is unset and all tasks run in this process."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = getattr(context, "_stratavox_folder", None) or tempfile.mkdtemp(prefix="stratavox-")
        context._stratavox_folder = found
    return found.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write as Parquet and read back: cuts the lineage, survives lost executors, and is computed once."""
    path = f"{shared_folder(df.sparkSession)}/stratavox-{uuid.uuid4().hex}/{label}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, label: str) -> DataFrame:
    """Write as Parquet in as many buckets of ``key`` as the session has shuffle partitions, and read back: several joins on the key
    then move the other side alone. The name is gone at once; the plan keeps files and buckets, which lie in the shared folder."""
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"stratavox_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/stratavox-{uuid.uuid4().hex}/{label}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name, format="parquet")
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table
