"""An extension: jobs as a stream. Requests arrive as files, each micro-batch runs as one batch, and states are a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

REQUEST = "job_id string, submitted timestamp, fixed string, moving string, preset string"


def requests(spark: SparkSession, path: str, late: str = "1 hour") -> DataFrame:
    """Requests from JSON files, each job_id once; ids are forgotten when the watermark has passed them."""
    rows = spark.readStream.schema(REQUEST).json(path)
    return rows.withWatermark("submitted", late).dropDuplicatesWithinWatermark(["job_id"])


def run_stream(rows: DataFrame, run: Callable[[DataFrame], DataFrame], states: str, checkpoint: str) -> StreamingQuery:
    """Run every micro-batch of requests; run returns job_id and status. A batch that is repeated after a failure writes under the
    same number, and so replaces what it left."""

    def batch(df: DataFrame, number: int) -> None:
        done = run(df).select("job_id", "status", F.lit(number).alias("batch"))
        done.write.mode("overwrite").parquet(f"{states}/batch={number}")

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
