"""An extension: the life of jobs as state. Events arrive late, twice and in any order; every job ends in one state."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENT = "job_id string, kind string, at timestamp"
STATES = "job_id string, status string, at timestamp"
#: States in the order in which a job passes through them; from FINAL on there is no further one.
ORDER, FINAL = ("queued", "running", "done", "error", "expired"), 2


class Jobs(StatefulProcessor):
    """Keeps the state of each job and its time, and a timer that lets a job expire that has not ended in time.

    An event counts if its state is further on than the job's and the job has not ended; so repeated and late events change nothing,
    and of two ends in one batch the earlier one stands. An unknown kind is left out.
    """

    def __init__(self, limit_ms: int) -> None:
        self.limit_ms = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "rank int, at long")

    def _timer(self, at: int | None) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if at is not None:
            self.handle.registerTimer(at)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        events = pd.concat(list(rows))
        events = events[events["kind"].isin(ORDER[:4]) & events["at"].notna()]
        rank, at = self.state.get() if self.state.exists() else (-1, 0)
        steps = sorted((int(t.timestamp() * 1000), ORDER.index(k)) for t, k in zip(events["at"], events["kind"], strict=True))
        changes = []
        for when, step in steps:
            if rank < FINAL and step > rank:
                rank, at = step, when
                changes.append((key[0], ORDER[rank], pd.Timestamp(when, unit="ms")))
        if changes:
            self.state.update((rank, at))
            self._timer(None if rank >= FINAL else at + self.limit_ms)
        yield pd.DataFrame(changes, columns=["job_id", "status", "at"]).astype({"at": "datetime64[ns]"})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        rank, at = self.state.get() if self.state.exists() else (FINAL, 0)
        found = []
        if rank < FINAL:
            self.state.update((ORDER.index("expired"), at))
            found.append((key[0], "expired", pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")))
        yield pd.DataFrame(found, columns=["job_id", "status", "at"]).astype({"at": "datetime64[ns]"})

    def close(self) -> None:
        pass


def events(spark: SparkSession, path: str, late: str = "1 hour") -> DataFrame:
    """Events from JSON files."""
    return spark.readStream.schema(EVENT).json(path).withWatermark("at", late)


def changes(rows: DataFrame, limit_ms: int = 6 * 3_600_000) -> DataFrame:
    """job_id, status, at of every change of state. A job that has not ended ``limit_ms`` after its last change expires when the
    watermark has passed that time. State is kept in RocksDB, so it is not bounded by an executor's memory."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return rows.groupBy("job_id").transformWithStateInPandas(Jobs(limit_ms), STATES, "Append", "EventTime")


def latest(states: DataFrame) -> DataFrame:
    """job_id, status, at: the last state of each job of a table of changes."""
    rank = F.array_position(F.array(*map(F.lit, ORDER)), F.col("status"))
    return states.groupBy("job_id").agg(F.max(F.struct(rank.alias("r"), "status", "at")).alias("s")).select("job_id", "s.status", "s.at")
