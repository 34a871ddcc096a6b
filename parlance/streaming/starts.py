"""JOIN-3 as a stream (STR-2 for live jobs): submissions against the state their job is in.

Every job is a small state machine: the status of its newest event.  A submission starts a job that is not known, starts it
again under its own name if it has ended (COMPLETED, FAILED), and starts one of a unique name beside it while it is
live, however long that takes: there is no time window.  The state of a job is forgotten when the watermark is ``keep``
beyond its newest event; after that its name is new again.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from parlance.operators.jobs import start_action

_OUT = "job_name string, event_id bigint, ts timestamp, prior_status string"


class LiveJobs(StatefulProcessor):
    """The newest (ts, event_id, status) of a job; gives the status before each submission.

    Events of one micro-batch count in ``(ts, event_id)`` order, and four numbers of each are held while they are
    sorted (``maxFilesPerTrigger`` bounds them).  An event older than the newest of an earlier batch does not change the state; a
    submission that comes so late is decided by the state there is, since that job may run already."""

    def __init__(self, keep_s: int):
        self.keep_us = keep_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "us bigint, event_id bigint, status string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts = [p[["us", "event_id", "status", "submission"]] for p in rows]
        events = pd.concat(parts).sort_values(["us", "event_id"], kind="stable")
        known = self.newest.get() if self.newest.exists() else None
        us, ids, status = (events[c].tolist() for c in ("us", "event_id", "status"))
        prior = []
        before = known
        for now in zip(us, ids, status):
            prior.append(None if known is None else known[2])
            if known is None or (now[0], now[1]) >= (known[0], known[1]):
                known = now
        if before is None or tuple(before) != tuple(known):
            if before is not None:
                self.handle.deleteTimer(self._expiry(before[0]))
            self.newest.update(known)
            self.handle.registerTimer(max(self._expiry(known[0]), timerValues.getCurrentWatermarkInMs() + 1))
        asked = np.flatnonzero(events["submission"].to_numpy(bool))
        if len(asked):
            yield pd.DataFrame({
                "job_name": [key[0]] * len(asked), "event_id": [ids[i] for i in asked],
                "ts": pd.to_datetime([us[i] for i in asked], unit="us", utc=True), "prior_status": pd.Series([prior[i] for i in asked], dtype=object),
            })

    def _expiry(self, us: int) -> int:
        return (us + self.keep_us) // 1000

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.newest.exists() and self._expiry(self.newest.get()[0]) <= timerValues.getCurrentWatermarkInMs():
            self.newest.clear()
        yield from ()


@contextmanager
def keyed_state(spark: SparkSession):
    """Streams started inside keep their state in RocksDB, which ``transformWithState`` needs."""
    name, value = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def job_start_stream(events: DataFrame, submission, *, job: str = "job_name", delay: str = "1 hour", keep_s: int = 90 * 86_400) -> DataFrame:
    """``events`` (job, event_id, ts, status) as a stream, ``submission`` a boolean column that marks submissions.
    One row per submission, at once: event_id, job, ``prior_status``, ``action``, ``start_name`` and ``record_status``, as
    ``plan_job_starts`` gives them for the log so far.  Events without a job start nothing.  Run it inside ``keyed_state``."""
    narrow = events.where(F.col(job).isNotNull()).withWatermark("ts", delay).select(
        F.col(job).alias("job_name"), "event_id", "ts", F.unix_micros("ts").alias("us"), "status", submission.alias("submission")
    )
    asked = narrow.groupBy("job_name").transformWithStateInPandas(LiveJobs(keep_s), _OUT, "Append", "EventTime")
    action, name = start_action(F.col("prior_status"), "job_name", "event_id")
    return asked.select("event_id", F.col("job_name").alias(job), "prior_status", action.alias("action"), name.alias("start_name"), F.lit("QUEUED").alias("record_status"))
