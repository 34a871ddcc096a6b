"""Structured Streaming versions of the upload / status / result flows (STR-1..5).

Every flow is a function from a streaming DataFrame to a streaming DataFrame;
``run_to_table`` drives one with ``trigger(availableNow=True)`` into a Parquet
table (file sink or ``foreachBatch`` with an idempotent overwrite).  Given the same
folder again it goes on from its checkpoint, so runs are exactly-once and
restartable, and nothing is collected on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from parlance.operators.uploads import derive_job_keys, validate_uploads
from parlance.schemas import TERMINAL_STATES
from parlance.session import scratch_path


def run_to_table(
    sdf: DataFrame, spark: SparkSession, name: str, mode: str = "append", state_partitions: int | None = None,
    key: list[str] | None = None, path: str | None = None,
) -> DataFrame:
    """Run a stream over all that is there now (availableNow) and return the written table.

    ``path`` holds the table and the checkpoint; calling again with the same path goes on
    where the last run ended (default: a new folder, for one run).  ``append`` uses the
    file sink, ``complete`` overwrites the table with each batch's whole result.
    ``update`` needs ``key``: each batch's changed rows are stored under its batch id (a
    repeated batch replaces itself), and of each key the row of the last batch counts.

    ``state_partitions`` chooses the number of state-store partitions of the
    stream's stateful operators; it is recorded in the checkpoint at the first
    batch and cannot change afterwards, so it is a per-stream decision (default:
    the session's ``spark.sql.shuffle.partitions``)."""
    if mode == "update" and not key:
        raise ValueError("update needs the key columns of the result")
    setting = "spark.sql.shuffle.partitions"
    previous = spark.conf.get(setting)
    if state_partitions:
        spark.conf.set(setting, str(int(state_partitions)))
    try:
        return _run(sdf, spark, mode, key, path or scratch_path(spark, name))
    finally:
        spark.conf.set(setting, previous)


def _run(sdf: DataFrame, spark: SparkSession, mode: str, key: list[str] | None, out: str) -> DataFrame:
    data = f"{out}/data"
    if mode == "append":
        q = sdf.writeStream.format("parquet").option("path", data)
    elif mode == "complete":
        q = sdf.writeStream.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(data))
    else:

        def store(batch: DataFrame, batch_id: int) -> None:
            stored = batch.withColumn("_batch", F.lit(batch_id).cast("bigint"))
            stored.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_batch").parquet(data)

        q = sdf.writeStream.foreachBatch(store)
    q = q.option("checkpointLocation", f"{out}/_checkpoint").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    if mode != "update":
        return spark.read.schema(sdf.schema).parquet(data)
    rows = spark.read.schema(T.StructType([*sdf.schema.fields, T.StructField("_batch", T.LongType())])).parquet(data)
    last = rows.groupBy(*key).agg(F.max("_batch").alias("_batch"))
    return rows.join(last, [*key, "_batch"]).select(*sdf.columns)


# ---------------------------------------------------------------------------
# STR-1 upload trigger


def upload_stream(uploads: DataFrame) -> DataFrame:
    """Every created object becomes a validated job request (PRJ-1 + PRJ-2..4)."""
    return derive_job_keys(validate_uploads(uploads))


def notification_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """STR-1 + SRC-1 as a stream: object-created notification files (JSON, fixed
    D1 schema) -> one job request per record, with its job name and media format.
    Records lacking bucket or key are kept with ``reject_reason``."""
    from parlance.operators.uploads import explode_notifications
    from parlance.schemas import NOTIFICATION_DDL

    reader = spark.readStream.schema(NOTIFICATION_DDL)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    notes = reader.json(path).withColumn("source_file", F.input_file_name())
    return derive_job_keys(explode_notifications(notes, "Records", "source_file"), key="key", bucket="bucket")


# ---------------------------------------------------------------------------
# STR-2 duplicate submissions


def dedup_stream(events: DataFrame, keys: list[str], *, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Drop repeated (job, status) events that arrive within the watermark delay."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


# ---------------------------------------------------------------------------
# STR-3 status loop -> latest state per job


def latest_status_stream(events: DataFrame, *, job: str = "job_name") -> DataFrame:
    order = F.struct("ts", "event_id")
    return events.groupBy(job).agg(
        F.max_by("status", order).alias("status"),
        F.max("ts").alias("last_ts"),
        F.count(F.lit(1)).cast("bigint").alias("n_events"),
    )


# ---------------------------------------------------------------------------
# STR-4 bounded waiting


TIMEOUT_OUT_SCHEMA = "job_name string, outcome string, decided_at timestamp"
TIMEOUT_STATE_SCHEMA = "first_us long, done boolean"


def job_timeout_stream(events: DataFrame, limit_s: int, *, delay: str = "1 hour", job: str = "job_name", keep_s: int = 7 * 86_400) -> DataFrame:
    """Per job: the first terminal status reached within ``limit_s`` of the job's
    first event, else ``TIMED_OUT`` (decided at the deadline) -- at once when a
    late terminal event shows the deadline passed, or when the watermark passes
    the deadline (also when a job speaks only after that).  A decided job is remembered
    until the watermark is ``keep_s`` seconds beyond its deadline, so later events do
    not decide it again; events later than that start a new job.

    The state per job is two values; group rows arrive as an iterator of Arrow
    chunks and are folded one chunk at a time, so a busy job never has to fit in
    memory at once.
    """
    limit_us = int(limit_s) * 1_000_000

    def out(name, outcome, when_us):
        # a UTC-aware value: Spark stores the instant whatever the session time zone
        return pd.DataFrame({"job_name": [name], "outcome": [outcome],
                             "decided_at": [pd.Timestamp(int(when_us), unit="us", tz="UTC")]})

    def remember(state: GroupState, first_us: int, done: bool) -> None:
        # a timeout must lie beyond the watermark
        deadline = (first_us + limit_us) // 1000
        state.update((first_us, done))
        state.setTimeoutTimestamp(max(deadline, state.getCurrentWatermarkMs()) + int(keep_s) * 1000 + 1 if done else deadline)

    def step(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (name,) = key
        if state.hasTimedOut:
            first_us, done = state.get
            if done:
                state.remove()
                return
            yield out(name, "TIMED_OUT", first_us + limit_us)
            remember(state, first_us, True)
            return
        first_us, done = state.get if state.exists else (None, False)
        best = None  # (us, status) of the earliest terminal event in this batch
        for pdf in pdfs:
            us = pdf["_ts_us"].astype("int64")  # exact instant, computed by Spark
            lo = int(us.min())
            first_us = lo if first_us is None else min(first_us, lo)
            term = pdf["status"].isin(TERMINAL_STATES).to_numpy()
            if term.any():
                t_us = us.to_numpy()[term]
                i = int(t_us.argmin())
                cand = (int(t_us[i]), str(pdf["status"].to_numpy()[term][i]))
                best = cand if best is None or cand < best else best
        if not done and best is not None:
            done = True
            if best[0] <= first_us + limit_us:
                yield out(name, best[1], best[0])
            else:
                yield out(name, "TIMED_OUT", first_us + limit_us)
        if not done and (first_us + limit_us) // 1000 <= state.getCurrentWatermarkMs():
            done = True
            yield out(name, "TIMED_OUT", first_us + limit_us)
        remember(state, first_us, done)

    return (
        events.withWatermark("ts", delay)
        .withColumn("_ts_us", F.unix_micros("ts"))
        .groupBy(job)
        .applyInPandasWithState(step, TIMEOUT_OUT_SCHEMA, TIMEOUT_STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout)
    )


# ---------------------------------------------------------------------------
# STR-5 late results


def result_join_stream(
    completions: DataFrame,
    results: DataFrame,
    *,
    key: str,
    within: str = "2 hours",
    delay: str = "1 hour",
) -> DataFrame:
    """Completions left-outer-joined with results that appear within ``within``
    after the completion; unmatched completions are emitted (result null) once the
    watermark passes the bound."""
    c = completions.withWatermark("c_ts", delay).alias("c")
    r = results.withWatermark("r_ts", delay).alias("r")
    cond = (
        (F.col(f"c.{key}") == F.col(f"r.{key}_r"))
        & (F.col("r.r_ts") >= F.col("c.c_ts"))
        & (F.col("r.r_ts") <= F.col("c.c_ts") + F.expr(f"INTERVAL {within}"))
    )
    return c.join(r, cond, "leftOuter")
