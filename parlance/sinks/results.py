"""SNK-1 result table, SNK-2 start records, PRJ-10 store validation, PRJ-16 lineage.

The enhanced-result table is Parquet partitioned by ingest date; writes use
dynamic partition overwrite, so re-running a day (or a retried task) replaces
exactly the partitions it produced and never duplicates rows.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions.keys import enhanced_key


def with_lineage(df: DataFrame, bucket: str = "bucket", job: str = "job_key") -> DataFrame:
    """PRJ-16: attach ``s3{transcriptionOutputBucket, transcriptionJobName}``."""
    return df.withColumn(
        "s3",
        F.struct(F.col(bucket).alias("transcriptionOutputBucket"), F.col(job).alias("transcriptionJobName")),
    )


def store_validation(df: DataFrame) -> DataFrame:
    """PRJ-10: reject reason, first failing check wins: empty transcript, empty
    segments, missing bucket or job name.  Accepted rows get the output key
    (every ``.json`` -> ``_enhanced.json``) and location."""
    bucket = F.col("s3.transcriptionOutputBucket")
    job = F.col("s3.transcriptionJobName")
    empty = lambda c: c.isNull() | (c == "")
    reason = (
        F.when(empty(F.col("transcript")), F.lit("missing_transcript"))
        .when(F.col("segments").isNull() | (F.size("segments") == 0), F.lit("missing_segments"))
        .when(empty(bucket) | empty(job), F.lit("missing_location"))
    )
    key = enhanced_key(job)
    return (
        df.withColumn("reject_reason", reason)
        .withColumn("output_key", F.when(reason.isNull(), key))
        .withColumn("output_location", F.when(reason.isNull(), F.concat(F.lit("s3://"), bucket, F.lit("/"), key)))
    )


def new_batch() -> str:
    """A batch name that sorts after those of earlier times: UTC time and a random end."""
    return f"{datetime.now(timezone.utc):%Y%m%dT%H%M%S%f}Z-{uuid.uuid4().hex[:8]}"


def write_results(df: DataFrame, path: str, partition_col: str = "ingest_date", batch: str | None = None) -> str:
    """SNK-1: write one batch of enhanced results; returns its name.  The table is partitioned by
    day and ``batch``: writing a named batch again replaces exactly its partitions, and any
    other batch of the same day stays beside it.  Without a name every write is a batch of its own, named by the time.
    ``read_results`` lets the batch that sorts last win per place (name batches so that they sort, e.g. by time)."""
    batch = batch or new_batch()
    (
        df.withColumn("batch", F.lit(batch))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition_col, "batch")
        .parquet(path)
    )
    return batch


def result_place(df: DataFrame) -> DataFrame:
    """``df`` with ``result_bucket`` and ``result_key``, the place JOIN-2 derives from a job's output address."""
    return df.withColumn("result_bucket", F.col("s3.transcriptionOutputBucket")).withColumn("result_key", enhanced_key(F.col("s3.transcriptionJobName")))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """SRC-4/6: the results as stored, one row per place (``result_bucket``, ``result_key``, which are added): of
    a place written by several batches the row of the last one, of several rows for it in that batch the one whose
    SHA-256 (of its JSON text) is largest.  Rows without a place (rejected ones) are left out."""
    place = ["result_bucket", "result_key"]
    stored = spark.read.option("recursiveFileLookup", "false").parquet(path)
    rows = result_place(stored.withColumn("batch", F.col("batch").cast("string"))).where("result_bucket is not null and result_key is not null")
    newest = rows.groupBy(*place).agg(F.max("batch").alias("batch"), F.count(F.lit(1)).alias("_n"))  # places and batches only
    last = rows.join(newest, [*place, "batch"])
    # only places with several rows in all are looked at again
    once, more = last.where("_n = 1").drop("_n"), last.where("_n > 1").drop("_n")
    marked = more.withColumn("_sha", F.sha2(F.to_json(F.struct(*stored.columns)), 256))
    winner = marked.groupBy(*place).agg(F.max("_sha").alias("_sha"))
    return once.unionByName(marked.join(winner, [*place, "_sha"]).drop("_sha").dropDuplicates(place))


def export_json(df: DataFrame, path: str, partition_col: str | None = "ingest_date") -> None:
    """SNK-1 optional export: JSON lines of D10 documents (one line per transcript),
    partitioned like the table; written by the executors, never via the driver."""
    w = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    if partition_col:
        w = w.partitionBy(partition_col)
    w.option("ignoreNullFields", "false").json(path)


def start_records(uploads: DataFrame, ts=None) -> DataFrame:
    """SNK-2 rows: a QUEUED job event per accepted upload (job_name and, if there, event_id);
    without an event_id one is derived from the job and the time, the same for a retried task."""
    when = F.current_timestamp() if ts is None else ts
    event_id = F.col("event_id") if "event_id" in uploads.columns else F.xxhash64(F.col("job_name"), when)
    return uploads.select(
        "job_name", F.lit("QUEUED").alias("status"), when.alias("ts"), event_id.cast("bigint").alias("event_id"), F.lit(None).cast("string").alias("uri")
    )


def write_start_records(uploads: DataFrame, path: str, ts=None) -> None:
    """SNK-2: append the start records to the job event log (SRC-5 reads it back)."""
    start_records(uploads, ts).write.mode("append").parquet(path)
