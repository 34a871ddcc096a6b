"""Streams over several drops and restarts: live jobs, the landing folder, bounded retries."""

import os
import random
import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from parlance.operators.jobs import plan_job_starts
from parlance.schemas import NO_CONTENT_ERROR
from parlance.session import scratch_path
from parlance.streaming.flows import run_to_table
from parlance.streaming.landing import landing_stream
from parlance.streaming.retries import RetryTables, retry_results
from parlance.streaming.starts import job_start_stream, keyed_state

EVENTS = "event_id long, job_name string, status string, ts timestamp"
T0 = datetime(2024, 1, 1)


def _drop(spark, folder, rows, ddl=EVENTS):
    spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(folder)


def _starts(spark, folder, out, **options):
    ev = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(folder)
    with keyed_state(spark):
        return run_to_table(job_start_stream(ev, F.col("status") == "QUEUED", **options), spark, "starts", state_partitions=2, path=out)


def test_live_jobs_over_drops_and_a_restart_equal_the_log(spark):
    rng = random.Random(2)
    log = [(i, rng.choice(["stt-a", "stt-b", "stt-hot", "stt-hot", None]), rng.choice(["QUEUED", "QUEUED", "IN_PROGRESS", "COMPLETED", "FAILED"]), T0 + timedelta(seconds=60 * (i // 2))) for i in range(160)]
    folder, out = tempfile.mkdtemp(prefix="parlance-live-") + "/log", scratch_path(spark, "live")
    for a in (0, 50, 80):
        _drop(spark, folder, rng.sample(log[a : a + 50 if a != 50 else 80], (50 if a != 50 else 30)))
        if a == 50:
            first = _starts(spark, folder, out).count()  # two drops, then the stream ends
    _drop(spark, folder, log[130:])
    table = _starts(spark, folder, out)
    got = sorted(tuple(r) for r in table.collect())
    named = spark.createDataFrame([r for r in log if r[1]], EVENTS)
    want = sorted(tuple(r) for r in plan_job_starts(named, F.col("status") == "QUEUED").select(*table.columns).collect())
    assert first < len(got) and got == want


def test_live_jobs_are_forgotten_and_late_events_change_nothing(spark):
    folder, out = tempfile.mkdtemp(prefix="parlance-live-") + "/log", scratch_path(spark, "live")
    at = lambda hours: T0 + timedelta(hours=hours)
    _drop(spark, folder, [(1, "stt-a", "QUEUED", at(0)), (2, "stt-a", "IN_PROGRESS", at(1)), (3, "stt-b", "QUEUED", at(1))])
    _starts(spark, folder, out, keep_s=3600 * 10)
    _drop(spark, folder, [(4, "stt-a", "FAILED", at(0.5)), (5, "stt-a", "QUEUED", at(2))])  # an old event comes late
    _starts(spark, folder, out, keep_s=3600 * 10)
    _drop(spark, folder, [(6, "stt-c", "QUEUED", at(40))])  # moves the watermark beyond the others
    _starts(spark, folder, out, keep_s=3600 * 10)
    _drop(spark, folder, [(7, "stt-b", "QUEUED", at(41))])
    got = {r.event_id: (r.prior_status, r.action) for r in _starts(spark, folder, out, keep_s=3600 * 10).collect()}
    assert got == {1: (None, "start"), 3: (None, "start"), 5: ("IN_PROGRESS", "start_unique"), 6: (None, "start"), 7: (None, "start")}


def _put(folder, name, size):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(b"\0" * size)


def test_landing_folder_over_drops_and_a_restart(spark):
    folder, out = tempfile.mkdtemp(prefix="parlance-landing-"), scratch_path(spark, "landing")
    requests = lambda: landing_stream(spark, folder, bucket="in", max_files_per_trigger=1).select("key", "bucket", "length", "mime", "job_name", "media_format", "reject_reason")
    _put(folder, "case 1/a.mp3", 3)
    _put(folder, "b.tar.wav", 1)
    _put(folder, "empty.mp3", 0)  # Spark's file sources skip it
    first = run_to_table(requests(), spark, "landing", path=out)
    assert first.count() == 2
    _put(folder, "notes.txt", 1)
    _put(folder, "big.m4a", 10 * 1024 * 1024 + 1)
    _put(folder, "case 1/c", 2)
    got = {r.key: (r.bucket, r.length, r.mime, r.job_name, r.media_format, r.reject_reason) for r in run_to_table(requests(), spark, "landing", path=out).collect()}
    assert got == {
        "case 1/a.mp3": ("in", 3, "audio/mpeg", "stt-case 1/a", "mp3", None),
        "b.tar.wav": ("in", 1, "audio/wav", "stt-b.tar", "wav", None),
        "notes.txt": ("in", 1, "application/octet-stream", "stt-notes", "txt", "bad_type"),
        "big.m4a": ("in", 10 * 1024 * 1024 + 1, "audio/mp4", "stt-big", "m4a", "too_large"),
        "case 1/c": ("in", 2, "application/octet-stream", "stt-case 1/c", "case 1/c", "bad_type"),
    }
    assert run_to_table(requests(), spark, "landing", path=out).count() == 5  # nothing new, nothing twice


def test_landing_reads_no_content_and_archives(spark):
    folder, archive, out = tempfile.mkdtemp(prefix="parlance-landing-"), tempfile.mkdtemp(prefix="parlance-archive-"), scratch_path(spark, "landing")
    plan = spark.read.format("binaryFile").load(folder).select("path", "modificationTime", "length")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema", 1)[1]
    requests = landing_stream(spark, folder, clean="archive", archive=archive, max_files_per_trigger=1)
    assert "content" not in requests.columns and requests.select("bucket").schema[0].dataType.simpleString() == "string"
    for i in range(3):
        _put(folder, f"{i}.mp3", i + 1)
        run_to_table(requests.select("key"), spark, "landing", path=out)
    assert spark.read.parquet(out + "/data").count() == 3
    left = [f for _, _, files in os.walk(folder) for f in files]
    moved = [f for _, _, files in os.walk(archive) for f in files]
    assert len(moved) >= 1 and sorted(left + moved) == ["0.mp3", "1.mp3", "2.mp3"]
    with pytest.raises(ValueError):
        landing_stream(spark, folder, clean="archive")


DONE = "job_name string, result_bucket string, result_key string"


def _retry(spark, folder, results, tables, attempts):
    done = spark.readStream.schema(DONE).option("maxFilesPerTrigger", 1).parquet(folder)
    q = retry_results(done, lambda: spark.createDataFrame(results, "result_bucket string, result_key string"), tables, attempts=attempts)
    q.awaitTermination()
    return {r.job_name: (r.status, r.attempts, r.error) for r in tables.answers().collect()}


def test_pending_results_fail_exactly_once_after_the_last_attempt(spark):
    folder, tables = tempfile.mkdtemp(prefix="parlance-retry-") + "/done", RetryTables(spark)
    beat = [(None, None, None)]
    _drop(spark, folder, [("a", "b1", "a.json"), ("b", "b1", "b.json"), ("n", None, None), ("c", "b1", "c.json")], DONE)
    assert _retry(spark, folder, [("b1", "a.json"), ("b2", "b.json")], tables, 3) == {"a": ("COMPLETED", 1, None)}
    _drop(spark, folder, [("a", "b1", "a.json"), ("d", "b1", "d.json")], DONE)  # a completion told again
    assert _retry(spark, folder, [("b1", "c.json")], tables, 3) == {"a": ("COMPLETED", 1, None), "c": ("COMPLETED", 2, None)}
    _drop(spark, folder, beat, DONE)
    third = _retry(spark, folder, [], tables, 3)
    assert third["b"] == third["n"] == ("FAILED", 3, NO_CONTENT_ERROR) and "d" not in third
    _drop(spark, folder, beat, DONE)
    last = _retry(spark, folder, [("b1", "b.json"), ("b1", "d.json")], tables, 3)
    assert last["d"] == ("COMPLETED", 3, None) and last["b"] == ("FAILED", 3, NO_CONTENT_ERROR)
    assert tables.answers().count() == 5 and tables.pending(3).count() == 0
    # a batch that runs again replaces itself
    tables.attempt(spark.createDataFrame([], DONE), 2, spark.createDataFrame([], "result_bucket string, result_key string"), 3)
    assert tables.answers().count() == 5
