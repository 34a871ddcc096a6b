import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from parlance.operators.jobs import latest_job_status, plan_job_starts, status_report
from parlance.streaming.flows import job_timeout_stream, run_to_table

T0 = dt.datetime(2024, 1, 1)


def ts(m):
    return T0 + dt.timedelta(minutes=m)


def test_status_report_cases(spark):
    ev = spark.createDataFrame(
        [
            (1, "stt-done", "COMPLETED", ts(1), "https://h/b/stt-done.json"),
            (2, "stt-nores", "COMPLETED", ts(1), "https://h/b/stt-nores.json"),
            (3, "stt-q", "QUEUED", ts(1), None),
            (4, "stt-f", "IN_PROGRESS", ts(1), None),
            (5, "stt-f", "FAILED", ts(2), None),
            (6, "stt-nouri", "COMPLETED", ts(1), None),
        ],
        "event_id long, job_name string, status string, ts timestamp, uri string",
    )
    latest = latest_job_status(ev)
    latest = latest.withColumn("result_key", F.regexp_replace(F.regexp_extract("uri", "[^/]*$", 0), r"\.json", "_enhanced.json")).withColumn("result_bucket", F.lit("b"))
    results = spark.createDataFrame([("b", "stt-done_enhanced.json", "text"), ("c", "stt-nores_enhanced.json", "elsewhere")], "result_bucket string, result_key string, transcript string")
    req = spark.createDataFrame([("done",), ("nores",), ("q",), ("f",), ("nope",), (None,), ("nouri",)], "file_name string")
    got = {r.file_name: (r.http_code, r.status) for r in status_report(req, latest, results).collect()}
    assert got == {
        "done": (200, "COMPLETED"), "nores": (500, "FAILED"), "q": (200, "IN_PROGRESS"), "f": (200, "FAILED"),
        "nope": (404, "ERROR"), None: (400, "ERROR"), "nouri": (500, "ERROR"),
    }


def test_plan_job_starts(spark):
    ev = spark.createDataFrame(
        [
            (1, "stt-a", "QUEUED", ts(1), True),  # no job yet -> start
            (2, "stt-a", "IN_PROGRESS", ts(2), False),
            (3, "stt-a", "QUEUED", ts(3), True),  # live job -> unique name
            (4, "stt-a", "COMPLETED", ts(4), False),
            (5, "stt-a", "QUEUED", ts(5), True),  # terminal -> delete and restart
        ],
        "event_id long, job_name string, status string, ts timestamp, sub boolean",
    )
    got = {r.event_id: (r.action, r.start_name) for r in plan_job_starts(ev, F.col("sub")).collect()}
    assert got[1] == ("start", "stt-a") and got[5] == ("delete_and_start", "stt-a")
    assert got[3][0] == "start_unique" and got[3][1].startswith("stt-a-20240101000300-") and len(got[3][1]) == len("stt-a-20240101000300-") + 8


def brute_timeout(events, limit_s, watermark):
    out = {}
    by = {}
    for job, status, t in events:
        by.setdefault(job, []).append((t, status))
    for job, lst in by.items():
        first = min(t for t, _ in lst)
        term = sorted((t, s) for t, s in lst if s in ("COMPLETED", "FAILED"))
        deadline = first + dt.timedelta(seconds=limit_s)
        if term and term[0][0] <= deadline:
            out[job] = term[0][1]
        elif term or deadline < watermark:
            out[job] = "TIMED_OUT"
    return out


def test_timeout_stream_over_several_files(spark):
    rows = [
        ("j1", "QUEUED", ts(0)), ("j1", "COMPLETED", ts(30)),
        ("j2", "QUEUED", ts(5)), ("j2", "FAILED", ts(200)),  # too late
        ("j3", "QUEUED", ts(10)),  # silent: times out once the watermark passes
        ("j4", "IN_PROGRESS", ts(500)), ("j1", "QUEUED", ts(20)),  # out of order
        ("j5", "QUEUED", ts(1000)),  # still open at the end
    ]
    d = tempfile.mkdtemp(prefix="parlance-stream-")
    schema = "job_name string, status string, ts timestamp"
    for i, chunk in enumerate([rows[:3], rows[3:6], rows[6:]]):
        spark.createDataFrame(chunk, schema).coalesce(1).write.parquet(os.path.join(d, f"b{i}"))
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(d)
    src = src.withColumn("event_id", F.lit(0).cast("long"))
    out = run_to_table(job_timeout_stream(src, limit_s=3600, delay="10 minutes"), spark, "t_timeout")
    got = {r.job_name: r.outcome for r in out.collect()}
    watermark = ts(1000) - dt.timedelta(minutes=10)
    assert got == brute_timeout(rows, 3600, watermark)


def _write_batches(spark, schema, batches):
    d = tempfile.mkdtemp(prefix="parlance-stream-")
    for i, chunk in enumerate(batches):
        spark.createDataFrame(chunk, schema).coalesce(1).write.parquet(os.path.join(d, f"b{i}"))
    return d


def test_dedup_across_files_within_watermark(spark):
    from parlance.streaming.flows import dedup_stream

    schema = "job_name string, status string, ts timestamp"
    d = _write_batches(spark, schema, [
        [("j1", "QUEUED", ts(0)), ("j1", "QUEUED", ts(1))],  # duplicate in the same batch
        [("j1", "QUEUED", ts(5)), ("j2", "QUEUED", ts(6))],  # duplicate in a later batch, within the delay
        [("j1", "COMPLETED", ts(300))],
    ])
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(d)
    out = run_to_table(dedup_stream(src, ["job_name", "status"], delay="1 hour"), spark, "t_dedup")
    got = sorted((r.job_name, r.status) for r in out.collect())
    assert got == [("j1", "COMPLETED"), ("j1", "QUEUED"), ("j2", "QUEUED")]


def test_late_result_joined_within_bound(spark):
    from parlance.streaming.flows import result_join_stream

    schema = "kind string, user_id long, ts timestamp, eid long"
    d = _write_batches(spark, schema, [
        [("done", 1, ts(0), 1), ("done", 2, ts(0), 2)],
        [("result", 1, ts(30), 3)],  # arrives in a later batch, within 2 hours
        [("result", 2, ts(500), 4), ("done", 3, ts(600), 5)],  # outside the bound; advances the watermark
    ])
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(d)
    c = src.where(F.col("kind") == "done").select(F.col("eid").alias("c_id"), "user_id", F.col("ts").alias("c_ts"))
    r = src.where(F.col("kind") == "result").select(F.col("eid").alias("r_id"), F.col("user_id").alias("user_id_r"),
                                                    F.col("ts").alias("r_ts"))
    out = run_to_table(result_join_stream(c, r, key="user_id", within="2 hours", delay="10 minutes")
                       .select("c_id", "r_id"), spark, "t_late")
    got = sorted((row.c_id, row.r_id) for row in out.collect())
    # user 1 matched late; user 2's completion timed out unmatched once the watermark passed its bound
    assert (1, 3) in got and (2, None) in got and all(c != 3 for c, _ in got if _ is not None)


def test_status_lookup_finds_restarted_jobs(spark):
    ev = spark.createDataFrame(
        [
            (1, "stt-a", "IN_PROGRESS", ts(1), None),
            (2, "stt-a-20240101000200-0123abcd", "COMPLETED", ts(2), "https://h/b/stt-a-20240101000200-0123abcd.json"),
        ],
        "event_id long, job_name string, status string, ts timestamp, uri string",
    )
    latest = latest_job_status(ev, by_base=True)
    row = latest.first()
    assert (row.job_name, row.latest_job, row.status) == ("stt-a", "stt-a-20240101000200-0123abcd", "COMPLETED")
    latest = latest.withColumn("result_key", F.lit("k")).withColumn("result_bucket", F.lit("b"))
    results = spark.createDataFrame([("b", "k", "text")], "result_bucket string, result_key string, transcript string")
    req = spark.createDataFrame([("a",)], "file_name string")
    r = status_report(req, latest, results).first()
    assert (r.http_code, r.status, r.result_transcript) == (200, "COMPLETED", "text")


def test_notification_stream(spark):
    import json

    from parlance.streaming.flows import notification_stream

    d = tempfile.mkdtemp(prefix="parlance-notes-stream-")
    for i, keys in enumerate([["a.mp3", "b.m4a"], ["c.wav"]]):
        with open(os.path.join(d, f"n{i}.json"), "w") as f:
            f.write(json.dumps({"Records": [{"s3": {"bucket": {"name": "in"}, "object": {"key": k}}} for k in keys]}) + "\n")
    out = run_to_table(notification_stream(spark, d, max_files_per_trigger=1)
                       .select("bucket", "key", "job_name", "media_format", "reject_reason"), spark, "t_notes")
    got = sorted((r.key, r.job_name, r.media_format) for r in out.collect())
    assert got == [("a.mp3", "stt-a", "mp3"), ("b.m4a", "stt-b", "m4a"), ("c.wav", "stt-c", "wav")]


def test_job_progress_columns(spark):
    from parlance.operators.analytics import job_progress

    ev = spark.createDataFrame(
        [("stt-a", "QUEUED", ts(0)), ("stt-a", "IN_PROGRESS", ts(1)), ("stt-a", "COMPLETED", ts(3)), ("stt-b", "FAILED", ts(2))],
        "job_name string, status string, ts timestamp",
    )
    got = {r.job_name: r for r in job_progress(ev).collect()}
    a, b = got["stt-a"], got["stt-b"]
    assert (a.first_queued, a.first_completed, a.turnaround_s, a.span_s) == (ts(0), ts(3), 180.0, 180.0)
    assert b.first_queued is None and b.turnaround_s is None and b.span_s == 0.0 and b.first_failed == ts(2)
