import os
import shutil
import tempfile

from pyspark.sql import functions as F

from parlance.functions.times import py_float
from parlance.operators.analytics import apply_vocabulary
from parlance.operators.enhance import enhance
from parlance.operators.entities import case_header
from parlance.operators.jobs import latest_job_status, status_report
from parlance.operators.models import apply_model, clean_model_output
from parlance.operators.packing import pack_chunks
from parlance.operators.segments import segment_text
from parlance.operators.uploads import resolve_result_uri
from parlance.sinks.results import write_results, write_start_records
from parlance.sources.transcripts import read_enhanced, read_job_events
from parlance.streaming.flows import job_timeout_stream, latest_status_stream, run_to_table

EVENT = "job_name string, status string, ts timestamp, event_id long"


def _file(spark, folder, n, rows):
    """One more input file of a stream, read in the order of n."""
    part = tempfile.mkdtemp(prefix="parlance-part-")
    df = spark.createDataFrame(rows, "job_name string, status string, ts string, event_id long")
    df.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("overwrite").parquet(part)
    [name] = [f for f in os.listdir(part) if f.endswith(".parquet")]
    os.makedirs(folder, exist_ok=True)
    shutil.copy(os.path.join(part, name), os.path.join(folder, f"{n:03d}.parquet"))
    os.utime(os.path.join(folder, f"{n:03d}.parquet"), (1_700_000_000 + n, 1_700_000_000 + n))


def _stream(spark, folder):
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(folder)


def test_job_that_speaks_after_its_deadline_is_decided_once(spark):
    folder, table = tempfile.mkdtemp(prefix="parlance-in-"), tempfile.mkdtemp(prefix="parlance-out-") + "/t"
    _file(spark, folder, 1, [("A", "QUEUED", "2024-01-01 00:00:00", 1), ("B", "QUEUED", "2024-01-01 00:00:00", 2)])
    _file(spark, folder, 2, [("C", "QUEUED", "2024-01-01 02:30:00", 3)])  # the watermark passes the deadline of A and B
    _file(spark, folder, 3, [("A", "IN_PROGRESS", "2024-01-01 01:45:00", 4)])  # late, but not too late
    run = lambda: run_to_table(job_timeout_stream(_stream(spark, folder), 1800, delay="1 hour"), spark, "t", state_partitions=2, path=table)
    run()
    _file(spark, folder, 4, [("A", "COMPLETED", "2024-01-01 02:20:00", 5), ("C", "COMPLETED", "2024-01-01 02:40:00", 6)])
    got = sorted((r.job_name, r.outcome) for r in run().collect())  # the second run goes on from the checkpoint
    assert got == [("A", "TIMED_OUT"), ("B", "TIMED_OUT"), ("C", "COMPLETED")]


def test_update_mode_keeps_rows_of_earlier_batches(spark):
    folder, table = tempfile.mkdtemp(prefix="parlance-in-"), tempfile.mkdtemp(prefix="parlance-out-") + "/t"
    _file(spark, folder, 1, [("A", "QUEUED", "2024-01-01 00:00:00", 1), ("B", "QUEUED", "2024-01-01 00:00:00", 2)])
    _file(spark, folder, 2, [("B", "COMPLETED", "2024-01-01 00:10:00", 3)])
    out = run_to_table(latest_status_stream(_stream(spark, folder)), spark, "s", mode="update", key=["job_name"], state_partitions=2, path=table)
    assert {r.job_name: (r.status, r.n_events) for r in out.collect()} == {"A": ("QUEUED", 1), "B": ("COMPLETED", 2)}


def test_failing_requests_fail_alone(spark):
    def factory():
        def model(requests):
            if "bad" in requests:
                raise ValueError("no bad ones")
            return [r.upper() for r in requests][: 1 if "short" in requests else None]

        return model

    df = spark.createDataFrame([(i, r) for i, r in enumerate(["a", "bad", "b", "short"])], "i long, payload string").coalesce(1)
    got = {r.i: (r.response, r.response_error) for r in apply_model(df, factory).collect()}
    assert got == {0: ("A", None), 1: (None, "ValueError: no bad ones"), 2: ("B", None), 3: ("SHORT", None)}


def test_missing_segments_are_an_error_and_spoil_nothing(spark):
    seg = '{"timestamp": "1", "speaker": "s", "text": "x"}'
    bodies = [f'{{"transcript": "x", "segments": [{seg}]}}', '{"transcript": "y"}', '{"transcript": "z", "segments": "none"}', '{"transcript": "z", "segments": [null]}']
    df = spark.createDataFrame(list(enumerate(bodies)), "i long, response string")
    assert [r.error for r in clean_model_output(df).orderBy("i").collect()] == [None] + ["missing_segments"] * 3


SEGMENTS = "transcript_id string, seg_no long, timestamp string, speaker string, text string"


def test_enhanced_results_are_found_by_the_status_lookup(spark):
    segs = spark.createDataFrame([("stt-a", 0, "0", "s", "hello there"), ("stt-b", 0, "0", "s", "second")], SEGMENTS)
    places = spark.createDataFrame([("stt-a", "in", "stt-a.json"), ("stt-b", "in", "stt-b.json"), ("stt-c", "in", "stt-c.json")], "transcript_id string, bucket string, job_key string")
    docs = enhance(segs, transcripts=places)
    assert {r.transcript_id: (r.status, r.reject_reason) for r in docs.collect()} == {"stt-a": ("OK", None), "stt-b": ("OK", None), "stt-c": ("FAILED", "missing_transcript")}
    path, log = tempfile.mkdtemp(prefix="parlance-res-"), tempfile.mkdtemp(prefix="parlance-log-") + "/log"
    write_results(docs.withColumn("ingest_date", F.lit("2024-01-01")).where("reject_reason is null"), path)
    write_start_records(places.select(F.col("transcript_id").alias("job_name")), log)
    done = spark.createDataFrame([("stt-a", "https://s/in/stt-a.json"), ("stt-c", "")], "job_name string, uri string")
    done.select("job_name", F.lit("COMPLETED").alias("status"), F.timestamp_add("HOUR", F.lit(1), F.current_timestamp()).alias("ts"), F.lit(9).cast("bigint").alias("event_id"), "uri").write.mode("append").parquet(log)
    latest = resolve_result_uri(latest_job_status(read_job_events(spark, log), by_base=True), "uri")
    requests = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), (None,)], "file_name string")
    report = status_report(requests, latest.select("job_name", "status", "uri", "result_bucket", "result_key"), read_enhanced(spark, path))
    got = {r.file_name: r for r in report.collect()}
    assert (got["a"].http_code, got["a"].result.transcript, got["a"].result.segments[0].speaker) == (200, "hello there", "s")
    assert (got["b"].status, got["d"].http_code, got[None].http_code) == ("IN_PROGRESS", 404, 400)
    assert got["c"].error == "Unexpected error: TranscriptFileUri not found in completed job"


def test_answered_chunks_are_not_asked_again_and_ner_failures_show(spark):
    segs = spark.createDataFrame([("t", 0, "0", "s", "one two"), ("t", 1, "1", "s", "three four")], SEGMENTS)
    known = spark.createDataFrame([("t", 0, '{"transcript": "KEPT", "segments": [{"timestamp": "0", "speaker": "s", "text": "k"}]}')], "transcript_id string, chunk_no long, response string")
    doc = enhance(segs, answers=known, budget=2, entity_model=lambda: lambda texts: [None] * len(texts)).first()
    assert (doc.transcript, doc.status, doc.entities) == ("KEPT three four", "NER_FAILED", {})


def test_infinite_segment_times(spark):
    segs = spark.createDataFrame([("t", 0, "0", "inf"), ("t", 1, "-inf", "5"), ("t", 2, "2", "3"), ("t", 3, "inf", "inf")], "transcript_id string, seg_no long, s string, e string")
    segs = segs.select("transcript_id", "seg_no", py_float("s").alias("start_s"), py_float("e").alias("end_s"))
    times = [1.0, 2.5, 7.0, 4000.0, float("inf")]
    items = spark.createDataFrame([("t", i, t, "pronunciation", f"w{i}") for i, t in enumerate(times)], "transcript_id string, item_no long, start_s double, type string, content string")
    got = {r.seg_no: r.text for r in segment_text(segs, items).collect()}
    assert got == {0: "w0 w1 w2 w3 w4", 1: "w0 w1", 2: "w1", 3: "w4"}


def test_packing_next_to_a_null_key(spark):
    rows = [(k, i, 3) for k in (None, "a") for i in range(5)]
    df = spark.createDataFrame(rows, "transcript_id string, seg_no long, n_tokens long").coalesce(1)
    for fragment in (1, 2, 100):
        got = {(r.transcript_id, r.seg_no): r.chunk_no for r in pack_chunks(df, 6, fragment_rows=fragment).collect()}
        assert got == {(k, i): i // 2 for k in (None, "a") for i in range(5)}


def test_vocabulary_table_keeps_equal_rows_and_nulls(spark):
    df = spark.createDataFrame([(1, None, "a b a"), (1, None, "a b a"), (2, "x", None)], "i long, other string, text string")
    vocab = spark.createDataFrame([("a", "A")], "term string, preferred string")
    got = sorted(((r.i, r.other, r.text_out) for r in apply_vocabulary(df, vocab).collect()), key=str)
    assert got == [(1, None, "A b A"), (1, None, "A b A"), (2, "x", None)]


def test_every_transcript_has_a_case_header(spark):
    long = spark.createDataFrame([(1, "PLAINTIFF", 0, "p")], "transcript_id long, category string, pos long, value string")
    got = {r.transcript_id: (r.plaintiffs, r.missing_case_number) for r in case_header(long, transcripts=spark.createDataFrame([(1,), (2,)], "transcript_id long")).collect()}
    assert got == {1: (["p"], True), 2: ([], True)}


def test_own_checkpoint_folder_is_respected(spark):
    from parlance.session import ensure_checkpoint_dir

    assert ensure_checkpoint_dir(spark) == spark.sparkContext.getCheckpointDir()


def test_scratch_tables_can_be_dropped(spark):
    from parlance.session import drop_scratch, scratch_path

    drop_scratch(spark)
    path = scratch_path(spark, "x")
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3 and drop_scratch(spark) == 1
    assert not os.path.exists(path.removeprefix("file:"))
