import json
import os
import random
import tempfile

from pyspark.sql import functions as F

from parlance.operators.entities import entities_from_map, entity_view
from parlance.operators.jobs import status_envelope, unwrap_envelope
from parlance.operators.models import transcribe
from parlance.operators.packing import pack_chunks
from parlance.operators.segments import raw_segments_and_items, segment_text
from parlance.operators.uploads import derive_job_keys
from parlance.sinks.results import export_json, store_validation, write_results, write_start_records
from parlance.sources.transcripts import list_audio, read_enhanced, read_job_events, read_notifications


def test_transcribe_hook_over_binary_files(spark):
    # defined here so it is pickled by value for the Python workers
    def fake_stt_factory():
        def model(requests):
            out = []
            for r in requests:
                req = json.loads(r)
                if req["format"] == "bad":
                    out.append(None)
                    continue
                stem = req["uri"].rsplit("/", 1)[-1].rsplit(".", 1)[0]
                out.append(json.dumps({
                    "jobName": "stt-" + stem,
                    "results": {
                        "speaker_labels": {"segments": [{"start_time": "0.0", "end_time": "1.0", "speaker_label": "spk_0"}]},
                        "items": [{"start_time": "0.2", "type": "pronunciation", "alternatives": [{"content": req["language"]}]}],
                    },
                }))
            return out

        return model

    d = tempfile.mkdtemp(prefix="parlance-audio-")
    for name in ["a.mp3", "b.bad", "notes.txt"]:
        with open(os.path.join(d, name), "wb") as f:
            f.write(b"\x00" * 10)
    audio = list_audio(spark, d).where(F.col("mime") != "application/octet-stream")
    assert sorted(r.mime for r in audio.collect()) == ["audio/mpeg"]
    files = spark.read.format("binaryFile").load(d).select("path", "content")
    files = derive_job_keys(files.withColumn("key", F.regexp_extract("path", "([^/]*)$", 1)))
    t = transcribe(files.where(F.col("key") != "notes.txt"), fake_stt_factory)
    out = t.collect()
    by = {r.key: r for r in out}
    assert by["b.bad"].transcribe_error == "no_response"
    assert by["a.mp3"].transcribe_error is None and by["a.mp3"].transcript_id == "stt-a"
    raw = t.where(F.col("transcribe_error").isNull()).select("transcript_id", "raw.results")
    segs, items = raw_segments_and_items(raw)
    assert [r.text for r in segment_text(segs.select("transcript_id", "seg_no", "start_s", "end_s"), items).collect()] == ["en-US"]


def test_notifications_file_reader(spark):
    d = tempfile.mkdtemp(prefix="parlance-notes-")
    doc = {"Records": [
        {"s3": {"bucket": {"name": "b1"}, "object": {"key": "My+File.mp3"}}},
        {"s3": {"bucket": {"name": "b1"}}},
    ]}
    with open(os.path.join(d, "n1.json"), "w") as f:
        f.write(json.dumps(doc) + "\n")
    got = [(r.rec_no, r.bucket, r.key, r.reject_reason) for r in read_notifications(spark, d).orderBy("rec_no").collect()]
    assert got == [(0, "b1", "My+File.mp3", None), (1, "b1", None, "missing_field")]


def test_enhanced_json_roundtrip_and_sample_file(spark):
    sample = {
        "transcript": "Good morning. Morning.",
        "segments": [{"timestamp": "0.5", "speaker": "Judge", "text": "Good morning."},
                     {"timestamp": "2.25", "speaker": "Counsel", "text": "Morning."}],
        "entities": {"JUDGE": ["Judge Smith"], "CASE_NUMBER": ["22-CV-1"], "DATE": [], "LOCATION": ["twenty-one Elm"],
                     "ATTORNEY": ["A", "B"]},
        "s3": {"transcriptionOutputBucket": "out", "transcriptionJobName": "stt-x.json"},
    }
    d = tempfile.mkdtemp(prefix="parlance-enh-")
    with open(os.path.join(d, "stt-x_enhanced.json"), "w") as f:
        json.dump(sample, f, indent=2)
    df = read_enhanced(spark, d, fmt="json").withColumn("transcript_id", F.lit("x"))
    v = store_validation(df).first()
    assert v.reject_reason is None and v.output_key == "stt-x_enhanced.json"
    view = [(r.label, list(r.values)) for r in entity_view(entities_from_map(df)).orderBy("cat_pos").collect()]
    assert view == [("JUDGE", ["Judge Smith"]), ("LOCATION", ["21 Elm"]), ("ATTORNEYS", ["A", "B"])]
    out = tempfile.mkdtemp(prefix="parlance-export-")
    export_json(df.drop("source_file").withColumn("ingest_date", F.lit("2024-01-01")), out)
    back = read_enhanced(spark, out, fmt="json", multi_line=False, glob=None)
    assert back.count() == 1 and back.first().entities["ATTORNEY"] == ["A", "B"]


def test_dynamic_overwrite_and_start_records(spark):
    d = tempfile.mkdtemp(prefix="parlance-res-")
    rows = [(i, f"t{i}", f"2024-01-0{i % 2 + 1}") for i in range(6)]
    df = spark.createDataFrame(rows, "id long, transcript string, ingest_date string")
    write_results(df, d, batch="0")
    write_results(df.where(F.col("ingest_date") == "2024-01-01"), d, batch="0")
    assert spark.read.parquet(d).count() == 6
    ev = tempfile.mkdtemp(prefix="parlance-ev-")
    write_start_records(spark.createDataFrame([("stt-a",)], "job_name string"), ev)
    r = read_job_events(spark, ev).first()
    assert (r.job_name, r.status, r.uri) == ("stt-a", "QUEUED", None)


def test_status_envelope(spark):
    df = spark.createDataFrame([("COMPLETED", ("text", ["a"]), None), ("IN_PROGRESS", None, None)],
                               "status string, result struct<transcript:string,segments:array<string>>, error string")
    env = status_envelope(df).select("body", unwrap_envelope("body").alias("r")).collect()
    document = {"transcript": "text", "segments": ["a"]}
    assert json.loads(env[0].body) == {"status": "COMPLETED", "result": document, "error": None}
    assert json.loads(env[0].r) == document and env[1].r is None


def test_packing_invariant_to_partitioning_and_input_order(spark):
    rng = random.Random(5)
    rows = [(t, i, rng.randint(0, 9)) for t in range(30) for i in range(rng.randint(1, 25))]
    a = spark.createDataFrame(rows, "transcript_id long, seg_no long, n_tokens long").repartition(1)
    shuffled = rows[:]
    rng.shuffle(shuffled)
    b = spark.createDataFrame(shuffled, "transcript_id long, seg_no long, n_tokens long").repartition(7)
    ra = sorted(tuple(r) for r in pack_chunks(a, 15).collect())
    rb = sorted(tuple(r) for r in pack_chunks(b, 15, fragment_rows=4, fan_in=2).collect())
    assert ra == rb


def test_result_table_partition_pruning(spark):
    d = tempfile.mkdtemp(prefix="parlance-prune-")
    df = spark.createDataFrame(
        [(i, f"2024-01-0{i % 3 + 1}", ("b", f"stt-{i}.json")) for i in range(9)],
        "id long, ingest_date string, s3 struct<transcriptionOutputBucket:string,transcriptionJobName:string>",
    )
    write_results(df, d)
    q = spark.read.parquet(d).where(F.col("ingest_date") == "2024-01-02").select("id")
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ingest_date" in plan and "2024-01-02" in plan
    assert sorted(r.id for r in q.collect()) == [1, 4, 7]


def test_batches_of_one_day_stay_and_the_last_one_wins_per_key(spark):
    d = tempfile.mkdtemp(prefix="parlance-batches-")
    ddl = "id long, note string, ingest_date string, s3 struct<transcriptionOutputBucket:string,transcriptionJobName:string>"
    rows = lambda ids, note: spark.createDataFrame([(i, note, "2024-01-01", ("b", f"stt-{i}.json")) for i in ids], ddl)
    write_results(rows([1, 2], "first"), d, batch="001")
    write_results(rows([3], "second"), d, batch="002")
    write_results(rows([2], "third"), d, batch="003")
    write_results(rows([2], "third again"), d, batch="003")
    got = {r.id: (r.note, r.result_key) for r in read_enhanced(spark, d).collect()}
    assert got == {1: ("first", "stt-1_enhanced.json"), 2: ("third again", "stt-2_enhanced.json"), 3: ("second", "stt-3_enhanced.json")}


def test_results_of_two_buckets_and_unnamed_batches(spark):
    d = tempfile.mkdtemp(prefix="parlance-places-")
    ddl = "id long, note string, ingest_date string, s3 struct<transcriptionOutputBucket:string,transcriptionJobName:string>"
    rows = lambda xs: spark.createDataFrame([(i, note, "2024-01-01", (b, k)) for i, note, b, k in xs], ddl)
    first = write_results(rows([(1, "a", "b1", "k.json"), (2, "b", "b2", "k.json")]), d)
    second = write_results(rows([(3, "c", "b1", "l.json"), (4, "x", None, "k.json"), (5, "x", "b1", None)]), d)
    assert first < second
    write_results(rows([(6, "later", "b2", "k.json"), (7, "also later", "b2", "k.json"), (7, "also later", "b2", "k.json")]), d)
    back = read_enhanced(spark, d)
    got = {(r.result_bucket, r.result_key): r.id for r in back.collect()}
    assert got.pop(("b2", "k_enhanced.json")) in (6, 7) and back.count() == 3
    assert got == {("b1", "k_enhanced.json"): 1, ("b1", "l_enhanced.json"): 3}
    assert sorted(map(str, back.collect())) == sorted(map(str, read_enhanced(spark, d).repartition(5).collect()))


def test_notification_url_decoding_option(spark):
    d = tempfile.mkdtemp(prefix="parlance-notes-dec-")
    doc = {"Records": [{"s3": {"bucket": {"name": "b"}, "object": {"key": "My+File%281%29.mp3"}}},
                       {"s3": {"bucket": {"name": "b"}, "object": {"key": "bad%zz.mp3"}}}]}
    with open(os.path.join(d, "n.json"), "w") as f:
        f.write(json.dumps(doc) + "\n")
    raw = [r.key for r in read_notifications(spark, d).orderBy("rec_no").collect()]
    dec = [r.key for r in read_notifications(spark, d, url_decode=True).orderBy("rec_no").collect()]
    assert raw == ["My+File%281%29.mp3", "bad%zz.mp3"]
    assert dec == ["My File(1).mp3", "bad%zz.mp3"]


def test_store_validation_first_reason_wins(spark):
    seg = "array<struct<timestamp:string,speaker:string,text:string>>"
    rows = [
        ("ok", "text", [("0", "a", "t")], "out", "stt-a.json"),
        ("all_bad", "", [], None, None),            # every check fails: transcript first
        ("no_segs_no_bucket", "t", [], None, "j.json"),
        ("no_bucket", "t", [("0", "a", "t")], "", "j.json"),
        ("no_job", "t", [("0", "a", "t")], "out", None),
        ("null_text", None, [("0", "a", "t")], "out", "j.json"),
    ]
    df = spark.createDataFrame(rows, f"id string, transcript string, segments {seg}, b string, j string").select(
        "id", "transcript", "segments",
        F.struct(F.col("b").alias("transcriptionOutputBucket"), F.col("j").alias("transcriptionJobName")).alias("s3"),
    )
    got = {r.id: (r.reject_reason, r.output_key) for r in store_validation(df).collect()}
    assert got == {
        "ok": (None, "stt-a_enhanced.json"),
        "all_bad": ("missing_transcript", None),
        "no_segs_no_bucket": ("missing_segments", None),
        "no_bucket": ("missing_location", None),
        "no_job": ("missing_location", None),
        "null_text": ("missing_transcript", None),
    }
