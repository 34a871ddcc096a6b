"""Durable answers and clients by language."""

import glob
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from parlance.operators import answers
from parlance.operators.answers import AnswerStore, apply_model_by_language, ask_once, by_language
from parlance.operators.enhance import enhance
from parlance.session import scratch_path


def _factory(log, dies=None):
    """A model that notes every request it is asked, and whose process ends when it meets ``dies``."""

    def factory():
        def model(requests):
            for r in requests:
                with open(os.path.join(log, f"{os.getpid()}.log"), "a") as f:
                    f.write(r + "\n")
                if dies and r == dies and not os.path.exists(os.path.join(log, "died")):
                    open(os.path.join(log, "died"), "w").close()
                    os._exit(1)
            return [None if r.startswith("null") else f"<{r}>" for r in requests]

        return model

    return factory


def _asked(log):
    return sorted(line for p in glob.glob(os.path.join(log, "*.log")) for line in open(p).read().split("\n") if line)


def test_a_run_that_broke_off_costs_no_answered_request(spark):
    log, store = tempfile.mkdtemp(prefix="parlance-asked-"), AnswerStore(scratch_path(spark, "answers"))
    rows = [(i, f"r{i}") for i in range(20)] + [(20, "r1"), (21, None)]
    df = spark.createDataFrame(rows, "id long, payload string")
    with pytest.raises(Exception):  # noqa: B017 - the lost task ends this local run
        ask_once(df, _factory(log, dies="r13"), store, batch_rows=1, concurrency=2)
    broke_off = _asked(log)
    stored = store.read(spark).count()
    assert "r13" in broke_off and stored >= len(broke_off) - 2  # one call of each client may have been under way
    out = {r.id: (r.response, r.response_error, r.response_reused) for r in ask_once(df, _factory(log), store, batch_rows=1, concurrency=3).collect()}
    assert len(out) == 22 and out[1][0] == out[20][0] == "<r1>" and out[21][:2] == (None, None)
    assert all(out[i][0] == f"<r{i}>" for i in range(20)) and sum(v[2] for v in out.values()) >= stored
    again = _asked(log)
    assert len(again) <= 20 + (len(broke_off) - stored) and len(set(again)) == 20
    ask_once(df, _factory(log), store, concurrency=4).count()
    assert _asked(log) == again  # nothing is asked a third time


def test_a_task_that_runs_again_reads_what_it_wrote(spark, monkeypatch):
    store = AnswerStore(scratch_path(spark, "answers"))
    store.write("run", 3, [("h1", "a"), ("h2", "b")])
    store.write("run", 30, [("h3", "c")])
    store.write("other", 3, [("h4", "d")])
    assert store.written_by("run", 3) == {"h1": "a", "h2": "b"} and store.written_by("run", 4) == {}
    half = os.path.join(store.path.replace("file:", ""), "answers", "run", "_5-half.parquet")
    open(half, "wb").close()  # a file that was not moved into place is no answer
    assert {r.request_hash: r.response for r in store.read(spark).collect()} == {"h1": "a", "h2": "b", "h3": "c", "h4": "d"}


def test_requests_without_answer_are_asked_again(spark):
    log, store = tempfile.mkdtemp(prefix="parlance-asked-"), AnswerStore(scratch_path(spark, "answers"))
    df = spark.createDataFrame([(1, "null-1"), (2, "ok")], "id long, payload string")
    first = {r.id: (r.response, r.response_error) for r in ask_once(df, _factory(log), store).collect()}
    assert first == {1: (None, None), 2: ("<ok>", None)}

    def broken():
        def model(requests):
            raise ValueError("no")

        return model

    second = {r.id: (r.response, r.response_error, r.response_reused) for r in ask_once(df, broken, store).collect()}
    assert second == {1: (None, "ValueError: no", False), 2: ("<ok>", None, True)}
    assert ask_once(df.where("id > 5"), broken, store).collect() == []


def test_enhance_with_a_store_asks_once_per_chunk(spark):
    log, store = tempfile.mkdtemp(prefix="parlance-asked-"), AnswerStore(scratch_path(spark, "answers"))
    segs = spark.createDataFrame([("t", i, str(i), "s", f"word{i} and more") for i in range(6)], "transcript_id string, seg_no long, timestamp string, speaker string, text string")

    def factory():
        def model(payloads):
            with open(os.path.join(log, f"{os.getpid()}.log"), "a") as f:
                f.write("".join(f"{json.loads(p)[0]['text']}\n" for p in payloads))
            return [json.dumps({"transcript": " ".join(s["text"] for s in json.loads(p)), "segments": json.loads(p)}) for p in payloads]

        return model

    docs = [enhance(segs, model_factory=factory, budget=3, answer_store=store).first() for _ in range(2)]
    assert docs[0].transcript == docs[1].transcript == " ".join(f"word{i} and more" for i in range(6))
    assert len(_asked(log)) == 6


def test_partitions_hold_one_language_and_hot_ones_are_split(spark):
    rows = [(i, "en" if i % 3 else "de", f"r{i}") for i in range(600)] + [(600, "fr", "x"), (601, None, "y")]
    df = spark.createDataFrame(rows, "id long, language string, payload string")
    parts = by_language(df, "language", 50, F.col("id")).groupBy(F.spark_partition_id().alias("p")).agg(F.collect_set(F.coalesce("language", F.lit("?"))).alias("l"), F.count(F.lit(1)).alias("n")).collect()
    assert all(len(p.l) == 1 for p in parts) and max(p.n for p in parts) < 110
    assert sum(p.l == ["en"] for p in parts) >= 6

    def factory(language):
        return lambda requests: [f"{language}:{r}" for r in requests]

    out = apply_model_by_language(df, factory, rows_per_client=50).collect()
    assert len(out) == 602 and all(r.response == f"{r.language or 'en-US'}:{r.payload}" and r.response_client == (r.language or "en-US") for r in out)


def test_rare_languages_share_partitions(spark, monkeypatch):
    monkeypatch.setattr(answers, "LANGUAGES", 2)
    df = spark.createDataFrame([(i, f"l{i % 9}", f"r{i}") for i in range(90)], "id long, language string, payload string")
    out = apply_model_by_language(df, lambda language: lambda requests: [f"{language}:{r}" for r in requests], rows_per_client=10).collect()
    assert len(out) == 90 and all(r.response == f"{r.language}:{r.payload}" for r in out)
    store = AnswerStore(scratch_path(spark, "answers"))
    told = ask_once(df, lambda language: lambda requests: [f"{language}:{r}" for r in requests], store, language="language").collect()
    assert len(told) == 90 and all(r.response == f"{r.language}:{r.payload}" for r in told)
