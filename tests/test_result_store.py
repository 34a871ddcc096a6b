"""Compaction with an atomic switch, and point lookups without a shuffle of results."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from parlance.operators.jobs import status_report
from parlance.session import scratch_path
from parlance.sinks.store import ResultStore, find_results, publish_lookup

DDL = "id long, note string, ingest_date string, s3 struct<transcriptionOutputBucket:string,transcriptionJobName:string>"


def _rows(spark, ids, note, bucket="b"):
    return spark.createDataFrame([(i, note, f"2024-01-0{i % 2 + 1}", (bucket, f"stt-{i:03d}.json")) for i in ids], DDL)


def _notes(store):
    return {(r.result_bucket, r.id): r.note for r in store.read().collect()}


def test_reads_are_equal_before_and_after_compaction(spark):
    store = ResultStore(spark, scratch_path(spark, "store"))
    with pytest.raises(ValueError):
        store.read()
    store.write(_rows(spark, range(40), "first"), batch="0001")
    store.write(_rows(spark, range(0, 40, 2), "second"))
    store.write(_rows(spark, range(5), "other", "c"))
    before, reader = _notes(store), store.read()
    assert len(before) == 45
    assert store.compact(ranges=4) == 2
    assert _notes(store) == before and {(r.result_bucket, r.id): r.note for r in reader.collect()} == before  # a reader of the old state goes on
    base = glob.glob(os.path.join(store.path.replace("file:", ""), "base=2", "*.parquet"))
    assert 1 < len(base) <= 4
    spans = sorted((r.lo, r.hi) for r in spark.read.parquet(store.path + "/base=2").groupBy(F.input_file_name()).agg(F.min(F.struct("result_bucket", "result_key")).alias("lo"), F.max(F.struct("result_bucket", "result_key")).alias("hi")).collect())
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))  # one file a key range
    store.write(_rows(spark, [3, 100], "third"), batch="0000")  # sorts first, is written last
    assert _notes(store) == before | {("b", 3): "third", ("b", 100): "third"}
    store.compact()
    assert _notes(store) == before | {("b", 3): "third", ("b", 100): "third"}
    assert store.vacuum() >= 2 and len(_notes(store)) == 46
    assert store.state()["generations"] == [2] and store.compact() == 6 and len(_notes(store)) == 46


def test_a_compaction_that_broke_off_changes_nothing(spark, monkeypatch):
    store = ResultStore(spark, scratch_path(spark, "store"))
    store.write(_rows(spark, range(6), "first"))
    switch, calls = store._switch, []

    def broken(state):
        calls.append(state)
        if len(calls) == 2:
            raise RuntimeError("lost")
        switch(state)

    monkeypatch.setattr(store, "_switch", broken)
    with pytest.raises(RuntimeError):
        store.compact()
    monkeypatch.undo()
    assert len(_notes(store)) == 6 and store.state() == {"version": 1, "base": None, "generations": [0, 1]}
    store.write(_rows(spark, [1], "later"))
    assert _notes(store)[("b", 1)] == "later"
    with pytest.raises(Exception):  # noqa: B017 - another one has made this state
        store._switch({"version": 1, "base": None, "generations": [0]})
    store.compact()
    assert _notes(store)[("b", 1)] == "later" and len(_notes(store)) == 6


def test_status_join_does_not_shuffle_published_results(spark):
    path = scratch_path(spark, "lookup")
    rows = spark.range(2000).select(F.lit("b").alias("result_bucket"), F.concat(F.lit("stt-"), "id", F.lit("_enhanced.json")).alias("result_key"), F.concat(F.lit("text "), "id").alias("transcript"))
    publish_lookup(rows, "lookup_test", path)
    latest = spark.range(3000).select(F.concat(F.lit("stt-"), "id").alias("job_name"), F.lit("COMPLETED").alias("status"), F.lit("u").alias("uri"), F.lit("b").alias("result_bucket"), F.concat(F.lit("stt-"), "id", F.lit("_enhanced.json")).alias("result_key"))
    requests = spark.range(2500).select(F.col("id").cast("string").alias("file_name"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        report = status_report(requests, latest, spark.table("lookup_test"))
        plan = report._jdf.queryExecution().executedPlan().toString()
        scan = next(line for line in plan.split("\n") if "lookup_test" in line)
        depth = len(scan) - len(scan.lstrip(" :+-|"))
        lines = plan.split("\n")
        chain = []
        for line in reversed(lines[: lines.index(scan)]):
            d = len(line) - len(line.lstrip(" :+-|"))
            if d < depth:
                chain.append(line)
                depth = d
            if "SortMergeJoin" in line and d == depth:
                break
        assert chain and "SortMergeJoin" in chain[-1] and not any("Exchange" in c for c in chain)
        got = {r.http_code: r.n for r in report.groupBy("http_code").agg(F.count(F.lit(1)).alias("n")).collect()}
        assert got == {200: 2000, 500: 500}
        some = find_results(spark, "lookup_test", [("b", "stt-7_enhanced.json"), ("c", "stt-8_enhanced.json")])
        assert [r.transcript for r in some.collect()] == ["text 7"]
        one = find_results(spark, "lookup_test", [("b", "stt-7_enhanced.json")])
        assert one.count() == 1
        one._jdf.collectToPython()
        scan = one._jdf.queryExecution().executedPlan().collectLeaves().head()
        assert 0 < scan.metrics().apply("numOutputRows").value() < 600  # one bucket of eight
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP TABLE lookup_test")
