import math
import random

import pytest
from pyspark.sql import functions as F

from parlance.operators.segments import raw_segments_and_items, segment_text, speaker_cap
from parlance.schemas import RAW_TRANSCRIPT_DDL

SEG = "transcript_id long, seg_no long, start_s double, end_s double"
ITEM = "transcript_id long, item_no long, start_s double, type string, content string"


def brute(segs, items):
    out = {}
    for t, s, a, b in segs:
        words = [
            c for (t2, i, x, ty, c) in sorted(items, key=lambda r: r[1])
            if t2 == t and x is not None and not math.isnan(x) and ty in ("pronunciation", "punctuation") and a <= x <= b
        ]
        out[(t, s)] = " ".join(words)
    return out


def run(spark, segs, items, **kw):
    df = segment_text(spark.createDataFrame(segs, SEG), spark.createDataFrame(items, ITEM), **kw)
    return {(r.transcript_id, r.seg_no): r.text for r in df.collect()}


def test_fixture_edges(spark):
    segs = [(1, 0, 0.0, 1.0), (1, 1, 1.0, 2.0), (1, 2, 5.0, 6.0)]
    items = [
        (1, 0, 0.5, "pronunciation", "a"),
        (1, 1, 1.0, "pronunciation", "edge"),  # shared boundary: both segments
        (1, 2, None, "punctuation", ","),  # untimed: dropped
        (1, 3, 1.5, "speaker_change", "x"),  # other type: dropped
        (1, 4, 0.2, "punctuation", "."),  # earlier in time, later in array: array order wins
        (1, 5, float("nan"), "pronunciation", "nan"),  # NaN: no match
    ]
    got = run(spark, segs, items)
    assert got == {(1, 0): "a edge .", (1, 1): "edge", (1, 2): ""}
    assert got == brute(segs, items)


@pytest.mark.parametrize("bin_s,fanout", [(0.5, 2), (3.0, 4), (100.0, 64)])
def test_random_equals_brute_force_for_any_bin_width(spark, bin_s, fanout):
    rng = random.Random(11)
    segs, items = [], []
    for t in range(4):
        for s in range(12):
            a = rng.uniform(0, 60)
            segs.append((t, s, a, a + rng.choice([0.0, 0.5, 3.0, 40.0])))
        for i in range(60):
            items.append((t, i, round(rng.uniform(0, 100), 1), rng.choice(["pronunciation", "punctuation"]), f"w{i}"))
    assert run(spark, segs, items, bin_s=bin_s, fanout=fanout) == brute(segs, items)


def test_raw_transcript_explode_and_rejects(spark):
    doc = {
        "jobName": "stt-x",
        "results": {
            "speaker_labels": {"segments": [
                {"start_time": "0.0", "end_time": "2.0", "speaker_label": "spk_0"},
                {"start_time": "abc", "end_time": "3.0", "speaker_label": "spk_1"},
            ]},
            "items": [
                {"start_time": "0.5", "type": "pronunciation", "alternatives": [{"content": "hi"}]},
                {"type": "punctuation", "alternatives": [{"content": "."}]},
                {"start_time": "1.0", "type": "pronunciation", "alternatives": []},
                {"start_time": "NaN", "type": "pronunciation", "alternatives": [{"content": "z"}]},
            ],
        },
    }
    import json

    raw = spark.read.schema(RAW_TRANSCRIPT_DDL).json(spark.sparkContext.parallelize([json.dumps(doc)]))
    raw = raw.withColumn("transcript_id", F.col("jobName"))
    segs, items = raw_segments_and_items(raw)
    s = {r.seg_no: r.reject_reason for r in segs.collect()}
    i = {r.item_no: r.reject_reason for r in items.collect()}
    assert s == {0: None, 1: "bad_time"}
    assert i == {0: None, 1: None, 2: "no_alternative", 3: "bad_time"}
    texts = {r.seg_no: r.text for r in segment_text(segs.select("transcript_id", "seg_no", "start_s", "end_s"), items).collect()}
    assert texts == {0: "hi", 1: ""}


def test_speaker_cap(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "a")], "transcript_id long, speaker string")
    got = {r.transcript_id: (r.n_speakers, r.within_cap) for r in speaker_cap(df, cap=2).collect()}
    assert got == {1: (3, False), 2: (1, True)}


def test_segment_view_rows(spark):
    from parlance.operators.segments import segment_view

    df = spark.createDataFrame([(1, 1, "3600", "spk_1", "b"), (1, 0, "564.799", "spk_0", "a"), (1, 2, "abc", "spk_0", "c")],
                               "transcript_id long, seg_no long, timestamp string, speaker string, text string")
    got = [(r.seg_no, r.hms) for r in segment_view(df, ordered=True).collect()]
    assert got == [(0, "[00:09:24]"), (1, "[01:00:00]"), (2, None)]


def test_interval_join_invariant_to_order_and_partitions(spark):
    rng = random.Random(9)
    segs = [(t, s, float(s * 10), float(s * 10 + 12)) for t in range(5) for s in range(8)]
    items = [(t, i, round(rng.uniform(0, 90), 2), "pronunciation", f"w{i}") for t in range(5) for i in range(70)]
    a = run(spark, segs, items)
    rng.shuffle(segs)
    rng.shuffle(items)
    sdf = spark.createDataFrame(segs, SEG).repartition(5)
    idf = spark.createDataFrame(items, ITEM).repartition(3)
    b = {(r.transcript_id, r.seg_no): r.text for r in segment_text(sdf, idf).collect()}
    assert a == b == brute(segs, items)


def test_closed_left_option(spark):
    segs = [(1, 0, 0.0, 1.0), (1, 1, 1.0, 2.0)]
    items = [(1, 0, 1.0, "pronunciation", "edge"), (1, 1, 2.0, "pronunciation", "end")]
    both = run(spark, segs, items)
    left = run(spark, segs, items, closed="left")
    assert both == {(1, 0): "edge", (1, 1): "edge end"}
    assert left == {(1, 0): "", (1, 1): "edge"}


def test_one_endless_segment_does_not_change_the_plan_of_the_others(spark):
    from pyspark.sql import functions as F

    from parlance.operators.segments import segment_text

    segs = spark.createDataFrame([("a", i, float(i), float(i + 1)) for i in range(50)] + [("b", 0, 0.0, 1e12), ("b", 1, 3.0, 4.0), ("c", 0, 0.0, 5e6), ("c", 1, 1.0, 2.0)], "transcript_id string, seg_no long, start_s double, end_s double")
    items = spark.createDataFrame([(t, i, i + 0.5, "pronunciation", f"w{i}") for t in "ab" for i in range(60)] + [("c", i, i * 1e5 + 1.5, "pronunciation", f"w{i}") for i in range(50)], "transcript_id string, item_no long, start_s double, type string, content string")
    want = {}
    for t, no, s, e in [tuple(r) for r in segs.collect()]:
        want[(t, no)] = " ".join(r.content for r in sorted(items.collect(), key=lambda r: r.item_no) if r.transcript_id == t and s <= r.start_s <= e)
    for closed in ("both", "left"):
        out = segment_text(segs, items, closed=closed)
        assert {(r.transcript_id, r.seg_no): r.text for r in out.collect()} == want
    # items of transcripts without long segments are listed once
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set(_tier" in plan
    short = segment_text(segs.where("transcript_id <> 'c'"), items.where("transcript_id <> 'c'"), fanout=512)
    assert "collect_set(_tier" not in short._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.transcript_id, r.seg_no): r.text for r in short.collect()} == {k: v for k, v in want.items() if k[0] != "c"}
    assert short.where(F.col("text") != "").count() > 0
