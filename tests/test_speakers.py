import random

from parlance.operators.analytics import state_durations, state_spells
from parlance.operators.segments import resolve_speakers
from parlance.operators.speakers import infer_speakers, name_evidence

SEGMENTS = "transcript_id string, seg_no long, speaker string, text string"


def test_names_from_court_talk(spark):
    rows = [
        ("t", 0, "spk_0", "Good morning. Mr. Lee, please state your name."),
        ("t", 1, "spk_1", "My name is Adam Lee, counsel for nobody."),
        ("t", 2, "spk_0", "Thank you, Adam Lee. Ms. Young, you may proceed."),
        ("t", 3, "spk_2", "Jane Young for the defendant."),
        ("t", 4, "spk_2", None),
        ("u", 0, "spk_0", "nothing is said here"),
        ("u", 1, None, "My name is Nobody Known."),
    ]
    segs = spark.createDataFrame(rows, SEGMENTS)
    names = {(r.transcript_id, r.speaker_label): (r.name, r.score) for r in infer_speakers(segs).collect()}
    assert names == {("t", "spk_1"): ("Adam Lee", 7), ("t", "spk_2"): ("Jane Young", 3)}
    named = resolve_speakers(segs, infer_speakers(segs)).collect()
    assert len(named) == len(rows) and {r.speaker_name for r in named if r.speaker == "spk_1"} == {"Adam Lee"}


def test_greedy_choice_and_ties_by_brute_force(spark):
    rng = random.Random(3)
    rules = (("self", "([A-E])!", 3), ("next", r"([A-E])\?", 2), ("previous", r"([A-E])\.", 1))
    rows = []
    for t in range(25):
        n = rng.randint(1, 30)
        rows += [(f"t{t}", i, rng.choice("xyzw"), "".join(rng.choice("ABCDE") + rng.choice("!?.") for _ in range(rng.randint(0, 4)))) for i in range(n)]
    segs = spark.createDataFrame(rows, SEGMENTS).repartition(3)
    scores = {}
    by = {}
    for t, i, s, x in rows:
        by.setdefault(t, []).append((i, s, x))
    for t, segments in by.items():
        for i, s, x in segments:
            for name, sign in zip(x[::2], x[1::2]):
                j = i + {"!": 0, "?": 1, ".": -1}[sign]
                if 0 <= j < len(segments) and (sign == "!" or segments[j][1] != s):
                    k = (t, segments[j][1], name)
                    scores[k] = scores.get(k, 0) + {"!": 3, "?": 2, ".": 1}[sign]
    got = {}
    for r in name_evidence(segs, rules).collect():
        k = (r.transcript_id, r.speaker_label, r.name)
        got[k] = got.get(k, 0) + r.weight
    assert got == scores
    want, taken = set(), set()
    for (t, label, name), score in sorted(scores.items(), key=lambda e: (e[0][0], -e[1], e[0][1], e[0][2])):
        if (t, 0, label) not in taken and (t, 1, name) not in taken:
            taken |= {(t, 0, label), (t, 1, name)}
            want.add((t, label, name, score))
    assert {(r.transcript_id, r.speaker_label, r.name, r.score) for r in infer_speakers(segs, rules).collect()} == want


def test_no_evidence_no_names(spark):
    segs = spark.createDataFrame([], SEGMENTS)
    assert infer_speakers(segs).count() == 0
    one = spark.createDataFrame([("t", 0, "a", "My name is Ann.")], SEGMENTS)
    assert infer_speakers(one, least=6).count() == 0 and infer_speakers(one, (("self", "name is ([A-Z][a-z]+)", 1),)).first().name == "Ann"


def test_time_in_each_state_over_restarts(spark):
    from datetime import datetime, timedelta

    t0 = datetime(2024, 1, 1)
    rng = random.Random(4)
    rows, jobs = [], ["hot"] * 30 + ["a", "b", "c"]
    for i in range(900):
        rows.append((i, rng.choice(jobs), rng.choice(["QUEUED", "IN_PROGRESS", "COMPLETED", "FAILED"]), t0 + timedelta(seconds=rng.randint(0, 5000))))
    ev = spark.createDataFrame(rows, "event_id long, job_name string, status string, ts timestamp").repartition(5)
    want, spells = {}, 0
    for job in set(jobs):
        events = sorted((ts, i, s) for i, j, s, ts in rows if j == job)
        starts = [e for p, e in zip([None, *events], events) if p is None or p[2] != e[2]]
        spells += len(starts)
        for k, (ts, _, s) in enumerate(starts):
            n, total, longest, open_ = want.get((job, s), (0, 0.0, None, None))
            if k + 1 < len(starts):
                d = (starts[k + 1][0] - ts).total_seconds()
                want[(job, s)] = (n + 1, total + d, d if longest is None else max(longest, d), open_)
            else:
                want[(job, s)] = (n + 1, total, longest, ts)
    got = {(r.job_name, r.status): (r.n_entered, r.seconds, r.longest_s, r.open_since) for r in state_durations(ev).collect()}
    assert got == want and state_spells(ev).count() == spells
