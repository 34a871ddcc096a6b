import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from parlance.operators.packing import _fold_groups, compose, fragment_summary, pack_chunks, _evaluate


def brute(ns, budget):
    """Brute-force fold, written from the stated semantics."""
    out, cur, k = [], 0, 0
    for n in ns:
        if cur + n > budget:
            k, cur = k + 1, 0
        out.append(k)
        cur += n
    return out, cur, k


def brute_from(ns, budget, c):
    cur, k = c, 0
    for n in ns:
        if cur + n > budget:
            k, cur = k + 1, 0
        cur += n
    return cur, k


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=40), st.integers(1, 25))
def test_fold_matches_brute(ns, budget):
    chunk, c_out, k_out = _fold_groups(
        np.array(ns), np.array([0]), np.array([len(ns)]), np.array([0]), np.array([0]), budget
    )
    exp, cur, k = brute(ns, budget)
    assert list(chunk) == exp
    assert (c_out[0], k_out[0]) == (cur, k)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=30), st.integers(1, 25))
def test_fragment_summary_is_the_fold_function(ns, budget):
    f = fragment_summary(np.array(ns), budget)
    for c in range(0, budget + 3):
        exit_c, closes = _evaluate(f, c, budget)
        exp_c, exp_k = brute_from(ns, budget, c)
        if c > budget:  # counts above the budget behave alike; the exit count is what matters
            exp_c, exp_k = brute_from(ns, budget, budget + 1)
        assert (exit_c, closes) == (exp_c, exp_k), (c, f)


@settings(max_examples=100, deadline=None)
@given(
    st.lists(st.integers(0, 30), min_size=1, max_size=20),
    st.lists(st.integers(0, 30), min_size=1, max_size=20),
    st.integers(1, 25),
)
def test_compose(a, b, budget):
    fa, fb = fragment_summary(np.array(a), budget), fragment_summary(np.array(b), budget)
    fab = compose(fa, fb, budget)
    for c in range(0, budget + 2):
        assert _evaluate(fab, c, budget) == brute_from(a + b, budget, c)


def test_fixture_edges():
    # exact fit stays; oversize gets own chunk; oversize first -> empty chunk 0; zero tokens stay
    assert brute([5, 5, 1], 10)[0] == [0, 0, 1]
    chunk, _, _ = _fold_groups(np.array([5, 5, 1]), np.array([0]), np.array([3]), np.array([0]), np.array([0]), 10)
    assert list(chunk) == [0, 0, 1]
    chunk, _, _ = _fold_groups(np.array([12, 1, 0, 20, 0]), np.array([0]), np.array([5]), np.array([0]), np.array([0]), 10)
    assert list(chunk) == [1, 2, 2, 3, 4] == brute([12, 1, 0, 20, 0], 10)[0]


@pytest.mark.parametrize("frag_rows,fan_in", [(1000, 4), (3, 2), (2, 3), (1, 2)])
def test_pack_chunks_spark_long_transcripts(spark, frag_rows, fan_in):
    rng = np.random.default_rng(7)
    rows, expected = [], {}
    for t in range(6):
        m = int(rng.integers(1, 30))
        ns = [int(x) for x in rng.integers(0, 14, m)]
        if t == 2:
            ns[0] = 40  # oversize first segment
        for i, n in enumerate(ns):
            rows.append((t, i, n))
        expected[t] = brute(ns, 12)[0]
    df = spark.createDataFrame(rows, "transcript_id long, seg_no long, n_tokens long")
    out = pack_chunks(df, 12, fragment_rows=frag_rows, fan_in=fan_in).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.transcript_id, r.seg_no)):
        got.setdefault(r.transcript_id, []).append(r.chunk_no)
    assert got == expected


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), min_size=1, max_size=12), min_size=1, max_size=6),
       st.lists(st.integers(0, 60), min_size=6, max_size=6), st.integers(1, 25))
def test_fold_several_groups_with_entering_counts(groups, entering, budget):
    """Groups folded together in one batch, entering with counts that may exceed the budget."""
    ns = [n for g in groups for n in g]
    starts = np.cumsum([0] + [len(g) for g in groups[:-1]])
    ends = starts + np.array([len(g) for g in groups])
    c_in = np.array(entering[: len(groups)], dtype=np.int64)
    k_in = np.arange(len(groups), dtype=np.int64) * 100
    chunk, c_out, k_out = _fold_groups(np.array(ns, dtype=np.int64), starts, ends, c_in, k_in, budget)
    for gi, g in enumerate(groups):
        cur, k, exp = int(c_in[gi]), int(k_in[gi]), []
        for n in g:
            if cur + n > budget:
                k, cur = k + 1, 0
            exp.append(k)
            cur += n
        assert list(chunk[starts[gi]:ends[gi]]) == exp
        assert (c_out[gi], k_out[gi]) == (cur, k)


def test_long_transcript_many_batches_and_broadcast_entry(spark):
    """30k segments in one transcript: many Arrow batches per partition, fragments
    entering with oversize counts, and an entry join that AQE turns into a
    broadcast join (which must not split groups)."""
    rng = np.random.default_rng(3)
    n = 30_000
    ns = rng.integers(0, 40, n)
    ns[::97] = 250
    rows = [(0, i, int(x)) for i, x in enumerate(ns)] + [(t, i, int(rng.integers(0, 40))) for t in range(1, 300) for i in range(4)]
    df = spark.createDataFrame(rows, "transcript_id long, seg_no long, n_tokens long").repartition(6)
    got = {(r.transcript_id, r.seg_no): r.chunk_no for r in pack_chunks(df, 100, fragment_rows=1500, fan_in=3).collect()}
    exp0 = brute([int(x) for x in ns], 100)[0]
    assert [got[(0, i)] for i in range(n)] == exp0
    by = {}
    for t, i, x in rows[n:]:
        by.setdefault(t, []).append(x)
    for t, lst in by.items():
        assert [got[(t, i)] for i in range(len(lst))] == brute(lst, 100)[0]
