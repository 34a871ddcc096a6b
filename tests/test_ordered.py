import random

from parlance.operators.ordered import with_next, with_prev


def test_lead_lag_with_a_hot_key_across_many_partitions(spark):
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        key = 0 if i % 3 else rng.randint(1, 40)  # key 0 holds two thirds of the rows
        rows.append((key, i, rng.random()))
    df = spark.createDataFrame(rows, "k long, o long, v double")
    got = {r.o: r.next_v for r in with_next(df, "k", "o", ["v"], num_partitions=13).collect()}
    prev = {r.o: r.prev_v for r in with_prev(df, "k", ["o"], ["v"], num_partitions=7).collect()}
    by_key = {}
    for k, o, v in rows:
        by_key.setdefault(k, []).append((o, v))
    for k, lst in by_key.items():
        lst.sort()
        for j, (o, v) in enumerate(lst):
            assert got[o] == (lst[j + 1][1] if j + 1 < len(lst) else None)
            assert prev[o] == (lst[j - 1][1] if j > 0 else None)


def test_lead_and_fold_across_many_small_arrow_batches(spark):
    """Force 50-row Arrow batches so the carry between batches is exercised."""
    from parlance.operators.packing import pack_chunks

    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        rng = random.Random(8)
        rows = [(k, i, rng.randint(0, 30)) for k in range(4) for i in range(400)]
        df = spark.createDataFrame(rows, "k long, o long, v long")
        nxt = {(r.k, r.o): r.next_v for r in with_next(df, "k", "o", ["v"], num_partitions=3).collect()}
        prv = {(r.k, r.o): r.prev_v for r in with_prev(df, "k", "o", ["v"], num_partitions=2).collect()}
        for k, o, v in rows:
            assert nxt[(k, o)] == (rows[k * 400 + o + 1][2] if o + 1 < 400 else None)
            assert prv[(k, o)] == (rows[k * 400 + o - 1][2] if o > 0 else None)
        seg = df.withColumnRenamed("k", "transcript_id").withColumnRenamed("o", "seg_no").withColumnRenamed("v", "n_tokens")
        got = {(r.transcript_id, r.seg_no): r.chunk_no for r in pack_chunks(seg, 45).collect()}
        for k in range(4):
            cur, c, exp = 0, 0, []
            for o in range(400):
                n = rows[k * 400 + o][2]
                if cur + n > 45:
                    c, cur = c + 1, 0
                exp.append(c)
                cur += n
            assert [got[(k, o)] for o in range(400)] == exp
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


from hypothesis import given, settings, strategies as st  # noqa: E402


@settings(max_examples=12, deadline=None)
@given(
    st.lists(st.tuples(st.integers(0, 4), st.integers(0, 10_000)), min_size=1, max_size=120, unique_by=lambda t: t[1]),
    st.integers(1, 9),
    st.booleans(),
)
def test_lead_property(spark, rows, nparts, descending):
    data = [(k, o, o * 7 % 101) for k, o in rows]
    df = spark.createDataFrame(data, "k long, o long, v long")
    out = with_next(df, "k", "o", ["v"], num_partitions=nparts, descending=descending).collect()
    got = {(r.k, r.o): r.next_v for r in out}
    assert len(out) == len(data)
    by = {}
    for k, o, v in data:
        by.setdefault(k, []).append((o, v))
    for k, lst in by.items():
        lst.sort(reverse=descending)
        for j, (o, _) in enumerate(lst):
            assert got[(k, o)] == (lst[j + 1][1] if j + 1 < len(lst) else None)
