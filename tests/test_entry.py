import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert set(df.columns) >= {"conv_id", "transcript_chars", "n_segments", "n_chunks", "status", "output_key"}


def test_every_query_runs_on_the_smallest_tables(spark):
    qs, ors = E.queries(), E.oracle_sql()
    assert set(ors) <= set(qs)
    assert len(qs) >= 40
    for name, fn in sorted(qs.items()):
        df = fn(spark, SF)
        df.write.format("noop").mode("overwrite").save()
