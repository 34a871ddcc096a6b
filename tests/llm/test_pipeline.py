import collections
import zlib

import corpus_pipeline
from parlance.llm import queries as llm
from pyspark.sql import functions as F

from tests.llm.test_operators import _components, _hits, odd  # noqa: F401 - odd is a fixture

SF = "/root/testdata/sf0.001"


def test_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "secrets", "packing"]
    at = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at[name] = docs
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns
        at[name + "-out"] = docs
    rows = lambda name: sorted((r.doc_id, r.text) for r in at[name].collect())

    scored = {r.doc_id: r.score for r in llm.queries()["op2_noisy_or"](spark, SF).collect()}
    assert rows("toxicity-out") == [r for r in rows("toxicity") if scored[r[0]] < 0.5]
    comp = _components(rows("near_duplicates"), 5, 80, 100)
    assert rows("near_duplicates-out") == [r for r in rows("near_duplicates") if comp[r[0]][0] == 0 or comp[r[0]][1] == r[0]]
    assert rows("decontamination-out") == [r for r in rows("decontamination") if _hits(items, r[1])[1] == 0]
    before, after = dict(rows("secrets")), {r.doc_id: r for r in at["secrets-out"].collect()}
    assert before.keys() == after.keys()
    assert all(r.text == before[i] or "[SECRET]" in r.text for i, r in after.items())
    assert all(r.n_chars == len(r.text) for r in after.values())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == after.keys()
    run = corpus_pipeline.run(spark, SF).collect()
    key = lambda rows: collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert key(run) == key(packed)


def test_queries_are_registered_once_per_operator(spark):
    names = sorted(llm.queries(), key=lambda n: int(n[2:].split("_")[0]))
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14))
    out = llm.queries()["op2_noisy_or"](spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for r in out)


def test_stages_on_odd_and_empty_tables(spark, odd):  # noqa: F811
    docs = odd.withColumn("row", F.lit("clash"))
    for df, some in ((docs, True), (docs.where("1 = 0"), False)):
        now = df
        for _, stage in corpus_pipeline.STAGES[:-1]:
            before = now.count()
            now = stage(spark, now, SF).cache()
            assert now.columns == df.columns and now.count() <= before
        kept = now.collect()
        assert (len(kept) > 0) == some
        if some:
            assert sum(r.text is None for r in kept) == 2 and sum(r.text == "one" and r.doc_id is None for r in kept) == 1
            ids = [r.doc_id for r in kept if r.text and r.text.split()]
            assert ids.count(5) == 1 and 6 not in ids and ids.count(7) == 1  # a repeated row and a near copy
        packed = corpus_pipeline.STAGES[-1][1](spark, now, SF).collect()
        assert len({(r.sequence_id, r.offset) for r in packed}) == len(packed) and (len(packed) > 0) == some
