import random
import re
import tracemalloc

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from parlance.operators import phrases
from parlance.operators.phrases import apply_vocabulary_phrases, entities_from_phrases, match_phrases

words_of = lambda t: [m for m in re.finditer(r"[^\W_]+", t)]


def _brute(text, terms):
    """Leftmost-longest by trying every phrase at every word."""
    known = {}
    for term, value in terms:
        key = tuple(m[0].lower() for m in words_of(term or ""))
        if key and value is not None:
            known[key] = min(value, known.get(key, value))
    ms, out, i = words_of(text), [], 0
    while i < len(ms):
        fits = [n for n in range(1, len(ms) - i + 1) if tuple(m[0].lower() for m in ms[i : i + n]) in known]
        if not fits:
            i += 1
            continue
        n = max(fits)
        key = tuple(m[0].lower() for m in ms[i : i + n])
        out.append((i, n, ms[i].start(), ms[i + n - 1].end(), " ".join(key), known[key]))
        i += n
    return out


@pytest.mark.parametrize("block", [1 << 20, 150])
def test_matches_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(phrases, "BLOCK", block)
    rng = random.Random(1)
    words = ["Supreme", "court", "of", "Öst", "x1", "a", "b", "C"]
    term = lambda: rng.choice([" ", "-", ". "]).join(rng.choice(words) for _ in range(rng.randint(1, 4)))
    terms = [(term(), f"v{rng.randint(0, 9)}") for _ in range(25)] + [("", "v"), (None, "v"), ("--", "v"), ("a b", None), ("é😀 z", "v")]
    texts = [(i, "".join(rng.choice(words + ["é😀", "_"]) + rng.choice([" ", ", ", "\n", "-", "  "]) for _ in range(rng.randint(0, 40)))) for i in range(60)] + [(90, None), (91, "")]
    df = spark.createDataFrame([(*t, "kept") for t in texts], "id long, text string, payload string").repartition(3)
    out = match_phrases(df, spark.createDataFrame(terms, "term string, payload string")).collect()
    assert len(out) == len(texts)
    for r in out:
        assert [tuple(m) for m in r._matches] == (_brute(r.text, terms) if r.text else []) and r.payload == "kept"


def test_entities_of_phrases(spark):
    gazetteer = spark.createDataFrame([("supreme court", "COURT"), ("court", "LEGAL_TERM"), ("U.S. Code", "STATUTE"), ("court", "COURT"), ("court of appeals", "VENUE"), ("appeals", None)], "term string, category string")
    docs = spark.createDataFrame([(1, "The Supreme  Court, the court of\nAppeals. SUPREME-COURT; U.S. code and Court."), (2, "nothing"), (3, None)], "transcript_id long, text string")
    got = [(r.category, r.cat_pos, r.pos, r.value) for r in entities_from_phrases(docs, gazetteer).orderBy("cat_pos", "pos").collect()]
    assert got == [("COURT", 8, 0, "Supreme  Court"), ("COURT", 8, 1, "Court"), ("STATUTE", 11, 0, "U.S. code"), ("VENUE", 14, 0, "court of\nAppeals")]


def test_vocabulary_of_phrases_keeps_all_else(spark):
    vocab = spark.createDataFrame([("cross examination", "cross-examination"), ("e mail", "email"), ("E-Mail", "mail"), ("x", "")], "term string, preferred string")
    rows = [(1, "(Cross  Examination) by e-mail, x!"), (2, "x"), (3, ""), (4, None), (5, "no match é😀"), (5, "no match é😀")]
    out = apply_vocabulary_phrases(spark.createDataFrame(rows, "id long, text string"), vocab).collect()
    assert sorted((r.id, str(r.text_out), r.n_replaced) for r in out) == [
        (1, "(cross-examination) by email, !", 3), (2, "", 1), (3, "", 0), (4, "None", 0), (5, "no match é😀", 0), (5, "no match é😀", 0)]


def test_no_terms(spark):
    df = spark.createDataFrame([(1, "a b")], "id long, text string")
    none = spark.createDataFrame([], "term string, preferred string")
    assert apply_vocabulary_phrases(df, none).first().text_out == "a b"
    assert entities_from_phrases(df.withColumnRenamed("id", "transcript_id"), none.select("term", F.col("preferred").alias("category"))).count() == 0


def test_a_task_holds_the_matches_of_few_texts(monkeypatch):
    """Matches of a batch are made piece by piece; all at once took 96 MB here."""
    monkeypatch.setattr(phrases, "PART", 1 << 16, raising=False)
    texts = [f"alpha beta {i} " * 40 for i in range(4000)] + [None, "", "alpha Beta " * 9000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])
    seen, rows = 0, 0
    tracemalloc.start()
    try:
        for out in phrases._pass([("alpha beta", "v")], "text", True, True)(iter([batch])):
            assert out.schema.names == ["id", "text", "_matches"] and out.column("id").to_pylist() == list(range(rows, rows + out.num_rows))
            counts = pc.list_value_length(out.column("_matches")).to_pylist()
            assert counts == [t.lower().count("alpha beta") if t else 0 for t in out.column("text").to_pylist()]
            rows, seen = rows + out.num_rows, seen + sum(counts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == len(texts) and seen == 4000 * 40 + 9000
    assert peak < 24 << 20


def test_batches_of_texts_are_limited_by_bytes(spark):
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(limit, None)
    try:
        for named, then in ((None, str(4 << 20)), ("12345", "12345")):
            spark.conf.unset(limit)
            if named:
                spark.conf.set(limit, named)
            apply_vocabulary_phrases(spark.createDataFrame([(1, "a b")], "id long, text string"), spark.createDataFrame([("a", "x")], "term string, preferred string"))
            assert spark.conf.get(limit) == then
    finally:
        spark.conf.unset(limit) if before is None else spark.conf.set(limit, before)
