import json


from parlance.operators.entities import case_header, entity_view, extract_entities, words_to_digits
from parlance.operators.models import apply_model, chunk_audit, clean_model_output, echo_model_factory
from parlance.operators.recombine import combine_chunks

BODY = json.dumps({"transcript": "hello", "segments": [{"timestamp": "1.0", "speaker": "spk_0", "text": "hello"}]})


def test_response_cleaning_fixtures(spark):
    cases = [
        (BODY, None),
        ("```json\n" + BODY + "\n```", None),
        ("  \n" + BODY + "\n ", None),
        ("```\n" + BODY + "\n```", "bad_fence"),
        ("Here it is:\n```json\n" + BODY + "\n```", "invalid_json"),
        (BODY + " trailing", "invalid_json"),
        (BODY.replace('"', "'"), "invalid_json"),
        ("", "invalid_json"),
        ('["a"]', "invalid_json"),
        (BODY + ", " + BODY, "invalid_json"),
        ('{"segments": []}', "missing_transcript"),
        (None, "no_response"),
        ('{"transcript": 5, "segments": []}', "missing_transcript"),
        ('{"transcript": null, "segments": []}', "missing_transcript"),
        ('{"transcript": ["a"], "segments": []}', "missing_transcript"),
        ('{"transcript": "a", "segments": [{"text": 1}]}', "missing_segments"),
        ('{"transcript": "a", "segments": [{"text": {"a": "b"}}]}', "missing_segments"),
        ('{"transcript": "a", "segments": ["a"]}', "missing_segments"),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i long, response string")
    out = {r.i: r for r in clean_model_output(df).collect()}
    for i, (_, err) in enumerate(cases):
        assert out[i].error == err, (i, cases[i][0], out[i].error)
        # the Python rule the original service applies, re-stated
        if err is None:
            assert out[i].transcript == "hello" and out[i].segments[0].speaker == "spk_0"
            assert out[i].entities == {}  # missing 'entities' key -> empty map


def test_entity_values_that_are_no_lists(spark):
    body = '{"transcript": "a", "segments": [{"text": null}], "entities": {"JUDGE": "Smith", "COURT": ["A", 1, null, "B"], "DATE": 5, "EXPERT": null, "COMPANY": []}}'
    r = clean_model_output(spark.createDataFrame([(body,)], "response string")).first()
    assert r.error is None and r.entities == {"JUDGE": ["Smith"], "COURT": ["A", "B"], "COMPANY": []}
    assert r.segments[0].text is None
    odd = '{"transcript": "a", "segments": [], "entities": "none"}'
    assert clean_model_output(spark.createDataFrame([(odd,)], "response string")).first().entities == {}


def test_two_rules_of_one_category_give_one_list(spark):
    from parlance.operators.entities import entity_map

    df = spark.createDataFrame([(1, "b2 a1 b2 a3"), (2, "none"), (3, None)], "transcript_id long, text string")
    long = extract_entities(df, (("X", "a[0-9]"), ("Y", "[0-9]"), ("X", "[ab][0-9]")))
    assert {r.transcript_id: r.entities for r in entity_map(long).collect()} == {1: {"X": ["a1", "a3", "b2"], "Y": ["2", "1", "3"]}}
    split = spark.createDataFrame([(1, "X", 3, 0, "v"), (1, "X", 0, 1, "w"), (1, "X", 0, 0, "v"), (1, "Y", 1, 0, "y")], "transcript_id long, category string, cat_pos int, pos long, value string")
    assert list(entity_map(split).first().entities.items()) == [("X", ["v", "w"]), ("Y", ["y"])]


def test_repeated_vocabulary_terms(spark):
    from parlance.operators.analytics import apply_vocabulary

    vocab = spark.createDataFrame([("a", "Z"), ("a", "Y"), ("a", None), (None, "N"), ("b", None)], "term string, preferred string")
    out = apply_vocabulary(spark.createDataFrame([("a b a",), (None,)], "text string"), vocab)
    assert sorted(str(r.text_out) for r in out.collect()) == ["None", "Y b Y"]


def test_apply_model_echo_and_failures(spark):
    df = spark.createDataFrame([(1, 0, json.dumps([{"timestamp": "0", "speaker": "a", "text": "x y"}])), (1, 1, None)],
                               "transcript_id long, chunk_no long, payload string")
    out = clean_model_output(apply_model(df, echo_model_factory)).orderBy("chunk_no").collect()
    assert [(r.ok, r.transcript) for r in out] == [(True, "x y"), (False, None)]


def test_chunk_audit_and_partial_recombine(spark):
    manifest = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (2, 0)], "transcript_id long, chunk_no long")
    cleaned = spark.createDataFrame(
        [(1, 0, True), (1, 1, False), (1, 2, True), (2, 0, False)], "transcript_id long, chunk_no long, ok boolean"
    )
    got = {r.transcript_id: (r.n_chunks, r.n_lost, r.first_lost, r.status, r.http_code)
           for r in chunk_audit(manifest, cleaned).collect()}
    assert got == {1: (3, 1, 1, "PARTIAL", 200), 2: (1, 1, 0, "FAILED", 500)}
    chunks = spark.createDataFrame(
        [(1, 2, " c ", [("2", "s", "c")]), (1, 0, "a\n", [("0", "s", "a")])],
        "transcript_id long, chunk_no long, transcript string, segments array<struct<timestamp:string,speaker:string,text:string>>",
    )
    r = combine_chunks(chunks).first()
    assert r.transcript == ("a\n" + " " + " c " + " ").strip() and [s.text for s in r.segments] == ["a", "c"]


def test_location_digits_rules(spark):
    vals = ["one X", "Twenty-One", "two,", "fifty-one", "TEN  ten", "Suite forty-two"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r.d for r in df.select(words_to_digits("v").alias("d")).collect()]
    assert got == ["1 X", "21", "two,", "fifty-one", "10  10", "Suite 42"]


def test_entity_view_and_header(spark):
    rows = [
        (1, "CASE_NUMBER", 7, 0, "CV-1"), (1, "DATE", 9, 0, "May 1"), (1, "ATTORNEY", 0, 0, "A"),
        (1, "ATTORNEY", 0, 1, "B"), (1, "LEGAL_TERM", 13, 0, "tort"), (1, "LOCATION", 10, 0, "one Main"),
        (1, "VENUE", 14, 0, "Hall"), (1, "PLAINTIFF", 1, 0, "P1"), (2, "DEFENDANT", 2, 0, "D1"),
        (2, "LEGAL_TERM", 13, 0, "x"), (2, "LEGAL_TERM", 13, 1, "y"), (2, "WITNESS", 4, 0, None),
    ]
    long = spark.createDataFrame(rows, "transcript_id long, category string, cat_pos int, pos long, value string")
    view = {(r.transcript_id, r.category): (r.label, list(r.values), r.color) for r in entity_view(long).collect()}
    assert (1, "CASE_NUMBER") not in view and (1, "DATE") not in view and (2, "WITNESS") not in view
    assert view[(1, "ATTORNEY")][:2] == ("ATTORNEYS", ["A", "B"])
    assert view[(1, "LEGAL_TERM")][0] == "TERM" and view[(2, "LEGAL_TERM")][0] == "TERMS"
    assert view[(1, "LOCATION")][1] == ["1 Main"]
    assert view[(1, "VENUE")][2] == "hsla(0, 0%, 90%, 0.6)"
    hdr = {r.transcript_id: r for r in case_header(long).collect()}
    assert (hdr[1].case_number, hdr[1].case_date, list(hdr[1].plaintiffs), hdr[1].missing_case_number) == ("CV-1", "May 1", ["P1"], False)
    assert hdr[2].case_number is None and hdr[2].missing_case_number and list(hdr[2].defendants) == ["D1"]


def test_extract_unique_first_appearance(spark):
    df = spark.createDataFrame([(1, "mail b@x.io then a@y.io and b@x.io; ip 10.0.0.1")], "transcript_id long, text string")
    got = [(r.category, r.pos, r.value) for r in extract_entities(df).orderBy("cat_pos", "pos").collect()]
    assert got == [("EMAIL", 0, "b@x.io"), ("EMAIL", 1, "a@y.io"), ("IP_ADDRESS", 0, "10.0.0.1")]


def test_entities_with_model_and_failures(spark):
    from parlance.operators.models import entities_with_model

    def factory():
        def model(texts):
            out = []
            for t in texts:
                if "broken" in t:
                    out.append("not json")
                else:
                    out.append("```json\n" + json.dumps({"transcript": t, "entities": {
                        "JUDGE": [w for w in t.split() if w.istitle()], "DATE": []}}) + "\n```")
            return out
        return model

    docs = spark.createDataFrame([(1, "hello Smith and Jones"), (2, "broken reply")], "transcript_id long, transcript string")
    long, failures = entities_with_model(docs, factory, concurrency=2)
    got = sorted((r.transcript_id, r.category, r.pos, r.value) for r in long.collect())
    assert got == [(1, "JUDGE", 0, "Smith"), (1, "JUDGE", 1, "Jones")]
    assert [(r.transcript_id, r.status) for r in failures.collect()] == [(2, "NER_FAILED")]


def test_combine_long_matches_document_form(spark):
    from parlance.operators.recombine import combine_chunks_long

    chunks = spark.createDataFrame(
        [(1, 1, "c d", [("2", "s", "c"), ("3", "t", "d")]), (1, 0, "a", [("0", "s", "a")])],
        "transcript_id long, chunk_no long, transcript string, segments array<struct<timestamp:string,speaker:string,text:string>>",
    )
    long = [r.text for r in combine_chunks_long(chunks).orderBy("transcript_id", "chunk_no", "pos").collect()]
    doc = combine_chunks(chunks).first()
    assert long == [s.text for s in doc.segments] == ["a", "c", "d"]


def test_exact_json_mode_closes_native_gaps(spark):
    exotic = '{"transcript": "a", "segments": []}], [{"b": 2}'
    dup = '{"transcript": "first", "transcript": "last", "segments": []}'
    df = spark.createDataFrame([(1, exotic), (2, dup), (3, BODY), (4, "```\n" + BODY + "\n```")], "i long, response string")
    native = {r.i: (r.error, r.transcript) for r in clean_model_output(df).collect()}
    exact = {r.i: (r.error, r.transcript) for r in clean_model_output(df, exact_json=True).collect()}
    # what Python's json.loads says about the same texts
    assert exact[1] == ("invalid_json", None)
    assert exact[2] == (None, json.loads(dup)["transcript"]) == (None, "last")
    assert exact[3] == native[3] == (None, "hello")
    assert exact[4] == native[4] == ("bad_fence", None)
    assert native[1] == ("invalid_json", None)  # closing the list inside the text does not help
