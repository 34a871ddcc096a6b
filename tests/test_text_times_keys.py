
import math

import pytest

from parlance.functions.keys import client_stem, enhanced_key, first_bucket, job_name, media_format, output_key
from parlance.functions.text import py_strip, word_count
from parlance.functions.times import hms, js_parse_float
from parlance.operators.uploads import validate_uploads

TEXTS = ["", "  ", "a b", " a b c\x1cd\x85e ", "line one\nline two\t three", "　x　", "é ü ç"]


def test_word_count_and_strip_match_python(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS] + [(None,)], "t string")
    rows = df.select("t", word_count("t").alias("n"), py_strip("t").alias("s")).collect()
    for r in rows:
        if r.t is None:
            assert r.n == 0
            continue
        assert r.n == len(r.t.split()), repr(r.t)
        assert r.s == r.t.strip(), repr(r.t)


@pytest.mark.parametrize(
    "raw,expected",
    [("564.799", "[00:09:24]"), ("3600", "[01:00:00]"), ("360000.5", "[100:00:00]"), ("59.999", "[00:00:59]"),
     ("abc", None), ("12.5s", "[00:00:12]"), (" 7", "[00:00:07]"), ("-1", "[-1:-1:-1]"), ("1e300", f"[2.777777777777778e+296:{int(1e300 % 3600 // 60):02d}:{int(1e300 % 60):02d}]"),
     ("1e20", f"[27777777777777776:{int(1e20 % 3600 // 60):02d}:{int(1e20 % 60):02d}]"),
     ("Infinity", None)],
)
def test_hms(spark, raw, expected):
    got = spark.createDataFrame([(raw,)], "t string").select(hms(js_parse_float("t")).alias("h")).first().h
    assert got == expected


KEYS = [
    # key, job, format, client stem, enhanced key
    ("a.b.mp3", "stt-a.b", "mp3", "a.b", "stt-a.b_enhanced.json"),
    ("noext", "stt-noext", "noext", "", "stt-noext_enhanced.json"),
    (".hid", "stt-", "hid", "", "stt-_enhanced.json"),
    ("x.", "stt-x", "", "x", "stt-x_enhanced.json"),
    ("a.json.json", "stt-a.json", "json", "a.json", "stt-a_enhanced.json_enhanced.json"),
]


def test_key_derivation(spark):
    df = spark.createDataFrame([(k[0],) for k in KEYS], "key string")
    out = df.select(
        "key", job_name("key").alias("job"), media_format("key").alias("fmt"), client_stem("key").alias("stem"),
        enhanced_key(output_key(job_name("key"))).alias("enh"),
    ).collect()
    got = {r.key: (r.key, r.job, r.fmt, r.stem, r.enh) for r in out}
    for k in KEYS:
        assert got[k[0]] == k
        # same rules as Python / JavaScript on the same string
        assert k[1] == "stt-" + k[0].rsplit(".", 1)[0] and k[2] == k[0].rsplit(".", 1)[-1]
        assert k[3] == ".".join(k[0].split(".")[:-1])


def test_first_bucket(spark):
    df = spark.createDataFrame([('["b1", "b2"]',), ("plain",)], "b string")
    assert [r.x for r in df.select(first_bucket("b").alias("x")).collect()] == ["b1", "plain"]


def test_upload_validation_limits(spark):
    df = spark.createDataFrame(
        [("audio/mpeg", 10485760), ("audio/mpeg", 10485761), ("video/mp4", 10), (None, 10), ("audio/wav", None)],
        "mime string, length long",
    )
    out = validate_uploads(df).select("accepted", "reject_reason").collect()
    assert [(r.accepted, r.reject_reason) for r in out] == [
        (True, None), (False, "too_large"), (False, "bad_type"), (False, "bad_type"), (False, "too_large"),
    ]


def test_py_float_matches_python(spark):
    from parlance.functions.times import py_float

    vals = ["1.5", " 2.5\n", "1_0", "1__0", "_1", "1_", "1.5d", ".5", "5.", "1e3", "1E-2", "inf", "-Infinity", "nan",
            "abc", "", "1,5", "+3", "0x10", "1_000.000_1", "٣"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = {r.v: r.f for r in df.select("v", py_float("v").alias("f")).collect()}
    for v in vals:
        try:
            exp = float(v)
        except ValueError:
            exp = None
        g = got[v]
        if exp is None or v == "٣":  # Unicode digits: Python accepts, we do not (ASCII only)
            assert g is None or v == "٣", v
        elif math.isnan(exp):
            assert g is not None and math.isnan(g), v
        else:
            assert g == exp, (v, g, exp)
