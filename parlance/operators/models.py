"""Model hooks (UDF-1/2/3) and native cleaning of what models return (SCL-9/10,
PRJ-9, JOIN-6, AGG-8).

Models are external, slow and nondeterministic, so they are isolated: a model is
a picklable callable ``list[str] -> list[str | None]`` (one response per
request, ``None`` for a failed call) created once per partition inside
``mapInPandas``.  Everything after the call -- fence stripping, strict JSON
validation, field extraction -- is native Spark expressions, so raw responses
can be stored and re-parsed without calling the model again.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.functions.text import py_strip
from parlance.schemas import SEGMENT_STRUCT

ModelFactory = Callable[[], Callable[[list[str]], list]]

FENCE = "```"
JSON_FENCE = "```json"


def strip_fence(response) -> Column:
    """SCL-9: strip surrounding whitespace; if the text starts with a code fence,
    keep what follows the first ```` ```json ```` up to the next fence.  A fence
    without ``json`` yields null (a failed response)."""
    t = py_strip(F.col(response) if isinstance(response, str) else response)
    after = F.get(F.split(t, JSON_FENCE, -1), 1)
    inner = py_strip(F.get(F.split(after, FENCE, -1), 0))
    return F.when(F.startswith(t, F.lit(FENCE)), inner).otherwise(t)


def strict_json_object(text) -> Column:
    """SCL-10: VARIANT of ``text`` iff it is exactly one JSON object.

    ``try_parse_json`` (like ``from_json``) accepts trailing text, so the text is
    wrapped in ``[...]``: trailing text or a second value either fails to parse or
    shows up as element 1.  The value must also be an object.
    """
    t = F.col(text) if isinstance(text, str) else text
    wrapped = F.try_parse_json(F.concat(F.lit("["), t, F.lit("]")))
    # a text such as ``{..}],[{..}`` closes the list itself; inside an object it cannot
    named = F.try_parse_json(F.concat(F.lit('{"v": '), t, F.lit("}")))
    single = wrapped.isNotNull() & named.isNotNull() & F.try_variant_get(wrapped, "$[1]", "variant").isNull()
    obj = F.startswith(t, F.lit("{")) & F.endswith(t, F.lit("}"))
    return F.when(single & obj, F.try_variant_get(wrapped, "$[0]", "variant"))


@F.pandas_udf(T.StringType())
def _python_json_object(texts: pd.Series) -> pd.Series:
    """Exact SCL-10 check with Python's ``json.loads`` (Arrow-batched): the text
    re-serialised when it is one JSON object (duplicate keys resolved as Python
    does, last wins), else null."""

    def one(t):
        if t is None:
            return None
        try:
            obj = json.loads(t)
        except ValueError:
            return None
        return json.dumps(obj) if isinstance(obj, dict) else None

    return texts.map(one)


def _no_text(x: Column) -> Column:
    """Whether a variant holds something else than text or null."""
    return x.isNotNull() & ~F.schema_of_variant(x).isin("STRING", "VOID")


def _text(x: Column) -> Column:
    """The text of a variant that is text, else null."""
    return F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))


def _texts(x: Column) -> Column:
    """The texts of a variant that is a list (what else it holds is left out) or one text; null for anything else."""
    many = F.filter(F.transform(F.try_variant_get(x, "$", "array<variant>"), _text), lambda t: t.isNotNull())
    return F.when(F.schema_of_variant(x) == "STRING", F.array(F.try_variant_get(x, "$", "string"))).otherwise(many)


def clean_model_output(df: DataFrame, response: str = "response", *, exact_json: bool = False) -> DataFrame:
    """Parse model responses into D8 fields with an error column (never raises).

    Adds ``ok``, ``error`` (``no_response`` / ``bad_fence`` / ``invalid_json`` /
    ``missing_transcript``: absent or not text / ``missing_segments``: absent, not a list, or holding
    something else than objects whose fields are text, null or absent), ``transcript``, ``segments`` and
    ``entities`` (of a category the texts of its list; one text counts as a list of it, any other value as no category).
    Validation is native by default; ``exact_json=True`` decides validity with
    Python's ``json.loads`` in an Arrow-batched UDF (slower; closes the gaps the
    native check has on contrived bodies and duplicate keys), and fields are then
    read natively from the normalised text.
    """
    cleaned = strip_fence(response)
    out = df.withColumn("_cleaned", cleaned)
    if exact_json:
        out = out.withColumn("_cleaned", F.when(F.col("_cleaned").isNotNull(), F.coalesce(
            _python_json_object(F.col("_cleaned")), F.lit("\u0000invalid"))))
    v = strict_json_object(F.col("_cleaned"))
    out = out.withColumn("_v", v)
    transcript = _text(F.try_variant_get(F.col("_v"), "$.transcript", "variant"))
    segments = F.try_variant_get(F.col("_v"), "$.segments", f"array<{SEGMENT_STRUCT}>")
    typed = F.try_variant_get(F.col("_v"), "$.segments", "array<struct<timestamp:variant,speaker:variant,text:variant>>")
    bad_segments = segments.isNull() | F.exists(typed, lambda s: s.isNull() | F.exists(F.array(s["timestamp"], s["speaker"], s["text"]), _no_text))
    segments = F.when(~bad_segments, segments)
    listed = F.try_variant_get(F.col("_v"), "$.entities", "map<string,variant>")
    entities = F.coalesce(
        F.map_filter(F.transform_values(listed, lambda _, x: _texts(x)), lambda _, x: x.isNotNull()),
        F.create_map().cast("map<string,array<string>>"),
    )
    error = (
        F.when(F.col(response).isNull(), F.lit("no_response"))
        .when(F.col("_cleaned").isNull(), F.lit("bad_fence"))
        .when(F.col("_v").isNull(), F.lit("invalid_json"))
        .when(transcript.isNull(), F.lit("missing_transcript"))
        .when(bad_segments, F.lit("missing_segments"))
    )
    return (
        out.withColumn("error", error)
        .withColumn("ok", F.col("error").isNull())
        .withColumn("transcript", transcript)
        .withColumn("segments", segments)
        .withColumn("entities", entities)
        .drop("_cleaned", "_v")
    )


def ask_batch(model: Callable[[list], list], requests: list) -> list[tuple]:
    """(answer, error) of each request.  A batch whose call fails, or that gets another number of answers than it has
    requests, is asked again request by request, so only the requests that fail themselves have an error."""

    def ask(part: list, alone: bool) -> list[tuple] | None:
        try:
            got = list(model(part))
            if len(got) == len(part):
                return [(g, None) for g in got]
            problem = f"{len(got)} answers to {len(part)} requests"
        except Exception as e:  # noqa: BLE001 - a failed call fails only its request
            problem = f"{type(e).__name__}: {e}"
        return [(None, problem)] if alone else None

    got = ask(requests, alone=False)
    return got if got is not None else [ask([r], alone=True)[0] for r in requests]


def apply_model(
    df: DataFrame,
    model_factory: ModelFactory,
    *,
    request: str = "payload",
    response: str = "response",
    batch_rows: int = 64,
    concurrency: int | None = None,
    spread_by: list[str] | None = None,
) -> DataFrame:
    """UDF-1/2/3 hook: call the model for every row's request, ``batch_rows`` at a
    time, through ``mapInPandas``.  Partitions are the concurrency limit: with
    ``concurrency`` the requests are hash-spread (on ``spread_by``, deterministic
    under retries) over exactly that many partitions, i.e. parallel clients.

    A batch whose call fails, or that gets another number of answers than it has
    requests, is asked again request by request, so only the requests that fail
    themselves get a null response; ``<response>_error`` holds the error's text."""
    error = f"{response}_error"
    out_schema = T.StructType(list(df.schema.fields) + [T.StructField(c, T.StringType(), True) for c in (response, error)])
    if concurrency:
        df = df.repartition(int(concurrency), *(spread_by or [request]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = model_factory()
        for pdf in batches:
            reqs = pdf[request].tolist()
            outs: list[tuple] = []
            for i in range(0, len(reqs), batch_rows):
                outs.extend(ask_batch(model, reqs[i : i + batch_rows]))
            pdf[response], pdf[error] = [o for o, _ in outs], [e for _, e in outs]
            yield pdf

    return df.mapInPandas(run, out_schema)


def echo_model_factory():
    """Deterministic stand-in for the rewriting model: returns the chunk as
    ``{"transcript": texts joined by one space, "segments": unchanged}``."""

    def model(payloads: list[str]) -> list:
        out = []
        for p in payloads:
            if p is None:
                out.append(None)
                continue
            segs = json.loads(p)
            out.append(json.dumps({"transcript": " ".join(s.get("text") or "" for s in segs), "segments": segs}))
        return out

    return model


def chunk_audit(manifest: DataFrame, cleaned: DataFrame, *, key: str = "transcript_id", chunk: str = "chunk_no") -> DataFrame:
    """PRJ-9 + JOIN-6 + AGG-8 per transcript: chunks sent, chunks that came back
    valid, chunks lost (manifest anti-joined with the valid responses) and a status
    (``FAILED`` when nothing valid came back, ``PARTIAL`` when some chunks were lost)."""
    # manifest rows and responses of a chunk meet in one aggregation; a chunk counts if it was sent
    sent = manifest.select(key, chunk, F.lit(1).alias("_sent"), F.lit(0).alias("_ok"))
    came = cleaned.select(key, chunk, F.lit(0).alias("_sent"), F.col("ok").cast("int").alias("_ok"))
    rows = sent.unionByName(came).groupBy(key, chunk).agg(F.max("_sent").alias("_sent"), F.max("_ok").alias("_ok")).where("_sent = 1")
    return _audited(rows, key, chunk, F.coalesce(F.col("_ok"), F.lit(0)) == 1)


def answers_audit(cleaned: DataFrame, *, key: str = "transcript_id", chunk: str = "chunk_no") -> DataFrame:
    """``chunk_audit`` where every chunk sent has one row in ``cleaned`` (as ``apply_model`` gives): one aggregation."""
    return _audited(cleaned.select(key, chunk, "ok"), key, chunk, F.col("ok"))


def _audited(rows: DataFrame, key: str, chunk: str, ok: Column) -> DataFrame:
    agg = rows.groupBy(key).agg(
        F.count(F.lit(1)).cast("bigint").alias("n_chunks"),
        F.count_if(~ok).cast("bigint").alias("n_lost"),
        F.min(F.when(~ok, F.col(chunk))).alias("first_lost"),
    )
    agg = agg.withColumn("n_ok", F.col("n_chunks") - F.col("n_lost"))
    return agg.withColumn(
        "status",
        F.when(F.col("n_ok") == 0, "FAILED").when(F.col("n_lost") > 0, "PARTIAL").otherwise("OK"),
    ).withColumn("http_code", F.when(F.col("n_ok") == 0, 500).otherwise(200))


def transcribe(audio: DataFrame, model_factory: ModelFactory, *, batch_rows: int = 8) -> DataFrame:
    """UDF-1 hook: speech-to-text over audio objects.

    ``audio`` has ``path`` and ``content`` (``binaryFile``) plus the job columns of
    ``derive_job_keys`` (``job_name``, ``media_format``).  The model receives JSON
    requests ``{uri, format, language, speaker_labels, max_speakers}`` and returns
    raw transcript JSON (D4) or ``None``; the result is parsed with the fixed D4
    schema (no inference) into ``raw`` plus a ``transcribe_error`` column.  A
    ``language`` column routes each object (null: the default language); ``content``
    is left out, since the model gets the object's address.
    """
    from parlance.schemas import LANGUAGE_CODE, MAX_SPEAKERS, RAW_TRANSCRIPT_DDL

    req = F.to_json(
        F.struct(
            F.col("path").alias("uri"),
            F.col("media_format").alias("format"),
            (F.coalesce("language", F.lit(LANGUAGE_CODE)) if "language" in audio.columns else F.lit(LANGUAGE_CODE)).alias("language"),
            F.lit(True).alias("speaker_labels"),
            F.lit(MAX_SPEAKERS).alias("max_speakers"),
        )
    )
    with_req = audio.withColumn("_request", req).drop("content")
    answered = apply_model(with_req, model_factory, request="_request", response="_raw_json", batch_rows=batch_rows)
    parsed = F.from_json("_raw_json", RAW_TRANSCRIPT_DDL)
    return (
        answered.withColumn("raw", parsed)
        .withColumn(
            "transcribe_error",
            F.when(F.col("_raw_json").isNull(), F.lit("no_response"))
            .when(F.col("raw.results").isNull(), F.lit("invalid_transcript")),
        )
        .withColumn("transcript_id", F.coalesce(F.col("raw.jobName"), F.col("job_name")))
        .drop("_request", "_raw_json", "_raw_json_error")
    )


def entities_with_model(
    docs: DataFrame,
    model_factory: ModelFactory,
    *,
    key: str = "transcript_id",
    text: str = "transcript",
    concurrency: int | None = None,
) -> DataFrame:
    """UDF-3 through a model: the whole transcript text is the request (the token
    budget does not apply, as in the service); the response is cleaned natively and
    its ``entities`` map is returned in long form.  Failed extractions keep a row in
    the second output with ``error`` so the transcript can be stored without
    entities (status NER_FAILED) instead of failing the run.
    Returns ``(long_entities, failures)``."""
    from parlance.operators.entities import entities_from_map

    req = docs.select(key, F.col(text).alias("_request"))
    from parlance.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(docs.sparkSession)
    # raw answers are written once: both outputs below read them, so the model is
    # called once per transcript
    answered = apply_model(req, model_factory, request="_request", response="response",
                           concurrency=concurrency, spread_by=[key]).checkpoint(eager=True)
    cleaned = clean_model_output(answered)
    # an entity response needs no transcript field: only JSON validity counts here
    failures = cleaned.where(F.col("error").isin("no_response", "bad_fence", "invalid_json")).select(
        key, F.coalesce("response_error", "error").alias("error"), F.lit("NER_FAILED").alias("status")
    )
    good = cleaned.where(~F.col("error").isin("no_response", "bad_fence", "invalid_json") | F.col("error").isNull())
    return entities_from_map(good.select(key, "entities"), key=key), failures
