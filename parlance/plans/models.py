"""Queries: clean_model_output, chunk_audit, apply_model, apply_model_stored, enhance_by_language.

Stand-in for model responses: every ``events`` row is the response to one chunk
(``user_id`` = transcript, ``event_id`` = chunk).  The body is a JSON object
built from the row; the shape depends on ``event_id % 20``: plain JSON, a
```` ```json ```` fence, a bare fence, trailing text, a preamble before the fence,
single quotes, an empty string (11), missing or malformed segments (12, 13), two
objects that close a list between them (14), a body with entities (15), values that are no
text (16, 17) and entities that are one text or a mixed list (18, 19), so every
cleaning rule is exercised on the whole table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions.text import WS
from parlance.operators.answers import AnswerStore, ask_once
from parlance.operators.models import apply_model, chunk_audit, clean_model_output, echo_model_factory
from parlance.operators.packing import pack_chunks, token_counts
from parlance.operators.recombine import chunk_payload
from parlance.plans.chunking import packing_cte
from parlance.plans.registry import query
from parlance.sources.tables import conversation_segments, spread, table

BODY_SQL = """'{"transcript": "' || event_type || ' ' || event_id || '", "segments": [{"timestamp": "' || event_id
  || '", "speaker": "spk_' || (user_id % 3) || '", "text": "' || event_type || '"}]}'"""
RESPONSE_SQL = f"""CASE event_id % 20
    WHEN 0 THEN {BODY_SQL}
    WHEN 1 THEN '```json' || chr(10) || {BODY_SQL} || chr(10) || '```'
    WHEN 2 THEN '```' || chr(10) || {BODY_SQL} || chr(10) || '```'
    WHEN 3 THEN {BODY_SQL} || ' trailing words'
    WHEN 4 THEN 'Here is the JSON:' || chr(10) || '```json' || chr(10) || {BODY_SQL} || chr(10) || '```'
    WHEN 5 THEN replace({BODY_SQL}, '"', '''')
    WHEN 6 THEN '  ' || {BODY_SQL} || chr(10)
    WHEN 7 THEN '```json ' || {BODY_SQL} || '``` and more'
    WHEN 8 THEN '{{"segments": []}}'
    WHEN 9 THEN {BODY_SQL} || ', ' || {BODY_SQL}
    WHEN 10 THEN '```json' || chr(10) || {BODY_SQL}
    WHEN 11 THEN ''
    WHEN 12 THEN '{{"transcript": "no list"}}'
    WHEN 13 THEN '{{"transcript": "no list", "segments": "none"}}'
    WHEN 14 THEN {BODY_SQL} || '],[' || {BODY_SQL}
    WHEN 16 THEN '{{"transcript": ' || event_id || ', "segments": []}}'
    WHEN 17 THEN '{{"transcript": "t", "segments": [{{"timestamp": "1", "text": ' || event_id || '}}]}}'
    WHEN 18 THEN '{{"entities": {{"JUDGE": "' || event_type || '", "COURT": ' || user_id || '}}, "transcript": "t", "segments": [{{"text": null}}]}}'
    WHEN 19 THEN '{{"entities": {{"JUDGE": [' || event_id || ', "' || event_type || '", null]}}, "transcript": "t", "segments": []}}'
    ELSE '{{"entities": {{"JUDGE": ["' || event_type || '", "' || user_id || '"]}}, "transcript": "t", "segments": []}}' END"""


def responses(spark, sf_dir):
    ev = spread(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), "event_id")
    # the body is built once, then shaped (keeps the generated code small)
    with_body = ev.select("event_id", "user_id", "event_type", F.expr(BODY_SQL).alias("body"))
    shaped = RESPONSE_SQL.replace(BODY_SQL, "body").replace("chr(10)", "char(10)")
    return with_body.select("event_id", "user_id", F.expr(shaped).alias("response"))


def strip_sql(x: str) -> str:
    """Python ``str.strip()`` in DuckDB SQL."""
    return f"regexp_replace({x}, '^{WS}|{WS}$', '', 'g')"


CLEAN_SQL = f"""
WITH r AS (SELECT event_id, user_id, {RESPONSE_SQL} AS response FROM events),
s AS (SELECT *, {strip_sql('response')} AS t FROM r),
c AS (
  SELECT *, CASE WHEN starts_with(t, '```')
                 THEN {strip_sql("string_split(string_split(t, '```json')[2], '```')[1]")}
                 ELSE t END AS cleaned
  FROM s
), v AS (
  SELECT *, coalesce(json_valid(cleaned), false) AND starts_with(cleaned, '{{') AND ends_with(cleaned, '}}') AS valid
  FROM c
)
SELECT event_id, user_id,
       CASE WHEN cleaned IS NULL THEN 'bad_fence'
            WHEN NOT valid THEN 'invalid_json'
            WHEN coalesce(json_type(cleaned, '$.transcript'), '') <> 'VARCHAR' THEN 'missing_transcript'
            WHEN NOT listed THEN 'missing_segments' END AS error,
       CASE WHEN valid AND json_type(cleaned, '$.transcript') = 'VARCHAR' THEN json_extract_string(cleaned, '$.transcript') END AS transcript,
       CASE WHEN valid AND listed THEN json_array_length(cleaned, '$.segments') END::BIGINT AS n_segments,
       CASE WHEN valid AND json_type(cleaned, '$.entities.JUDGE') = 'VARCHAR' THEN json_extract_string(cleaned, '$.entities.JUDGE')
            WHEN valid AND json_type(cleaned, '$.entities.JUDGE') = 'ARRAY'
            THEN array_to_string(list_transform(list_filter(json_extract(cleaned, '$.entities.JUDGE[*]'), lambda j: json_type(j) = 'VARCHAR'), lambda j: json_extract_string(j, '$')), '|') ELSE '' END AS judges
FROM (SELECT *, coalesce(json_type(cleaned, '$.segments'), '') = 'ARRAY'
                AND NOT list_has_any(json_type(cleaned, '$.segments[*].text'), ['UBIGINT', 'BIGINT', 'DOUBLE']) AS listed
      FROM (SELECT event_id, user_id, valid, CASE WHEN cleaned IS NULL OR valid THEN cleaned ELSE '{{}}' END AS cleaned FROM v))"""


@query("clean_model_output", CLEAN_SQL)
def q_clean_model_output(spark, sf_dir):
    out = clean_model_output(responses(spark, sf_dir))
    return out.select(
        "event_id", "user_id", "error", "transcript", F.size("segments").cast("bigint").alias("n_segments"),
        F.coalesce(F.array_join(F.try_element_at("entities", F.lit("JUDGE")), "|"), F.lit("")).alias("judges"),
    ).withColumn("n_segments", F.when(F.col("n_segments") >= 0, F.col("n_segments")))


@query(
    "chunk_audit",
    f"""WITH x AS ({CLEAN_SQL})
SELECT user_id, count(*)::BIGINT AS n_chunks,
       count(*) FILTER (WHERE error IS NOT NULL)::BIGINT AS n_lost,
       min(event_id) FILTER (WHERE error IS NOT NULL) AS first_lost,
       count(*) FILTER (WHERE error IS NULL)::BIGINT AS n_ok,
       CASE WHEN count(*) FILTER (WHERE error IS NULL) = 0 THEN 'FAILED'
            WHEN count(*) FILTER (WHERE error IS NOT NULL) > 0 THEN 'PARTIAL' ELSE 'OK' END AS status,
       CASE WHEN count(*) FILTER (WHERE error IS NULL) = 0 THEN 500 ELSE 200 END AS http_code
FROM x GROUP BY user_id""",
)
def q_chunk_audit(spark, sf_dir):
    resp = responses(spark, sf_dir).withColumnRenamed("user_id", "transcript_id").withColumnRenamed("event_id", "chunk_no")
    cleaned = clean_model_output(resp)
    audit = chunk_audit(resp.select("transcript_id", "chunk_no"), cleaned)
    return audit.select(
        F.col("transcript_id").alias("user_id"), "n_chunks", "n_lost", "first_lost", "n_ok", "status", "http_code"
    )


@query(
    "apply_model",
    packing_cte(60)
    + """
SELECT conv_id, chunk_no, true AS ok, string_agg(text, ' ' ORDER BY turn) AS transcript,
       count(*)::BIGINT AS n_segments
FROM packed GROUP BY ALL""",
)
def q_apply_model(spark, sf_dir):
    packed = pack_chunks(token_counts(conversation_segments(spark, sf_dir)), 60)
    payloads = chunk_payload(packed).select("transcript_id", "chunk_no", "payload")
    answered = apply_model(payloads, echo_model_factory)
    out = clean_model_output(answered)
    return out.select(
        F.col("transcript_id").alias("conv_id"), "chunk_no", "ok", "transcript",
        F.size("segments").cast("bigint").alias("n_segments"),
    )


@query(
    "apply_model_stored",
    packing_cte(60)
    + """
, c AS (SELECT conv_id, chunk_no, string_agg(p.text, ' ' ORDER BY p.turn) AS transcript, count(*)::BIGINT AS n_segments,
               list((p.turn, role, p.text) ORDER BY p.turn) AS request
        FROM packed p JOIN conversations USING (conv_id, turn) GROUP BY ALL)
SELECT conv_id, chunk_no, transcript, n_segments, request IN (SELECT request FROM c WHERE conv_id % 2 = 0) AS reused FROM c""",
)
def q_apply_model_stored(spark, sf_dir):
    """UDF-2 with durable answers: a first run asks for half of the conversations, a second one for all of them, and what
    the store has is not asked again."""
    from parlance.session import scratch_path

    packed = pack_chunks(token_counts(conversation_segments(spark, sf_dir)), 60)
    requests = chunk_payload(packed).select("transcript_id", "chunk_no", "payload").checkpoint(eager=True)
    store = AnswerStore(scratch_path(spark, "answers"))
    ask_once(requests.where(F.col("transcript_id") % 2 == 0), echo_model_factory, store)
    out = clean_model_output(ask_once(requests, echo_model_factory, store))
    return out.select(
        F.col("transcript_id").alias("conv_id"), "chunk_no", "transcript", F.size("segments").cast("bigint").alias("n_segments"), F.col("response_reused").alias("reused"),
    )


LANGUAGE_SQL = "CASE conv_id % 7 WHEN 0 THEN 'de' WHEN 1 THEN 'fr' WHEN 2 THEN NULL ELSE 'en' END"


def language_echo(language: str):
    """Stand-in for a client of one language: the echo with the language in front of the transcript."""
    import json

    echo = echo_model_factory()

    def model(payloads: list[str]) -> list:
        answers = [json.loads(a) for a in echo(payloads)]
        return [json.dumps(a | {"transcript": f"[{language}] {a['transcript']}"}) for a in answers]

    return model


@query(
    "enhance_by_language",
    packing_cte(60)
    + f"""
, c AS (SELECT conv_id, chunk_no, '[' || coalesce({LANGUAGE_SQL}, 'en-US') || '] ' || string_agg(text, ' ' ORDER BY turn) AS t, count(*) AS n FROM packed GROUP BY conv_id, chunk_no)
SELECT conv_id, {strip_sql("string_agg(t, ' ' ORDER BY chunk_no)")} AS transcript, sum(n)::BIGINT AS n_segments, 'OK' AS status FROM c GROUP BY conv_id""",
)
def q_enhance_by_language(spark, sf_dir):
    """RM-6: every transcript goes to the client of its language; the answers tell which client gave them."""
    from parlance.operators.enhance import enhance

    segments = conversation_segments(spark, sf_dir)
    languages = segments.select("transcript_id").distinct().select("transcript_id", F.expr(LANGUAGE_SQL.replace("conv_id", "transcript_id")).alias("language"))
    out = enhance(segments, model_factory=language_echo, languages=languages, budget=60)
    return out.select(F.col("transcript_id").alias("conv_id"), "transcript", F.size("segments").cast("bigint").alias("n_segments"), "status")
