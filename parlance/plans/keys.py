"""Queries: derive_job_keys, resolve_result_uri, validate_uploads, explode_notifications, transcribe_audio.

Stand-ins: every ``documents`` row is an uploaded file (name from source and
doc_id, one of six key shapes; MIME type from the language; size from n_chars),
``pages.url`` are result URIs, and ``events`` are object-created records packed
eight consecutive event ids to a notification.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.operators.uploads import derive_job_keys, resolve_result_uri, validate_uploads
from parlance.plans.registry import query
from parlance.sources.tables import table
from parlance.sources.transcripts import read_notifications
from parlance.streaming.flows import scratch_path

# key shapes: plain, double extension, none, hidden, trailing dot, repeated .json
UPLOAD_KEY_SQL = """CASE doc_id % 6
    WHEN 0 THEN source || '_' || doc_id || '.mp3'
    WHEN 1 THEN source || '_' || doc_id || '.tar.m4a'
    WHEN 2 THEN source || '_' || doc_id
    WHEN 3 THEN '.' || source || doc_id
    WHEN 4 THEN source || '_' || doc_id || '.'
    ELSE source || '_' || doc_id || '.json.json' END"""
UPLOAD_BUCKET_SQL = "CASE WHEN doc_id % 5 = 0 THEN '[\"' || source || '\", \"spare\"]' ELSE source END"
UPLOAD_MIME_SQL = """CASE lang WHEN 'en' THEN 'audio/mpeg' WHEN 'de' THEN 'audio/wav'
    WHEN 'fr' THEN 'video/mp4' ELSE 'audio/mp4' END"""
UPLOAD_LENGTH_SQL = "n_chars * 512"


def uploads(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    return docs.select(
        "doc_id",
        F.expr(UPLOAD_BUCKET_SQL).alias("bucket"),
        F.expr(UPLOAD_KEY_SQL).alias("key"),
        F.expr(UPLOAD_MIME_SQL).alias("mime"),
        F.expr(UPLOAD_LENGTH_SQL).cast("bigint").alias("length"),
    )


@query(
    "derive_job_keys",
    f"""WITH u AS (SELECT doc_id, {UPLOAD_BUCKET_SQL} AS b, {UPLOAD_KEY_SQL} AS key FROM documents)
SELECT doc_id, key,
       CASE WHEN starts_with(b, '[') THEN json_extract_string(b, '$[0]') ELSE b END AS bucket,
       'stt-' || regexp_replace(key, '\\.[^.]*$', '') AS job_name,
       regexp_extract(key, '([^.]*)$', 1) AS media_format,
       array_to_string(string_split(key, '.')[1:greatest(len(string_split(key, '.')) - 1, 0)], '.') AS client_stem,
       'stt-' || regexp_replace(key, '\\.[^.]*$', '') || '.json' AS output_key,
       replace('stt-' || regexp_replace(key, '\\.[^.]*$', '') || '.json', '.json', '_enhanced.json') AS enhanced_key
FROM u""",
)
def q_derive_job_keys(spark, sf_dir):
    out = derive_job_keys(uploads(spark, sf_dir))
    return out.select("doc_id", "key", "bucket", "job_name", "media_format", "client_stem", "output_key", "enhanced_key")


@query(
    "resolve_result_uri",
    """WITH p AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages)
SELECT page_id, url,
       string_split(path, '/')[2] AS result_bucket,
       CASE WHEN string_split(path, '/')[2] IS NULL THEN NULL
            ELSE replace(array_to_string(string_split(path, '/')[3:], '/'), '.json', '_enhanced.json') END AS result_key
FROM p""",
)
def q_resolve_result_uri(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return resolve_result_uri(pages, "url").select("page_id", "url", "result_bucket", "result_key")


@query(
    "validate_uploads",
    f"""WITH u AS (SELECT doc_id, {UPLOAD_MIME_SQL} AS mime, {UPLOAD_LENGTH_SQL} AS length FROM documents)
SELECT doc_id, mime, length,
       CASE WHEN NOT starts_with(mime, 'audio/') THEN 'bad_type'
            WHEN length > 10485760 THEN 'too_large' END AS reject_reason,
       starts_with(mime, 'audio/') AND length <= 10485760 AS accepted
FROM u""",
)
def q_validate_uploads(spark, sf_dir):
    out = validate_uploads(uploads(spark, sf_dir))
    return out.select("doc_id", "mime", "length", "reject_reason", "accepted")


NOTE_BUCKET = "concat('bkt-', CAST(user_id AS STRING))"
NOTE_KEY = "concat(event_type, '/', CAST(event_id AS STRING), '.mp3')"


@query(
    "explode_notifications",
    """SELECT event_id // 8 AS notif_id,
       (row_number() OVER (PARTITION BY event_id // 8 ORDER BY event_id) - 1)::BIGINT AS rec_no,
       'bkt-' || user_id AS bucket, event_type || '/' || event_id || '.mp3' AS key,
       NULL::VARCHAR AS reject_reason
FROM events""",
)
def q_explode_notifications(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    rec = F.struct(
        F.struct(
            F.struct(F.expr(NOTE_BUCKET).alias("name")).alias("bucket"),
            F.struct(F.expr(NOTE_KEY).alias("key")).alias("object"),
        ).alias("s3")
    )
    # a notification document holds at most eight records (consecutive event ids);
    # documents are written as JSON files and read back through the SRC-1 reader
    notes = ev.groupBy(F.floor(F.col("event_id") / 8).cast("bigint").alias("notif_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("event_id", rec.alias("r")))), lambda x: x["r"]).alias("Records")
    )
    path = scratch_path(spark, "notifications")
    notes.write.mode("overwrite").json(path)
    out = read_notifications(spark, path, id_field="notif_id")
    return out.select("notif_id", "rec_no", "bucket", "key", "reject_reason")


def speech_factory():
    """Deterministic stand-in for the speech service: the words of an object's name, then the language, as items.  Names that end
    in a dot get no answer, hidden ones an answer without results; objects of format mp3 name their job."""
    import json

    def model(requests: list[str]) -> list:
        out = []
        for r in map(json.loads, requests):
            name = r["uri"].rsplit("/", 1)[-1]
            words = [*name.split("_"), r["language"]]
            items = [{"start_time": str(i), "end_time": str(i + 1), "type": "pronunciation", "alternatives": [{"content": w}]} for i, w in enumerate(words)]
            job = {"jobName": f"raw-{name}"} if r["format"] == "mp3" else {}
            out.append(None if name.endswith(".") else json.dumps(job | ({} if name.startswith(".") else {"results": {"items": items}})))
        return out

    return model


@query(
    "transcribe_audio",
    f"""WITH u AS (SELECT doc_id, lang, {UPLOAD_KEY_SQL} AS key FROM documents)
SELECT doc_id,
       CASE WHEN key LIKE '%.mp3' THEN 'raw-' || key ELSE 'stt-' || regexp_replace(key, '\\.[^.]*$', '') END AS transcript_id,
       CASE WHEN doc_id % 6 = 4 THEN 'no_response' WHEN doc_id % 6 = 3 THEN 'invalid_transcript' END AS transcribe_error,
       CASE WHEN doc_id % 6 NOT IN (3, 4) THEN replace(key, '_', ' ') || ' ' || coalesce(nullif(lang, 'es'), 'en-US') END AS words
FROM u""",
)
def q_transcribe_audio(spark, sf_dir):
    """UDF-1 over every upload: requests with format, language and speaker settings, answers parsed as raw transcripts."""
    from parlance.operators.models import transcribe
    from parlance.operators.uploads import derive_job_keys

    lang = table(spark, sf_dir, "documents").select("doc_id", F.nullif(F.col("lang"), F.lit("es")).alias("language"))
    objects = derive_job_keys(uploads(spark, sf_dir).drop("bucket"), bucket=None).join(lang, "doc_id")
    audio = objects.withColumn("path", F.concat(F.lit("s3://in/"), "key")).withColumn("content", F.lit(None).cast("binary"))
    out = transcribe(audio, speech_factory)
    words = F.array_join(F.transform("raw.results.items", lambda i: F.get(i["alternatives"], 0)["content"]), " ")
    return out.select("doc_id", "transcript_id", "transcribe_error", words.alias("words"))
