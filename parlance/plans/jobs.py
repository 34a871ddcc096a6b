"""Queries: latest_job_status, plan_job_starts, status_report.

Stand-in job log: every ``events`` row is an event of job ``stt-u<user_id>``;
``signup`` = QUEUED (a submission), ``view``/``click`` = IN_PROGRESS,
``purchase`` = COMPLETED (with a result URI unless ``value < 5``), ``error`` =
FAILED.  Enhanced results exist for the transcripts of ``conversations``
(``stt-u<conv_id>_enhanced.json``).  Status requests are ``customer`` rows asking
for ``u<c_custkey>`` (no name when the account balance is negative).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.operators.jobs import latest_job_status, plan_job_starts, plan_uploads, status_envelope, status_report, unwrap_envelope
from parlance.operators.uploads import resolve_result_uri
from parlance.plans.registry import query
from parlance.schemas import JOB_FAILED_ERROR, MISSING_NAME_ERROR, NO_CONTENT_ERROR, NO_JOB_ERROR, NO_URI_ERROR
from parlance.session import scratch_path
from parlance.sinks.store import publish_lookup
from parlance.sources.tables import table

STATUS_SQL = """CASE event_type WHEN 'signup' THEN 'QUEUED' WHEN 'purchase' THEN 'COMPLETED'
    WHEN 'error' THEN 'FAILED' ELSE 'IN_PROGRESS' END"""
URI_SQL = """CASE WHEN event_type = 'purchase' AND value >= 5
    THEN 'https://store.example.com/results/stt-u' || user_id || '.json' END"""
JOB_EVENTS_SQL = f"""job_events AS (
  SELECT event_id, 'stt-u' || user_id AS job_name, {STATUS_SQL} AS status, ts, {URI_SQL} AS uri,
         event_type = 'signup' AS is_submission
  FROM events)"""


def job_events(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "ts")
    return ev.select(
        "event_id",
        F.concat(F.lit("stt-u"), F.col("user_id").cast("string")).alias("job_name"),
        F.expr(STATUS_SQL).alias("status"),
        "ts",
        F.expr(URI_SQL).alias("uri"),
        (F.col("event_type") == "signup").alias("is_submission"),
    )


@query(
    "latest_job_status",
    f"""WITH {JOB_EVENTS_SQL}
SELECT job_name, arg_max_null(status, (ts, event_id)) AS status, arg_max_null(uri, (ts, event_id)) AS uri,
       max(ts) AS last_ts, count(*)::BIGINT AS n_events,
       strftime(max(ts), '%Y-%m-%dT%H:%M:%S')
         || CASE WHEN epoch_us(max(ts)) % 1000000 = 0 THEN ''
                 ELSE '.' || lpad(CAST(epoch_us(max(ts)) % 1000000 AS VARCHAR), 6, '0') END AS last_ts_iso
FROM job_events GROUP BY job_name""",
)
def q_latest_job_status(spark, sf_dir):
    return latest_job_status(job_events(spark, sf_dir)).select(
        "job_name", "status", "uri", "last_ts", "n_events", "last_ts_iso"
    )


JOB_STARTS_SQL = f"""WITH {JOB_EVENTS_SQL},
p AS (SELECT *, lag(status) OVER (PARTITION BY job_name ORDER BY ts, event_id) AS prior_status FROM job_events)
SELECT event_id, job_name, prior_status,
       CASE WHEN prior_status IS NULL THEN 'start'
            WHEN prior_status IN ('COMPLETED', 'FAILED') THEN 'delete_and_start' ELSE 'start_unique' END AS action,
       CASE WHEN prior_status IS NULL OR prior_status IN ('COMPLETED', 'FAILED') THEN job_name
            ELSE job_name || '-' || strftime(ts, '%Y%m%d%H%M%S') || '-' || left(sha256(job_name || '|' || event_id), 8) END
         AS start_name,
       'QUEUED' AS record_status
FROM p WHERE is_submission"""


@query("plan_job_starts", JOB_STARTS_SQL)
def q_plan_job_starts(spark, sf_dir):
    ev = job_events(spark, sf_dir)
    return plan_job_starts(ev, F.col("is_submission")).select(
        "event_id", "job_name", "prior_status", "action", "start_name", "record_status"
    )


@query(
    "plan_uploads",
    f"""WITH {JOB_EVENTS_SQL},
latest AS (SELECT job_name, arg_max_null(status, (ts, event_id)) AS prior_status FROM job_events GROUP BY job_name),
u AS (SELECT c_custkey AS upload_id, CASE WHEN c_acctbal >= 0 THEN 'stt-u' || c_custkey END AS job_name,
             TIMESTAMP '2024-06-01 12:00:00' AS ts FROM customer)
SELECT upload_id, u.job_name, prior_status,
       CASE WHEN prior_status IS NULL THEN 'start'
            WHEN prior_status IN ('COMPLETED', 'FAILED') THEN 'delete_and_start' ELSE 'start_unique' END AS action,
       CASE WHEN prior_status IS NULL OR prior_status IN ('COMPLETED', 'FAILED') THEN u.job_name
            ELSE u.job_name || '-' || strftime(ts, '%Y%m%d%H%M%S') || '-' || left(sha256(u.job_name || '|' || upload_id), 8) END
         AS start_name
FROM u LEFT JOIN latest USING (job_name)""",
)
def q_plan_uploads(spark, sf_dir):
    """Uploads (customers; without a name when the balance is negative) against the latest job states."""
    uploads = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("upload_id"),
        F.when(F.col("c_acctbal") >= 0, F.concat(F.lit("stt-u"), F.col("c_custkey").cast("string"))).alias("job_name"),
        F.expr("TIMESTAMP_NTZ '2024-06-01 12:00:00'").alias("ts"),
    )
    return plan_uploads(uploads, latest_job_status(job_events(spark, sf_dir))).select("upload_id", "job_name", "prior_status", "action", "start_name")


STATUS_REPORT_SQL = f"""WITH {JOB_EVENTS_SQL},
latest AS (SELECT regexp_replace(job_name, '-[0-9]{14}-[0-9a-f]{8}$', '') AS job_name,
                  arg_max_null(status, (ts, event_id)) AS status, arg_max_null(uri, (ts, event_id)) AS uri
           FROM job_events GROUP BY 1),
lk AS (SELECT *, regexp_extract(uri, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM latest),
lk2 AS (SELECT job_name, status, uri,
               CASE WHEN string_split(path, '/')[2] IS NULL THEN NULL
                    ELSE replace(array_to_string(string_split(path, '/')[3:], '/'), '.json', '_enhanced.json') END
                 AS result_key
        FROM lk),
res AS (SELECT 'stt-u' || conv_id || '_enhanced.json' AS result_key,
               string_agg(text, ' ' ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id),
req AS (SELECT c_custkey AS request_id, CASE WHEN c_acctbal < 0 THEN NULL ELSE 'u' || c_custkey END AS file_name
        FROM customer),
j AS (SELECT req.*, 'stt-' || req.file_name AS job_name, lk2.status AS st, lk2.uri, res.transcript,
             coalesce(res.transcript <> '', false) AS has
      FROM req LEFT JOIN lk2 ON lk2.job_name = 'stt-' || req.file_name LEFT JOIN res ON res.result_key = lk2.result_key)
SELECT request_id, file_name,
       CASE WHEN file_name IS NULL THEN 400 WHEN st IS NULL THEN 404
            WHEN st = 'COMPLETED' AND (uri IS NULL OR NOT has) THEN 500 ELSE 200 END AS http_code,
       CASE WHEN file_name IS NULL OR st IS NULL THEN 'ERROR'
            WHEN st = 'COMPLETED' AND uri IS NULL THEN 'ERROR'
            WHEN st = 'COMPLETED' AND NOT has THEN 'FAILED'
            WHEN st = 'COMPLETED' THEN 'COMPLETED'
            WHEN st IN ('QUEUED', 'IN_PROGRESS') THEN 'IN_PROGRESS' ELSE 'FAILED' END AS status,
       CASE WHEN file_name IS NULL THEN '{MISSING_NAME_ERROR}'
            WHEN st IS NULL THEN '{NO_JOB_ERROR}' || job_name
            WHEN st = 'COMPLETED' AND uri IS NULL THEN '{NO_URI_ERROR}'
            WHEN st = 'COMPLETED' AND NOT has THEN '{NO_CONTENT_ERROR}'
            WHEN st IN ('COMPLETED', 'QUEUED', 'IN_PROGRESS') THEN NULL
            ELSE '{JOB_FAILED_ERROR}' || st END AS error,
       CASE WHEN st = 'COMPLETED' AND uri IS NOT NULL AND has THEN transcript END AS result_transcript,
       coalesce(st = 'COMPLETED' AND uri IS NOT NULL AND has, false) AS has_result
FROM j"""


def _status_report(spark, sf_dir, publish=None):
    # looked up by base name, so restarted (suffixed) jobs are found as well
    latest = latest_job_status(job_events(spark, sf_dir), by_base=True)
    latest = resolve_result_uri(latest, "uri").select("job_name", "status", "uri", "result_bucket", "result_key")
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    results = conv.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias(
            "transcript"
        )
    ).select(F.concat(F.lit("stt-u"), F.col("conv_id").cast("string"), F.lit("_enhanced.json")).alias("result_key"), F.lit("results").alias("result_bucket"), "transcript")
    req = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("request_id"),
        F.when(F.col("c_acctbal") < 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("u"), F.col("c_custkey").cast("string"))).alias("file_name"),
    )
    return status_report(req, latest, publish(results) if publish else results)


@query("status_lookup", STATUS_REPORT_SQL)
def q_status_lookup(spark, sf_dir):
    """JOIN-2 against a published results table: bucketed and sorted by place, so results are not shuffled."""
    path = scratch_path(spark, "lookup")
    name = f"lookup_{path[-12:]}"

    def publish(results):
        publish_lookup(results, name, path)
        return spark.table(name)

    return _status_report(spark, sf_dir, publish).select("request_id", "file_name", "http_code", "status", "error", "result_transcript", "has_result")


@query("status_report", STATUS_REPORT_SQL)
def q_status_report(spark, sf_dir):
    return _status_report(spark, sf_dir).select("request_id", "file_name", "http_code", "status", "error", "result_transcript", "has_result")


@query(
    "status_envelope",
    """WITH r AS (""" + STATUS_REPORT_SQL + """)
SELECT request_id, http_code,
       json_object('status', status, 'result', CASE WHEN has_result THEN json_object('transcript', result_transcript) END, 'error', error)::VARCHAR AS body,
       CASE WHEN has_result THEN json_object('transcript', result_transcript)::VARCHAR END AS unwrapped
FROM r""",
)
def q_status_envelope(spark, sf_dir):
    """D11 body text per request and PRJ-14: the client unwraps ``result`` again."""
    env = status_envelope(_status_report(spark, sf_dir))
    return env.select("request_id", "http_code", "body", unwrap_envelope("body").alias("unwrapped"))
