"""Queries: stream_uploads, stream_dedup, stream_latest_status, stream_job_timeout,
stream_result_join, stream_job_starts.

Each reads ``events.parquet`` as a file stream (``pathGlobFilter``), runs with
``trigger(availableNow=True)`` into a table in the shared checkpoint folder and
returns that table.  One file is one micro-batch, so the append-mode outputs
equal their batch counterparts (the oracles); multi-batch behaviour is covered by
tests with several files.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions.times import instant_to_ntz, ntz_to_instant
from parlance.plans.jobs import JOB_EVENTS_SQL, JOB_STARTS_SQL, STATUS_SQL
from parlance.plans.registry import query
from parlance.sources.tables import table
from parlance.streaming.flows import (
    dedup_stream,
    job_timeout_stream,
    latest_status_stream,
    result_join_stream,
    run_to_table,
    upload_stream,
)
from parlance.streaming.starts import job_start_stream, keyed_state


def _cores(spark) -> int:
    """State partitions for the registered streams: one per core of the cluster."""
    return spark.sparkContext.defaultParallelism


def event_stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(sf_dir)
        .withColumn("ts", ntz_to_instant("ts"))
    )


def job_event_stream(spark, sf_dir):
    ev = event_stream(spark, sf_dir)
    return ev.select(
        "event_id",
        F.concat(F.lit("stt-u"), F.col("user_id").cast("string")).alias("job_name"),
        F.expr(STATUS_SQL).alias("status"),
        "ts",
    )


UPLOAD_SQL = """SELECT event_id, 'bkt-' || user_id AS bucket, event_type || '/' || event_id || '.mp3' AS key,
       CASE WHEN event_type = 'error' THEN 'video/mp4' ELSE 'audio/mpeg' END AS mime,
       floor(value * 40000)::BIGINT AS length FROM events"""


@query(
    "stream_uploads",
    f"""WITH u AS ({UPLOAD_SQL})
SELECT event_id, 'stt-' || regexp_replace(key, '\\.[^.]*$', '') AS job_name, regexp_extract(key, '([^.]*)$', 1) AS media_format,
       starts_with(mime, 'audio/') AND length <= 10485760 AS accepted,
       CASE WHEN NOT starts_with(mime, 'audio/') THEN 'bad_type' WHEN length > 10485760 THEN 'too_large' END AS reject_reason
FROM u""",
)
def q_stream_uploads(spark, sf_dir):
    ev = event_stream(spark, sf_dir)
    up = ev.select(
        "event_id",
        F.concat(F.lit("bkt-"), F.col("user_id").cast("string")).alias("bucket"),
        F.concat("event_type", F.lit("/"), F.col("event_id").cast("string"), F.lit(".mp3")).alias("key"),
        F.when(F.col("event_type") == "error", "video/mp4").otherwise("audio/mpeg").alias("mime"),
        F.floor(F.col("value") * 40000).cast("bigint").alias("length"),
    )
    out = run_to_table(upload_stream(up).select("event_id", "job_name", "media_format", "accepted", "reject_reason"),
                       spark, "stream_uploads")
    return out


@query("stream_dedup", f"WITH {JOB_EVENTS_SQL} SELECT DISTINCT job_name, status FROM job_events")
def q_stream_dedup(spark, sf_dir):
    dedup = dedup_stream(job_event_stream(spark, sf_dir), ["job_name", "status"])
    return run_to_table(dedup.select("job_name", "status"), spark, "stream_dedup", state_partitions=_cores(spark))


@query(
    "stream_latest_status",
    f"""WITH {JOB_EVENTS_SQL}
SELECT job_name, arg_max_null(status, (ts, event_id)) AS status, max(ts)::TIMESTAMP AS last_ts, count(*)::BIGINT AS n_events
FROM job_events GROUP BY job_name""",
)
def q_stream_latest_status(spark, sf_dir):
    latest = latest_status_stream(job_event_stream(spark, sf_dir))
    out = run_to_table(latest, spark, "stream_latest_status", mode="update", key=["job_name"], state_partitions=_cores(spark))
    return out.withColumn("last_ts", instant_to_ntz("last_ts"))


@query(
    "stream_job_timeout",
    f"""WITH {JOB_EVENTS_SQL},
f AS (SELECT job_name, min(ts) AS first,
             min(ts) FILTER (WHERE status IN ('COMPLETED', 'FAILED')) AS t_term,
             arg_min(status, ts) FILTER (WHERE status IN ('COMPLETED', 'FAILED')) AS s_term
      FROM job_events GROUP BY job_name),
wm AS (SELECT max(ts) - INTERVAL 1 HOUR AS w FROM job_events)
SELECT job_name,
       CASE WHEN t_term <= first + INTERVAL 2 DAY THEN s_term ELSE 'TIMED_OUT' END AS outcome,
       CASE WHEN t_term <= first + INTERVAL 2 DAY THEN t_term ELSE first + INTERVAL 2 DAY END AS decided_at
FROM f WHERE t_term IS NOT NULL OR first + INTERVAL 2 DAY < (SELECT w FROM wm)""",
)
def q_stream_job_timeout(spark, sf_dir):
    """One file is one micro-batch: every job is decided from its events at once,
    and silent jobs time out in the following no-data batch when the watermark
    (latest event time minus 1 h) has passed their deadline."""
    timed = job_timeout_stream(job_event_stream(spark, sf_dir), limit_s=2 * 86400)
    out = run_to_table(timed, spark, "stream_job_timeout", state_partitions=_cores(spark))
    return out.withColumn("decided_at", instant_to_ntz("decided_at"))


@query(
    "stream_result_join",
    """WITH v AS (SELECT * FROM events WHERE event_type = 'view'),
p AS (SELECT * FROM events WHERE event_type = 'purchase'),
m AS (SELECT v.event_id AS view_id, p.event_id AS purchase_id, v.user_id
      FROM v JOIN p ON p.user_id = v.user_id AND p.ts >= v.ts AND p.ts <= v.ts + INTERVAL 2 HOUR),
wm AS (SELECT least((SELECT max(ts) FROM v), (SELECT max(ts) FROM p)) - INTERVAL 1 HOUR AS w)
SELECT * FROM m
UNION ALL
SELECT v.event_id, NULL, v.user_id FROM v
WHERE v.event_id NOT IN (SELECT view_id FROM m) AND v.ts + INTERVAL 2 HOUR < (SELECT w FROM wm)""",
)
def q_stream_result_join(spark, sf_dir):
    """Every row the stream emits: matched (completion, result) pairs, and
    completions without a result once the watermark (the smaller of the two
    streams' event-time maxima minus the 1 h delay) has passed their 2 h bound.
    Completions whose bound is still open stay in the join state."""
    ev = event_stream(spark, sf_dir)
    views = ev.where(F.col("event_type") == "view").select(
        F.col("event_id").alias("view_id"), "user_id", F.col("ts").alias("c_ts")
    )
    buys = ev.where(F.col("event_type") == "purchase").select(
        F.col("event_id").alias("purchase_id"), F.col("user_id").alias("user_id_r"), F.col("ts").alias("r_ts")
    )
    joined = result_join_stream(views, buys, key="user_id", within="2 hours", delay="1 hour")
    return run_to_table(joined.select("view_id", "purchase_id", "user_id"), spark, "stream_result_join",
                        state_partitions=_cores(spark))


@query("stream_job_starts", JOB_STARTS_SQL)
def q_stream_job_starts(spark, sf_dir):
    """JOIN-3 on the live log: every submission is decided as its event arrives, from the state of its job."""
    ev = job_event_stream(spark, sf_dir)
    with keyed_state(spark):
        return run_to_table(job_start_stream(ev, F.col("status") == "QUEUED"), spark, "stream_job_starts", state_partitions=_cores(spark))
