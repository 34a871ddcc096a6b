"""Job state: AGG-7 latest status, JOIN-3 start planning (SCL-14), JOIN-2 +
PRJ-11/14/15 status report.

Job events are an append-only log ``(job_name, status, ts, event_id, uri)``;
the current state of a job is its latest event.  All aggregations here are
partial-aggregation friendly (``max_by``), so a job with a huge history does
not land on one task before the map-side combine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions.times import iso_datetime
from parlance.operators.ordered import with_prev
from parlance.schemas import JOB_FAILED_ERROR, JOB_PREFIX, MISSING_NAME_ERROR, NO_CONTENT_ERROR, NO_JOB_ERROR, NO_URI_ERROR, TERMINAL_STATES


# Fixed value: the shape of the unique suffix a restarted job gets (SCL-14).
UNIQUE_SUFFIX = r"-[0-9]{14}-[0-9a-f]{8}$"


def base_job_name(job) -> F.Column:
    """Job name without a unique restart suffix (``stt-x-20240101000000-1a2b3c4d`` -> ``stt-x``)."""
    return F.regexp_replace(F.col(job) if isinstance(job, str) else job, UNIQUE_SUFFIX, "")


def latest_job_status(events: DataFrame, *, job: str = "job_name", by_base: bool = False) -> DataFrame:
    """AGG-7: latest status per job; ties on ``ts`` broken by ``event_id``.

    ``by_base=True`` groups suffixed restarts under their base name and reports
    the latest of them (``job_name`` is then the base name, ``latest_job`` the
    job that reported), so a lookup by upload name finds restarted jobs too."""
    order = F.struct("ts", "event_id")
    if by_base:
        events = events.withColumn("latest_job", F.col(job)).withColumn(job, base_job_name(job))
        extra = [F.max_by("latest_job", order).alias("latest_job")]
    else:
        extra = []
    return events.groupBy(job).agg(
        *extra,
        F.max_by("status", order).alias("status"),
        F.max_by("uri", order).alias("uri"),
        F.max("ts").alias("last_ts"),
        F.count(F.lit(1)).cast("bigint").alias("n_events"),
    ).withColumn("last_ts_iso", iso_datetime("last_ts"))


def status_envelope(report: DataFrame) -> DataFrame:
    """D11: the ``{status, result, error}`` body as JSON text (nulls kept, as the
    service writes them) next to the HTTP code; ``result`` is the whole document."""
    body = F.to_json(
        F.struct(F.col("status"), F.col("result"), F.col("error")),
        {"ignoreNullFields": "false"},
    )
    return report.withColumn("body", body)


def unwrap_envelope(body) -> F.Column:
    """PRJ-14: the ``result`` member of a status body: the document as JSON text."""
    b = F.col(body) if isinstance(body, str) else body
    return F.get_json_object(b, "$.result")


def unique_suffix(key, ts, salt) -> F.Column:
    """SCL-14: ``yyyyMMddHHmmss-`` + 8 hex chars; derived from the row, not random,
    so a retried task produces the same name."""
    k = F.col(key) if isinstance(key, str) else key
    return F.concat(
        F.date_format(F.col(ts) if isinstance(ts, str) else ts, "yyyyMMddHHmmss"),
        F.lit("-"),
        F.substring(F.sha2(F.concat_ws("|", k, (F.col(salt) if isinstance(salt, str) else salt).cast("string")), 256), 1, 8),
    )


def start_action(prior: F.Column, job: str, salt: str) -> tuple[F.Column, F.Column]:
    """What to do about a submission whose job was last in state ``prior``, and the name to start under."""
    action = F.when(prior.isNull(), F.lit("start")).when(prior.isin(*TERMINAL_STATES), F.lit("delete_and_start")).otherwise(F.lit("start_unique"))
    unique = F.concat(F.col(job), F.lit("-"), unique_suffix(job, "ts", salt))
    return action, F.when(action == "start_unique", unique).otherwise(F.col(job))


def plan_job_starts(events: DataFrame, submissions, *, job: str = "job_name") -> DataFrame:
    """JOIN-3: for each submission, the state of the same-named job just before it
    decides the action: none -> ``start``; not terminal -> ``start_unique`` under a
    suffixed name; COMPLETED/FAILED -> ``delete_and_start`` under the base name.

    ``events`` holds every job event (submissions included); ``submissions`` is
    a boolean column marking the submission rows.  The prior state is the
    previous event of the job in ``(ts, event_id)`` order (skew-safe lag).
    """
    ev = events.withColumn("_is_sub", submissions)
    with_prior = with_prev(ev, job, ["ts", "event_id"], ["status"])
    subs = with_prior.where(F.col("_is_sub"))
    action, name = start_action(F.col("prev_status"), job, "event_id")
    return subs.select(
        "event_id", job, F.col("prev_status").alias("prior_status"), action.alias("action"), name.alias("start_name"),
        F.lit("QUEUED").alias("record_status"),
    )


def _left_join(left: DataFrame, right: DataFrame, on: str, *also: str) -> DataFrame:
    """Left join on ``on`` and ``also`` in which rows with a null ``on``, which match nothing, are spread over the
    partitions by their other values instead of meeting in one."""
    rest = [c for c in left.columns if c != on]
    spread = F.concat(F.lit("\u0000"), F.pmod(F.xxhash64(*rest), F.lit(1 << 20)).cast("string"))
    key = F.coalesce(F.col(on), spread)
    right = right.where(F.col(on).isNotNull()).withColumnRenamed(on, "_right").withColumnsRenamed({c: f"_right_{c}" for c in also})
    same = F.col("_left") == F.col("_right")
    for c in also:
        same = same & (F.col(c) == F.col(f"_right_{c}"))
    return left.withColumn("_left", key).join(right, same, "left").drop("_left", "_right", *(f"_right_{c}" for c in also))


def plan_uploads(uploads: DataFrame, latest: DataFrame, *, job: str = "job_name") -> DataFrame:
    """JOIN-3 on its real inputs: uploads (job, ts, upload_id, other columns) left-joined with the
    latest state of the same-named job (AGG-7 output).  Adds ``prior_status``, ``action``
    (start / start_unique / delete_and_start) and ``start_name``."""
    prior = latest.select(job, F.col("status").alias("prior_status"))
    joined = _left_join(uploads, prior, job)
    action, name = start_action(F.col("prior_status"), job, "upload_id")
    return joined.withColumn("action", action).withColumn("start_name", name)


def status_report(requests: DataFrame, latest: DataFrame, results: DataFrame, *, name: str = "file_name") -> DataFrame:
    """JOIN-2 + PRJ-11/14/15: HTTP-style status per request.

    ``requests``: request rows with a (nullable) file name.  ``latest``: AGG-7
    output keyed by ``job_name`` with ``result_bucket`` and ``result_key`` derived from the URI.
    ``results``: enhanced results keyed by ``result_bucket`` and ``result_key``, one row each, with ``transcript`` and, if
    there, ``segments, entities, s3``; ``result`` is the struct of those (D10).  A table of
    ``publish_lookup`` has ``place`` and is joined by it.
    """
    document = [c for c in ("transcript", "segments", "entities", "s3") if c in results.columns]
    req = requests.withColumn("job_name", F.concat(F.lit(JOB_PREFIX), F.col(name)))
    latest = latest.withColumn("uri", F.nullif(F.col("uri"), F.lit("")))  # an empty address is none
    asked = _left_join(req, latest, "job_name")
    if "place" in results.columns:  # a published table is bucketed by it: no shuffle of results
        asked = asked.withColumn("place", F.concat("result_bucket", F.lit("/"), "result_key"))
        joined = _left_join(asked, results.select("place", *document), "place")
    else:
        joined = _left_join(asked, results.select("result_key", "result_bucket", *document), "result_key", "result_bucket")
    has_result = F.col("transcript").isNotNull() & (F.length("transcript") > 0)
    st = F.col("status")
    http = (
        F.when(F.col(name).isNull(), 400)
        .when(st.isNull(), 404)
        .when((st == "COMPLETED") & F.col("uri").isNull(), 500)
        .when((st == "COMPLETED") & ~has_result, 500)
        .otherwise(200)
    )
    status = (
        F.when(F.col(name).isNull() | st.isNull(), "ERROR")
        .when((st == "COMPLETED") & F.col("uri").isNull(), "ERROR")
        .when((st == "COMPLETED") & ~has_result, "FAILED")
        .when(st == "COMPLETED", "COMPLETED")
        .when(st.isin("QUEUED", "IN_PROGRESS"), "IN_PROGRESS")
        .otherwise("FAILED")
    )
    error = (
        F.when(F.col(name).isNull(), F.lit(MISSING_NAME_ERROR))
        .when(st.isNull(), F.concat(F.lit(NO_JOB_ERROR), F.col("job_name")))
        .when((st == "COMPLETED") & F.col("uri").isNull(), F.lit(NO_URI_ERROR))
        .when((st == "COMPLETED") & ~has_result, F.lit(NO_CONTENT_ERROR))
        .when(st.isin("COMPLETED", "QUEUED", "IN_PROGRESS"), F.lit(None))
        .otherwise(F.concat(F.lit(JOB_FAILED_ERROR), st))
    )
    done = (status == "COMPLETED") & has_result
    return joined.select(
        *requests.columns,
        http.alias("http_code"), status.alias("status"), error.alias("error"),
        F.when(done, F.col("transcript")).alias("result_transcript"),
        F.when(done, F.struct(*document)).alias("result"),
        done.alias("has_result"),
    )
