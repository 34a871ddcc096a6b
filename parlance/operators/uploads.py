"""Upload-side jobs: SRC-1 notification explode, PRJ-1 upload validation,
PRJ-2/3/4/17 key derivation, PRJ-5 result URI resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions.keys import (
    client_stem,
    enhanced_key,
    first_bucket,
    job_name,
    media_format,
    output_key,
    uri_bucket_key,
)
from parlance.schemas import AUDIO_MIME_PREFIX, MAX_UPLOAD_BYTES, NOTIFICATION_DDL


def explode_notifications(
    notes: DataFrame, records_col: str = "Records", id_col: str | None = None, url_decode: bool = False
) -> DataFrame:
    """One ``(bucket, key)`` row per record, in record order (``rec_no``).

    Keys are taken verbatim by default, as the service does (object-created
    notifications carry URL-encoded keys); ``url_decode=True`` decodes them
    (``+`` and ``%xx``; a malformed escape leaves the key as it is).  A record
    without bucket name or key is kept with ``reject_reason = 'missing_field'``
    instead of failing the job.
    """
    keep = [id_col] if id_col else []
    rows = notes.select(*keep, F.posexplode(records_col).alias("rec_no", "r"))
    return rows.select(
        *keep,
        F.col("rec_no").cast("bigint").alias("rec_no"),
        F.col("r.s3.bucket.name").alias("bucket"),
        (F.coalesce(F.try_url_decode(F.col("r.s3.object.key")), F.col("r.s3.object.key")) if url_decode
         else F.col("r.s3.object.key")).alias("key"),
    ).withColumn(
        "reject_reason",
        F.when(F.col("bucket").isNull() | F.col("key").isNull(), F.lit("missing_field")),
    )


def parse_notifications(text_df: DataFrame, text_col: str = "body", id_col: str | None = None) -> DataFrame:
    """Parse notification JSON text with the fixed D1 schema, then explode."""
    parsed = text_df.select(*([id_col] if id_col else []), F.from_json(text_col, NOTIFICATION_DDL).alias("n"))
    return explode_notifications(parsed.select(*([id_col] if id_col else []), "n.Records"), "Records", id_col)


def validate_uploads(uploads: DataFrame, mime: str = "mime", length: str = "length") -> DataFrame:
    """PRJ-1 (SCL-12 ``startswith``): accept iff the MIME type starts with ``audio/`` and the size is at
    most 10 MiB (inclusive).  One pass; ``accepted`` and ``reject_reason`` tag the rows
    so accepted/rejected outputs are two filters of the same plan."""
    reason = (
        F.when(~F.coalesce(F.startswith(F.col(mime), F.lit(AUDIO_MIME_PREFIX)), F.lit(False)), F.lit("bad_type"))
        .when(~F.coalesce(F.col(length) <= F.lit(MAX_UPLOAD_BYTES), F.lit(False)), F.lit("too_large"))
    )
    return uploads.withColumn("reject_reason", reason).withColumn("accepted", F.col("reject_reason").isNull())


def derive_job_keys(uploads: DataFrame, key: str = "key", bucket: str | None = "bucket") -> DataFrame:
    """PRJ-2/3/4/17: job name, media format, client stem, output and enhanced keys."""
    out = uploads.withColumn("job_name", job_name(key)).withColumn("media_format", media_format(key))
    out = out.withColumn("client_stem", client_stem(key)).withColumn("output_key", output_key("job_name"))
    out = out.withColumn("enhanced_key", enhanced_key("output_key"))
    if bucket and bucket in uploads.columns:
        out = out.withColumn("bucket", first_bucket(bucket))
    return out


def resolve_result_uri(df: DataFrame, uri: str = "uri") -> DataFrame:
    """PRJ-5 + PRJ-4: bucket and enhanced-result key of a transcript URI."""
    bucket, rest = uri_bucket_key(uri)
    return df.withColumn("result_bucket", bucket).withColumn("result_key", enhanced_key(rest))
