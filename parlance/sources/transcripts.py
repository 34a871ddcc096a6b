"""Readers: SRC-1 notifications, SRC-2 audio listing, SRC-3 raw transcripts,
SRC-4/SRC-6 enhanced transcripts, SRC-5 job events.

Schemas are always explicit (never inferred) so only the fields that are used
are parsed, and column pruning reaches the files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.operators.uploads import explode_notifications
from parlance.schemas import ENHANCED_DDL, JOB_EVENT_DDL, NOTIFICATION_DDL, RAW_TRANSCRIPT_DDL
from parlance.sinks.results import read_results, result_place

# MIME types by file extension for audio listings.
AUDIO_MIME = {"mp3": "audio/mpeg", "m4a": "audio/mp4", "mp4": "video/mp4", "wav": "audio/wav", "flac": "audio/flac",
              "ogg": "audio/ogg", "webm": "audio/webm", "amr": "audio/amr"}


def _stem(path_col):
    name = F.regexp_extract(path_col, r"([^/]*)$", 1)
    return F.regexp_replace(name, r"\.json$", "")


def read_notifications(
    spark: SparkSession, path: str, id_field: str | None = None, url_decode: bool = False
) -> DataFrame:
    """SRC-1: JSON notifications -> one (bucket, key) row per record, in record
    order.  ``id_field`` names an extra top-level bigint identifying the
    notification; otherwise the source file identifies it."""
    ddl = NOTIFICATION_DDL + (f", {id_field} bigint" if id_field else "")
    notes = spark.read.schema(ddl).json(path)
    if not id_field:
        notes = notes.withColumn("source_file", F.input_file_name())
    return explode_notifications(notes, "Records", id_field or "source_file", url_decode=url_decode)


def audio_mime(path: str) -> F.Column:
    """MIME type by the extension of a path."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))
    known = F.create_map(*[F.lit(x) for kv in AUDIO_MIME.items() for x in kv])
    return F.coalesce(F.try_element_at(known, ext), F.lit("application/octet-stream"))


def list_audio(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """SRC-2: object listing (path, size, modification time, MIME from extension).

    Only metadata columns are selected, so ``binaryFile`` never reads file contents."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", "length", "modificationTime").withColumn("mime", audio_mime("path"))


def read_raw_transcripts(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """SRC-3: raw transcripts (one JSON object per file by default; JSON lines with
    ``multi_line=False``).  ``transcript_id`` = the service's job name, else the
    file name without ``.json``."""
    raw = spark.read.schema(RAW_TRANSCRIPT_DDL).option("multiLine", multi_line).json(path)
    return raw.withColumn("transcript_id", F.coalesce(F.col("jobName"), _stem(F.input_file_name())))


def read_enhanced(spark: SparkSession, path: str, fmt: str = "parquet", multi_line: bool = True,
                  glob: str | None = "*_enhanced.json") -> DataFrame:
    """SRC-4 / SRC-6: enhanced transcripts from the result table (Parquet), from
    ``*_enhanced.json`` objects (one per file, ``multi_line=True``) or from JSON-lines
    exports (``multi_line=False, glob=None``).
    Every form has ``result_bucket`` and ``result_key``, as JOIN-2 derives them from the job's output address."""
    if fmt == "parquet":
        return read_results(spark, path)
    reader = spark.read.schema(ENHANCED_DDL).option("multiLine", multi_line)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    docs = reader.json(path).withColumn("source_file", F.input_file_name())
    return result_place(docs)


def read_job_events(spark: SparkSession, path: str) -> DataFrame:
    """SRC-5: the append-only job event log."""
    return spark.read.schema(JOB_EVENT_DDL).parquet(path)
