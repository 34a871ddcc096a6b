"""STR-1 landing folder: uploaded audio objects as a stream of job requests.  SNK-3's uploads land here."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.operators.uploads import derive_job_keys, validate_uploads
from parlance.sources.transcripts import audio_mime

_FILE = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()),
    T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType()),
])


def landing_stream(
    spark: SparkSession, folder: str, *, bucket: str | None = None, glob: str | None = None, max_files_per_trigger: int = 1000,
    clean: str | None = None, archive: str | None = None, recursive: bool = True,
) -> DataFrame:
    """Every object of ``folder`` once, as it appears: path, modificationTime, length, mime, bucket and key, checked
    (PRJ-1) and with its job's names (PRJ-2..4).

    The ``binaryFile`` source lists objects; only the metadata columns are selected, so no content is read.  Objects of no bytes do not come: Spark's file sources skip them.  The key
    is the object's path below the folder; the bucket is ``bucket`` or the folder's own (the host of ``s3a://bucket/..``,
    else null).  ``max_files_per_trigger`` bounds a micro-batch.  ``clean="archive"`` moves processed objects to
    ``archive`` (a folder outside this one), ``"delete"`` deletes them; by default they stay, and the checkpoint alone
    remembers them."""
    reader = spark.readStream.format("binaryFile").schema(_FILE).option("maxFilesPerTrigger", max_files_per_trigger).option("recursiveFileLookup", recursive)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if clean == "archive":
        if not archive:
            raise ValueError("archive needs a folder")
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    elif clean:
        reader = reader.option("cleanSource", clean)
    files = reader.load(folder).select("path", "modificationTime", "length")
    root = F.regexp_replace(F.lit(folder.rstrip("/")), "^[a-z0-9]+:/*", "/")
    plain = F.regexp_replace("path", "^[a-z0-9]+:/*", "/")
    key = F.when(F.startswith(plain, F.concat(root, F.lit("/"))), F.substr(plain, F.length(root) + 2)).otherwise(F.regexp_extract(plain, "([^/]*)$", 1))
    host = F.nullif(F.regexp_extract("path", "^[a-z0-9]+://([^/]+)/", 1), F.lit(""))
    named = files.withColumn("mime", audio_mime("path")).withColumn("bucket", F.lit(bucket) if bucket else host).withColumn("key", key)
    return derive_job_keys(validate_uploads(named))
