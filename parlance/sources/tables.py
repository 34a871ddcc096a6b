"""Driver tables and the stand-in mappings used by the registered queries.

The driver data is TPC-H-like; each function below says which transcript-world
shape a driver table plays.  Readers always select the columns they need so the
Parquet scan prunes the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-repartition on ``keys`` before CPU-heavy work: asked for by queries over the driver
    tables, which are files of one row group each and would otherwise be one task.  It is
    always done, so the plan does not depend on the size; hashing on a key (not
    round-robin) keeps retried tasks deterministic.  Leave it out for tables of many row groups."""
    return df.repartition(*keys)


def conversation_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as speaker segments: conv_id = transcript, turn = ordinal, role = speaker."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("transcript_id"),
        F.col("turn").alias("seg_no"),
        F.col("turn").cast("string").alias("timestamp"),
        F.col("role").alias("speaker"),
        F.col("text"),
    )


def events_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` with ``ts`` as TIMESTAMP (streaming watermarks reject TIMESTAMP_NTZ),
    the wall clock read as UTC whatever the session time zone."""
    from parlance.functions.times import ntz_to_instant

    return table(spark, sf_dir, "events").withColumn("ts", ntz_to_instant("ts"))
