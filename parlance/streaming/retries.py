"""STR-5 with a bound: completions whose result does not come are asked for again, and fail after so many attempts.

Every micro-batch brings completions and is one attempt for all that are still pending: their results are
looked up by bucket and key.  Found ones are answered COMPLETED, those at the last attempt FAILED, the others stay in the
pending table with their number of attempts.  Both tables are written per batch, under the batch's number, so a batch that is
repeated after a failure reads the same pending table as before and replaces what it wrote; an answer is given exactly once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parlance.schemas import NO_CONTENT_ERROR
from parlance.session import scratch_path

#: Fixed value: attempts to fetch a result.
ATTEMPTS = 10
_PENDING = "job_name string, result_bucket string, result_key string, attempts int"
_ANSWER = "job_name string, result_bucket string, result_key string, attempts int, status string, error string"


def one_attempt(pending: DataFrame, results: DataFrame, attempts: int = ATTEMPTS) -> DataFrame:
    """``pending`` (job_name, result_bucket, result_key, attempts so far) after one more lookup in ``results``
    (result_bucket, result_key): attempts, ``status`` (COMPLETED, FAILED, or null: still pending) and ``error``."""
    place = ["result_bucket", "result_key"]
    there = results.select(*place).where("result_bucket is not null and result_key is not null").distinct().withColumn("_there", F.lit(True))
    tried = pending.withColumn("attempts", F.col("attempts") + 1).join(there, place, "left")
    found = F.coalesce("_there", F.lit(False))
    status = F.when(found, F.lit("COMPLETED")).when(F.col("attempts") >= attempts, F.lit("FAILED"))
    return tried.select("job_name", *place, "attempts", status.alias("status"), F.when(~found & (F.col("attempts") >= attempts), F.lit(NO_CONTENT_ERROR)).alias("error"))


class RetryTables:
    """``answers`` and ``pending``, below one folder in the shared checkpoint folder or wherever ``path`` says."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or scratch_path(spark, "retries")

    def _read(self, name: str, ddl: str) -> DataFrame:
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], ddl)
        return self.spark.read.schema(ddl).parquet(folder.toString())

    def answers(self) -> DataFrame:
        return self._read("answers", _ANSWER + ", batch bigint")

    def pending(self, batch: int) -> DataFrame:
        """What batch ``batch`` left pending."""
        return self._read(f"pending/batch={batch}", _PENDING)

    def attempt(self, completions: DataFrame, batch: int, results: DataFrame, attempts: int) -> None:
        """One micro-batch: new completions and the pending ones of the batch before; a job of both counts once, as pending."""
        place = ["job_name", "result_bucket", "result_key"]
        new = completions.select(*place, F.lit(0).alias("attempts"))
        due = self.pending(batch - 1).unionByName(new).groupBy(*place).agg(F.max("attempts").alias("attempts"))
        answered = self.answers().where(F.col("batch") < batch).select(*place)
        same = [F.col(f"d.{c}").eqNullSafe(F.col(f"a.{c}")) for c in place]
        due = due.alias("d").join(answered.alias("a"), same, "left_anti")  # a completion told twice is answered once
        tried = one_attempt(due, results, attempts).checkpoint(eager=True)
        tried.where("status is null").select(*place, "attempts").write.mode("overwrite").parquet(f"{self.path}/pending/batch={batch}")
        tried.where("status is not null").write.mode("overwrite").parquet(f"{self.path}/answers/batch={batch}")


def retry_results(completions: DataFrame, results: Callable[[], DataFrame], tables: RetryTables, *, attempts: int = ATTEMPTS, **trigger) -> StreamingQuery:
    """Run the stream ``completions`` (job_name, result_bucket, result_key) into ``tables``.  ``results`` is
    called in every batch and gives the results there are then.  Goes on from its checkpoint when started again.

    A batch runs when completions come.  Keep a heartbeat in the stream (rows without a job) if pending
    ones shall be asked for while none do: such rows start an attempt and nothing else."""

    def step(batch: DataFrame, number: int) -> None:
        tables.attempt(batch.where("job_name is not null"), number, results(), attempts)

    return completions.writeStream.foreachBatch(step).option("checkpointLocation", f"{tables.path}/_checkpoint").trigger(**(trigger or {"availableNow": True})).start()
