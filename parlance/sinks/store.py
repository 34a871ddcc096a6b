"""Stored results at scale: keyed compaction with an atomic switch, and a bucketed table for point lookups.

``ResultStore`` is a folder of generations.  Batches go to the newest one (SNK-1).  ``compact`` opens a new
generation for writers, folds the base and the closed generations into a new base (one row per place, in files
of one key range each, sorted), and switches readers to it.  Which base and generations count is said by the
newest of numbered state files; a state file is written aside and renamed to a number that must not exist, so
readers see the old state or the new one, and of two compactions at once the later one fails.  A compaction that
breaks off before its switch leaves a base that nobody reads.  ``vacuum`` deletes what no state needs.

Later writes win: a row of a later generation over one of an earlier generation or the base; within a generation the batch
that sorts last (``read_results``).  Compaction settles what it folds: a named batch that is written again after it
is a new write, and does not take back rows of its first writing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.sinks.results import read_results, write_results


def place_of(bucket, key) -> F.Column:
    """One text for bucket and key (a bucket's name holds no slash)."""
    return F.concat(bucket, F.lit("/"), key)


class ResultStore:
    """Results below ``path``, see above."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(self._conf)
        self._jvm = jvm

    def _states(self) -> list[int]:
        folder = self._path(f"{self.path}/state")
        if not self._fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName()[:-5]) for s in self._fs.listStatus(folder) if s.getPath().getName().endswith(".json"))

    def state(self) -> dict:
        """``version``, the ``base`` (a folder name or None) and the ``generations`` that count beside it, oldest first."""
        states = self._states()
        if not states:
            return {"version": 0, "base": None, "generations": [0]}
        text = self.spark.read.text(f"{self.path}/state/{states[-1]:08d}.json", wholetext=True).first()[0]
        return json.loads(text)

    def _switch(self, state: dict) -> None:
        """Make ``state`` the newest; fails if another one of its number is there."""
        aside, final = (self._path(f"{self.path}/state/{name}") for name in (f"_{uuid.uuid4().hex}", f"{state['version']:08d}.json"))
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        context.rename(aside, final, self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0))

    def write(self, df: DataFrame, partition_col: str = "ingest_date", batch: str | None = None) -> str:
        """SNK-1 into the newest generation."""
        return write_results(df, f"{self.path}/generation={self.state()['generations'][-1]}", partition_col, batch)

    def read(self) -> DataFrame:
        """One row per place (``result_bucket``, ``result_key``): the one written last."""
        return self._read(self.state())

    def _read(self, state: dict) -> DataFrame:
        parts = []
        if state["base"]:
            parts.append(self.spark.read.parquet(f"{self.path}/{state['base']}").withColumn("_age", F.lit(-1)))
        for g in state["generations"]:
            if self._fs.exists(self._path(f"{self.path}/generation={g}")):
                parts.append(read_results(self.spark, f"{self.path}/generation={g}").withColumn("_age", F.lit(g)))
        if not parts:
            raise ValueError(f"nothing was written to {self.path}")
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p, allowMissingColumns=True)
        if len(parts) == 1:
            return rows.drop("_age")
        place = ["result_bucket", "result_key"]
        newest = rows.groupBy(*place).agg(F.max("_age").alias("_age"))  # places only
        return rows.join(newest, [*place, "_age"]).drop("_age")

    def compact(self, ranges: int | None = None) -> int:
        """Fold all that is written into a new base of ``ranges`` key ranges (default: as many as the size asks for); its version."""
        was = self.state()
        opened = was | {"version": was["version"] + 1, "generations": [*was["generations"], was["generations"][-1] + 1]}
        self._switch(opened)  # from here on writers add to the new generation
        base = f"base={was['version'] + 2}"
        rows = self._read(was)
        place = ["result_bucket", "result_key"]
        ordered = rows.repartitionByRange(ranges, *place) if ranges else rows.repartitionByRange(*place)
        ordered.sortWithinPartitions(*place).write.mode("overwrite").option("parquet.bloom.filter.enabled#result_key", "true").parquet(f"{self.path}/{base}")
        self._switch({"version": was["version"] + 2, "base": base, "generations": opened["generations"][len(was["generations"]):]})
        return was["version"] + 2

    def vacuum(self) -> int:
        """Delete bases and generations that the newest state does not name, and older states; call it when no reader of
        an older state is left.  Gives the number of folders deleted."""
        state, n = self.state(), 0
        keep = {state["base"], *(f"generation={g}" for g in state["generations"])}
        for s in self._fs.listStatus(self._path(self.path)):
            name = s.getPath().getName()
            newer = name.startswith("generation=") and int(name[11:]) > state["generations"][-1]
            if name.startswith(("base=", "generation=")) and name not in keep and not newer:
                n += bool(self._fs.delete(s.getPath(), True))
        for v in self._states()[:-1]:
            self._fs.delete(self._path(f"{self.path}/state/{v:08d}.json"), False)
        return n


def publish_lookup(results: DataFrame, table: str, path: str, buckets: int | None = None) -> None:
    """JOIN-2 point lookup: ``results`` (one row per ``result_bucket``, ``result_key``) as table ``table`` at ``path``, bucketed and
    sorted by ``place``, with a Bloom filter of it in every file.  Status joins read it without a shuffle (at
    least as many buckets as the session's shuffle partitions), and lookups of given places read their buckets only."""
    spark = results.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = results.withColumn("place", place_of(F.col("result_bucket"), F.col("result_key"))).where("place is not null")
    (
        placed.repartition(n, "place").write.mode("overwrite").bucketBy(n, "place").sortBy("place")
        .option("path", path).option("parquet.bloom.filter.enabled#place", "true").saveAsTable(table)
    )


def find_results(spark: SparkSession, table: str, places: list[tuple[str, str]]) -> DataFrame:
    """Rows of a published table for given (bucket, key) pairs: buckets, row groups and Bloom filters narrow the read."""
    return spark.table(table).where(F.col("place").isin([f"{b}/{k}" for b, k in places]))
