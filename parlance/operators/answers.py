"""Model answers that survive (UDF-1/2/3): a write-through store, and clients by language (RM-6).

``ask_once`` asks each distinct request once, ever.  Requests are known by the SHA-256 of their text (and
language); what the store holds is not asked.  A task writes the answers of every call to the store
before it goes on, as one small Parquet file that is moved into place when it is whole, and a task that runs again first reads what its
earlier attempts have written.  So a lost executor costs at most the one call per client that was under way.
Answers come from the store alone: plans that read them later never call the model.

Files are written through ``pyarrow.fs`` (a local or mounted folder, ``s3a://``, ``gs://``, ``hdfs://``), since a task cannot use Spark's
own writers; the folder must be one that all executors share.

``by_language`` gives every client rows of one language: rows are counted per language, a language gets as many
partitions as its rows need (a third of all rows in one language is many partitions), and rows go to
partitions by number, so that no partition holds two languages.
"""

from __future__ import annotations

import inspect
import re
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.operators.models import ask_batch
from parlance.schemas import LANGUAGE_CODE

_ANSWERS = "request_hash string, response string"
#: Most languages that get partitions of their own; the rows of rarer ones are dealt over further partitions, in which languages follow one another.
LANGUAGES = 10_000


def _file_system(path: str):
    """The pyarrow file system of a Spark path, and the path in it."""
    from pyarrow import fs

    plain = re.sub("^file:/*", "/", path)
    if plain.startswith("/"):
        return fs.LocalFileSystem(), plain
    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))


class AnswerStore:
    """Answers by request hash in a folder that all executors share; any number of runs may use it."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def read(self, spark: SparkSession) -> DataFrame:
        """request_hash, response: one row per answered request (of several answers the smallest)."""
        fs, root = _file_system(self.path)
        from pyarrow.fs import FileType

        if fs.get_file_info(f"{root}/answers").type == FileType.NotFound:
            return spark.createDataFrame([], _ANSWERS)
        rows = spark.read.schema(_ANSWERS).option("recursiveFileLookup", True).parquet(f"{self.path}/answers")
        return rows.groupBy("request_hash").agg(F.min("response").alias("response"))

    def write(self, run: str, part: int, answers: list[tuple[str, str]]) -> None:
        """Add (hash, response) rows; readers see all of them or none."""
        fs, root = _file_system(self.path)
        folder = f"{root}/answers/{run}"
        fs.create_dir(folder, recursive=True)
        name = f"{part}-{uuid.uuid4().hex}.parquet"
        table = pa.table({"request_hash": [h for h, _ in answers], "response": pa.array([r for _, r in answers], pa.string())})
        with fs.open_output_stream(f"{folder}/_{name}") as f:  # readers skip names that begin so
            pq.write_table(table, f)
        fs.move(f"{folder}/_{name}", f"{folder}/{name}")

    def written_by(self, run: str, part: int) -> dict[str, str]:
        """What earlier attempts of task ``part`` of ``run`` have written."""
        from pyarrow.fs import FileSelector

        fs, root = _file_system(self.path)
        found: dict[str, str] = {}
        for info in fs.get_file_info(FileSelector(f"{root}/answers/{run}", allow_not_found=True)):
            if info.base_name.startswith(f"{part}-"):
                with fs.open_input_file(info.path) as f:
                    table = pq.read_table(f)
                found.update(zip(table.column(0).to_pylist(), table.column(1).to_pylist()))
        return found


def _client(factory: Callable, language: str | None):
    """A client of ``factory``, which may take the language."""
    return factory(language) if inspect.signature(factory).parameters else factory()


def by_language(df: DataFrame, language: str, rows_per_client: int, spread: Column) -> DataFrame:
    """``df`` in partitions of one language and about ``rows_per_client`` rows each (``spread``: what deals a language's rows out)."""
    per = df.groupBy(language).agg(F.count(F.lit(1)).alias("n"))
    counts = per.orderBy(F.desc("n"), language).limit(LANGUAGES).collect()
    rest = (per.agg(F.sum("n")).first()[0] or 0) - sum(r["n"] for r in counts) if len(counts) == LANGUAGES else 0
    first, slots = 0, []
    for r in counts:
        clients = -(-r["n"] // rows_per_client)
        slots.append((r[language], first, clients))
        first += clients
    table = df.sparkSession.createDataFrame(slots, f"_language {df.schema[language].dataType.simpleString()}, _first int, _clients int")
    dealt = df.join(F.broadcast(table), F.col(language).eqNullSafe(F.col("_language")), "left")  # at most LANGUAGES rows
    others = max(1, -(-rest // rows_per_client))
    h = F.xxhash64(spread)
    slot = F.coalesce(F.col("_first") + F.pmod(h, F.col("_clients")), first + F.pmod(h, F.lit(others))).cast("int")
    return dealt.repartitionById(first + others, slot).drop("_language", "_first", "_clients")


def apply_model_by_language(df: DataFrame, factory: Callable, *, language: str = "language", request: str = "payload", response: str = "response", batch_rows: int = 64, rows_per_client: int = 10_000) -> DataFrame:
    """``apply_model`` with a client per language: ``factory(language)`` gives it, once for a partition.  A null language
    is the default one.  Adds ``response``, ``<response>_error`` and ``<response>_client``, the language whose client was asked."""
    whose = f"{response}_client"
    asked = by_language(df.withColumn(whose, F.coalesce(language, F.lit(LANGUAGE_CODE))), whose, rows_per_client, F.col(request))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema) + f", {response} string, {response}_error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        clients: dict = {}
        for pdf in batches:
            for of, part in pdf.groupby(whose, sort=False):
                if of not in clients:
                    clients = {of: _client(factory, of)}
                requests = part[request].tolist()
                outs = [a for i in range(0, len(requests), batch_rows) for a in ask_batch(clients[of], requests[i : i + batch_rows])]
                yield part.assign(**{response: [a for a, _ in outs], f"{response}_error": [e for _, e in outs]})

    return asked.mapInPandas(run, ddl)


def ask_once(
    df: DataFrame, factory: Callable, store: AnswerStore, *, request: str = "payload", response: str = "response", language: str | None = None,
    batch_rows: int = 64, concurrency: int | None = None, rows_per_client: int = 10_000,
) -> DataFrame:
    """``df`` with ``response``, ``<response>_error`` and ``<response>_reused`` (the store held it before).  Equal requests are asked
    once.  Requests without an answer (a failed call, a null answer, a null request) are not stored: the next run asks them again."""
    spark, run = df.sparkSession, uuid.uuid4().hex[:12]
    spoken = F.coalesce(F.col(language), F.lit(LANGUAGE_CODE)) if language else F.lit("")
    rows = df.withColumn("_hash", F.sha2(F.concat(spoken, F.lit("\n"), F.col(request)), 256)).withColumn("_spoken", spoken)
    known = store.read(spark).select(F.col("request_hash").alias("_hash"), F.col("response").alias("_known"))
    open_ = rows.where(F.col("_hash").isNotNull()).groupBy("_hash").agg(F.first(request).alias("_request"), F.first("_spoken").alias("_spoken")).join(known.select("_hash"), "_hash", "left_anti")
    if language:
        open_ = by_language(open_, "_spoken", rows_per_client, F.col("_hash"))
    else:
        open_ = open_.repartition(concurrency or spark.sparkContext.defaultParallelism, "_hash")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        done, clients = store.written_by(run, part), {}
        for pdf in batches:
            for of, same in pdf.groupby("_spoken", sort=False):
                todo = [(h, r) for h, r in zip(same["_hash"], same["_request"]) if h not in done]
                if of not in clients:
                    clients = {of: _client(factory, of or None)}
                errors = []
                for i in range(0, len(todo), batch_rows):
                    some = todo[i : i + batch_rows]
                    outs = ask_batch(clients[of], [r for _, r in some])
                    answers = [(h, a) for (h, _), (a, _) in zip(some, outs) if a is not None]
                    if answers:
                        store.write(run, part, answers)
                    errors += [(h, e) for (h, _), (a, e) in zip(some, outs) if a is None]
                yield pd.DataFrame(errors, columns=["_hash", "_error"], dtype=object)

    # the one action that calls the model; what it returns is which requests failed, and why
    failed = open_.mapInPandas(ask, "_hash string, _error string").checkpoint(eager=True)
    new = store.read(spark).select(F.col("request_hash").alias("_hash"), F.col("response").alias(response))
    out = rows.join(new, "_hash", "left").join(failed, "_hash", "left").join(_before(store, spark, run), "_hash", "left")
    return out.select(*df.columns, response, F.col("_error").alias(f"{response}_error"), F.coalesce("_before", F.lit(False)).alias(f"{response}_reused"))


def _before(store: AnswerStore, spark: SparkSession, run: str) -> DataFrame:
    """Hashes that another run than ``run`` has answered."""
    fs, root = _file_system(store.path)
    from pyarrow.fs import FileType

    if fs.get_file_info(f"{root}/answers").type == FileType.NotFound:
        return spark.createDataFrame([], "_hash string, _before boolean")
    rows = spark.read.schema(_ANSWERS).option("recursiveFileLookup", True).parquet(f"{store.path}/answers")
    return rows.where(~F.col("_metadata.file_path").contains(f"/answers/{run}/")).select(F.col("request_hash").alias("_hash"), F.lit(True).alias("_before")).distinct()
