"""From raw documents to packed training sequences, in five stages.

Each stage takes what the one before kept, as a table read back from Parquet, and calls
one operator of ``parlance.llm``:

1. ``toxicity``: documents that score 0.5 or more go.
2. ``near_duplicates``: of every group linked by 5-word shingles (Jaccard >= 0.8) the document with the smallest id stays.
3. ``decontamination``: documents that share 10 consecutive words with a benchmark item go.
4. ``secrets``: secrets are replaced by a mark; all documents stay, n_chars follows.
5. ``packing``: documents become pieces placed in sequences of 2048 tokens.

All but the last return the columns of their input.

Defined results: a null or empty text is not toxic, is no copy of anything, holds no passage and no
secret, so its document passes the first four stages and becomes one piece (its end id); a document with a null id is scored,
checked for passages and redacted like any other, and is no copy of another; of repeated rows of the document that stays one
row stays; an empty table gives empty tables; columns besides ``doc_id``, ``text`` and ``n_chars`` go along
unread, whatever their names.  A table without ``n_chars`` gets none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import table
from parlance.llm.decontaminate import without_contaminated
from parlance.llm.packing import pack_documents
from parlance.llm.secrets import redact
from parlance.llm.setjoin import without_near_duplicates
from parlance.llm.toxicity import train, without_toxic
from parlance.session import drop_scratch, ensure_checkpoint_dir, limit_batches, scratch_mark, scratch_path, ship_package


def _ready(spark: SparkSession) -> None:
    ship_package(spark)
    ensure_checkpoint_dir(spark)
    limit_batches(spark)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return without_toxic(docs, train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return without_near_duplicates(docs, k=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    out = redact(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", packing),
]

#: SQL can express neither the trained model nor the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read back by the next.
    A stage's intermediate tables are deleted when its own table is written."""
    _ready(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path, mark = scratch_path(spark, name), scratch_mark()
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        drop_scratch(spark, since=mark)
    return STAGES[-1][1](spark, docs, sf_dir)
