"""Quality selection by importance resampling over hashed n-grams.

Words and pairs of neighbouring words are hashed into ``BUCKETS`` classes.  Two bags of
them are counted: the raw text (all documents) and the target (at most ``sample``
documents labelled good, the first by a hash of the id, one row of each).  A document's log weight is the
sum over its n-grams of log p(target) - log p(raw).  Adding Gumbel noise to the log
weights and taking the k largest draws k documents without replacement in proportion to
their weights.

k: by default the share of good labels among all labels, of the number of documents.
The noise is a hash of seed, id and text.

Defined results: null and empty texts have weight 0 in logs (no evidence); documents
that tie with the k-th are all taken; repeated rows get equal noise and are taken
together; without good labels the target is the raw text and all log weights are 0; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import summed_counts, written
from parlance.llm.words import NOT_SPACE, buffer_of, find_words, parts, shingles

BUCKETS = 1 << 14
#: Documents labelled good that make up the target at most.
SAMPLE = 20_000
_STEPS = 4096


def _buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every word and word pair, and the text it is in."""
    words = find_words(*buffer_of(texts), NOT_SPACE)
    pairs, index = shingles(words, 2)
    h = np.concatenate([words.hash, pairs])
    return (h & np.uint64(BUCKETS - 1)).astype(np.int64), np.concatenate([words.doc, words.doc[index]])


def _count(batch: pa.RecordBatch) -> np.ndarray:
    total = np.zeros(BUCKETS, np.int64)
    for i, j in parts(batch.column("text")):
        total += np.bincount(_buckets(batch.column("text").slice(i, j - i))[0], minlength=BUCKETS)
    return total


def log_ratios(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """log p(target) - log p(raw) of every bucket, and the share of good labels."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("good"))
    n, good = known.agg(F.count(F.lit(1)), F.count(F.when(F.col("good") > 0, 1))).first()
    raw = summed_counts(docs.select("text"), _count, BUCKETS) + 1.0
    if not good:
        return np.zeros(BUCKETS), 1.0
    chosen = known.where("good > 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id")  # ``sample`` ids
    # one row of each chosen document: of several texts under its id the one of the smallest MD5
    few = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    one = few.groupBy("doc_id").agg(F.min(F.struct(F.md5("text").alias("md5"), "text")).alias("first")).select("first.text")
    target = summed_counts(one, _count, BUCKETS)
    # as many pseudo counts as the raw text's shape explains keep thin buckets near ratio 1
    target = target + len(target) * raw / raw.sum()
    return np.log(target / target.sum()) - np.log(raw / raw.sum()), good / n


def weigh(docs: DataFrame, ratios: np.ndarray, seed: int = 0) -> DataFrame:
    """doc_id, n_grams, log_weight and key (log_weight plus Gumbel noise) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in parts(batch.column("text")):
                part = batch.slice(i, j - i)
                bucket, doc = _buckets(part.column("text"))
                weight = np.bincount(doc, weights=ratios[bucket], minlength=j - i).astype(float)  # integers for no words at all
                u = ((part.column("h").to_numpy().view(np.uint64) >> np.uint64(11)).astype(float) + 0.5) / 2.0**53
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.bincount(doc, minlength=j - i)), pa.array(weight), pa.array(weight - np.log(-np.log(u)))], ["doc_id", "n_grams", "log_weight", "key"]
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, n_grams bigint, log_weight double, key double")


def kth_largest(df: DataFrame, column: str, k: int) -> float:
    """The k-th largest value of a finite column, by counting in ever finer steps: each pass counts
    at most ``_STEPS`` classes, so the driver sees a fixed number of counts."""
    lo, hi = df.agg(F.min(column), F.max(column)).first()
    above = 0  # rows beyond hi
    while hi is not None and lo < hi:
        step = (hi - lo) / _STEPS
        if step == 0 or lo + step == lo:
            break
        inside = df.where((F.col(column) >= lo) & (F.col(column) <= hi))
        at = F.least(F.floor((F.col(column) - lo) / step), F.lit(_STEPS - 1)).alias("at")
        classes = inside.groupBy(at).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()
        for r in sorted(classes, key=lambda r: -r["at"]):
            if above + r["n"] >= k:
                lo, hi = r["lo"], r["hi"]
                break
            above += r["n"]
    return lo if lo is not None else float("inf")


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 0, sample: int = SAMPLE) -> DataFrame:
    """doc_id, n_grams, log_weight, key and kept (drawn) of every row."""
    ratios, share = log_ratios(docs, labels, sample)
    rows = written(weigh(docs, ratios, seed), "weights")
    if k is None:
        k = round(share * rows.count())
    if k <= 0:
        return rows.withColumn("kept", F.lit(False))
    return rows.withColumn("kept", F.col("key") >= F.lit(kth_largest(rows, "key", k)))
