"""Benchmark passages in documents, found by winnowing.

Texts become words, words become hashes of k consecutive words, and of every ``w``
consecutive hashes the smallest (the last of equals) is kept.  With k + w - 1 = span,
any ``span`` words that a document and an item share hold w such hashes, so both keep
the same one at the same place: no shared span is missed.  The kept hashes of both
sides are joined, and every match is extended word by word to the left and right; it
counts if at least ``span`` words agree.  An item shorter than ``span`` is one span of
its own length (so there are at most ``span`` lengths, whatever the tables hold).

A document's hash travels only if its bit is set in a bitmap of ``BITS`` bits made of
the item hashes (a fixed size; more items only let more hashes through to the exact
join).  Each hash carries the word hashes around it that an extension can need, so no
text is fetched again.

Defined results: null and empty texts have no words and no hits; ids may be null or
repeated, rows are told apart by the row number of the written scan; items with equal
ids count once for a document; a null item id is listed as an empty string; empty
tables give no hits; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.common import free_name, hash_bitmap, written
from parlance.llm.words import ALNUM, Words, buffer_of, find_words, mix64, parts, shingles

#: Words of a shared span that counts.
SPAN = 10
#: Bits of the bitmap that document hashes must pass; 2 MiB on every task.
BITS = 1 << 24


def _k(span: int) -> int:
    return (span + 1) // 2


def winnow(words: Words, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Kept hashes for ``span`` and the word index at which each begins."""
    k = _k(span)
    w = span - k + 1
    h, index = shingles(words, k)
    n = len(h) - w + 1
    if n <= 0:
        return h[:0], index[:0]
    best, arg = h[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, w):
        less = h[j : n + j] <= best
        best[less], arg[less] = h[j : n + j][less], j
    whole = index[w - 1 :] - index[:n] == w - 1
    whole &= words.doc[index[:n]] == words.doc[index[w - 1 :]]
    at = np.unique((np.arange(n) + arg)[whole])
    return mix64(h[at] + np.uint64(span)), index[at]


def _context(words: Words, at: np.ndarray, span: int, outside: int) -> np.ndarray:
    """Word hashes from span - k words before ``at`` to span words after it; ``outside`` beyond the text."""
    k = _k(span)
    around = at[:, None] + np.arange(-(span - k), span)
    inside = (around >= words.first[words.doc[at]][:, None]) & (around < words.first[words.doc[at] + 1][:, None])
    out = words.hash[np.clip(around, 0, max(len(words.hash) - 1, 0))] if len(at) else np.zeros(around.shape, np.uint64)
    return np.where(inside, out, np.uint64(outside))


def _blobs(rows: np.ndarray) -> list[bytes]:
    raw, n = rows.tobytes(), rows.shape[1] * 8
    return [raw[i : i + n] for i in range(0, len(raw), n)]


def item_fingerprints(items: DataFrame, span: int = SPAN) -> DataFrame:
    """fp, span, item_id, item_words: the kept hashes of every item, items shorter than ``span`` by their own length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in parts(batch.column("text")):
                part = batch.slice(i, j - i)
                words = find_words(*buffer_of(part.column("text")), ALNUM)
                n = np.diff(words.first)
                for length in np.unique(np.minimum(n[n > 0], span)).tolist():
                    fp, at = winnow(words, length)
                    own = n[words.doc[at]] == length if length < span else n[words.doc[at]] >= span
                    fp, at = fp[own], at[own]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(fp.view(np.int64)), pa.array(np.full(len(fp), length, np.int32)), part.column("item_id").take(pa.array(words.doc[at])), pa.array(_blobs(_context(words, at, length, 1)), pa.binary())],
                        ["fp", "span", "item_id", "item_words"],
                    )

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", "text").mapInArrow(run, f"fp bigint, span int, item_id {kind}, item_words binary")


def document_candidates(docs: DataFrame, bitmap: np.ndarray, spans: list[int]) -> DataFrame:
    """A row per document: doc_id, text_md5, n_words, and its kept hashes that pass the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in parts(batch.column("text")):
                part = batch.slice(i, j - i)
                words = find_words(*buffer_of(part.column("text")), ALNUM)
                found = []
                for span in spans:
                    fp, at = winnow(words, span)
                    low = (fp & np.uint64(BITS - 1)).astype(np.int64)
                    hit = (bitmap[low >> 3] >> (low & 7).astype(np.uint8)) & 1 == 1
                    fp, at = fp[hit], at[hit]
                    found.append((fp.view(np.int64), np.full(len(fp), span, np.int32), at, _blobs(_context(words, at, span, 0))))
                fp, span_, at = (np.concatenate([f[c] for f in found]) if found else np.zeros(0, np.int64) for c in range(3))
                blobs = [b for f in found for b in f[3]]
                at = at.astype(np.int64)
                doc = words.doc[at]
                order = np.argsort(doc, kind="stable")
                offsets = np.searchsorted(doc[order], np.arange(j - i + 1)).astype(np.int32)
                struct = pa.StructArray.from_arrays(
                    [pa.array(fp[order].astype(np.int64)), pa.array(span_[order].astype(np.int32)), pa.array((at - words.first[doc])[order]), pa.array([blobs[o] for o in order.tolist()], pa.binary())],
                    ["fp", "span", "at", "words"],
                )
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_md5"), pa.array(np.diff(words.first)), pa.ListArray.from_arrays(pa.array(offsets), struct)],
                    ["doc_id", "text_md5", "n_words", "candidates"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    narrow = docs.select("doc_id", F.md5("text").alias("text_md5"), "text")
    return narrow.mapInArrow(run, f"doc_id {kind}, text_md5 string, n_words bigint, candidates array<struct<fp:bigint,span:int,at:bigint,words:binary>>")


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches that reach ``span`` words once extended: words lo to hi of the document."""
    for batch in batches:
        span_of = batch.column("span").to_numpy()
        for span in np.unique(span_of).tolist():
            part = batch.filter(pa.array(span_of == span))
            k, width = _k(span), 2 * span - _k(span)
            both = [np.frombuffer(buffer_of(part.column(c))[0], np.uint64).reshape(-1, width) for c in ("words", "item_words")]
            same = both[0] == both[1]
            left = np.logical_and.accumulate(same[:, : span - k][:, ::-1], axis=1).sum(1) if span > k else np.zeros(len(same), np.int64)
            right = np.logical_and.accumulate(same[:, span:], axis=1).sum(1) if span > k else np.zeros(len(same), np.int64)
            long = same[:, span - k : span].all(1) & (left + right + k >= span)
            at = part.column("at").to_numpy()
            keep = pa.array(long)
            yield pa.RecordBatch.from_arrays(
                [part.column("_row").filter(keep), part.column("item_id").filter(keep), pa.array((at - left)[long]), pa.array((at + k + right)[long])],
                ["_row", "item_id", "lo", "hi"],
            )


def find_overlaps(docs: DataFrame, items: DataFrame, span: int = SPAN) -> tuple[DataFrame, DataFrame]:
    """``(rows, spans)``: the documents (``_row``, doc_id, text_md5, n_words), and the word spans
    ``_row, item_id, lo, hi`` of theirs that an item holds too (spans of one item may overlap)."""
    known = written(item_fingerprints(items, span).distinct(), "items")
    spans = sorted(r["span"] for r in known.select("span").distinct().collect())  # at most ``span`` values
    rows = written(document_candidates(docs, hash_bitmap(known, "fp", BITS), spans).withColumn("_row", F.monotonically_increasing_id()), "candidates")
    each = rows.where(F.size("candidates") > 0).select("_row", F.inline("candidates"))
    kind = items.schema["item_id"].dataType.simpleString()
    spans_found = each.join(known, ["fp", "span"]).select("_row", "span", "at", "words", "item_id", "item_words").mapInArrow(_extend, f"_row bigint, item_id {kind}, lo bigint, hi bigint")
    return rows.select("_row", "doc_id", "text_md5", "n_words"), spans_found


def contamination(docs: DataFrame, items: DataFrame, span: int = SPAN) -> DataFrame:
    """Per document: doc_id, text_md5, n_words, n_hit (words inside shared spans), n_items, item_ids
    (sorted as strings), contaminated."""
    rows, spans = find_overlaps(docs, items, span)
    spans = written(spans.distinct(), "spans")
    reach = spans.groupBy("_row", "lo").agg(F.max("hi").alias("hi"))
    seen = F.max("hi").over(Window.partitionBy("_row").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1))
    hit = (
        reach.withColumn("seen", F.coalesce(seen, F.lit(0)))
        .groupBy("_row").agg(F.sum(F.greatest(F.col("hi") - F.greatest("lo", "seen"), F.lit(0))).alias("n_hit"))
    )
    ids = (
        spans.select("_row", F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id")).distinct()
        .groupBy("_row").agg(F.array_sort(F.collect_list("item_id")).alias("item_ids"))
    )
    return (
        rows.join(hit.join(ids, "_row"), "_row", "left")
        .select(
            "doc_id", "text_md5", "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
            F.when(F.col("item_ids").isNull(), 0).otherwise(F.size("item_ids")).cast("bigint").alias("n_items"),
            F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        )
        .withColumn("contaminated", F.col("n_hit") > 0)
    )


def without_contaminated(docs: DataFrame, items: DataFrame, span: int = SPAN) -> DataFrame:
    """``docs`` without the documents that share ``span`` words with an item, all columns as they were."""
    md5 = free_name(docs, "_md5")
    bad = contamination(docs, items, span).where("contaminated").select(F.col("text_md5").alias(md5)).distinct()
    # written first, so that a small table is known to be small and the documents need not move
    return docs.withColumn(md5, F.md5("text")).join(written(bad, "contaminated"), md5, "left_anti").drop(md5)
