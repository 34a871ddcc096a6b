"""AGG-4 chunk payloads and AGG-5 / SET-1 recombination of enhanced chunks.

Both aggregate in two levels so no transcript-wide list of segments is built:
segments are collected per chunk (bounded by the token budget plus its segments
without words), and only the chunk-level results are gathered per transcript.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import py_strip

SEGMENT_FIELDS = ("timestamp", "speaker", "text")


def _ordered(list_col, field: str):
    """Values of ``field`` from a list of structs, sorted by their first field
    (ORD-1: order is restored from the ordinal, never from row order)."""
    return F.transform(F.array_sort(list_col), lambda x: x[field])


def chunk_payload(packed: DataFrame, *, key: str = "transcript_id", order: str = "seg_no") -> DataFrame:
    """One row per chunk with the ordered segment list and its JSON text for the model.

    Output: ``key, chunk_no, segments array<struct<timestamp,speaker,text>>,
    payload string, n_segments, n_tokens, first_seg, last_seg``.
    """
    seg = F.struct(F.col(order).alias("_o"), *[F.col(c) for c in SEGMENT_FIELDS])
    grouped = packed.groupBy(key, "chunk_no").agg(
        F.array_sort(F.collect_list(seg)).alias("_segs"),
        F.count(F.lit(1)).alias("n_segments"),
        F.sum("n_tokens").cast("bigint").alias("n_tokens"),
        F.min(order).alias("first_seg"),
        F.max(order).alias("last_seg"),
    )
    segs = F.transform("_segs", lambda x: F.struct(*[x[c].alias(c) for c in SEGMENT_FIELDS]))
    return grouped.select(
        key, "chunk_no", segs.alias("segments"), F.to_json(segs).alias("payload"),
        "n_segments", "n_tokens", "first_seg", "last_seg",
    )


def combine_chunks(enhanced: DataFrame, *, key: str = "transcript_id", ok: str | None = None) -> DataFrame:
    """AGG-5: per transcript, chunk transcripts joined in chunk order (``t + ' '`` each,
    then stripped) and segment lists concatenated in order.

    Input: ``key, chunk_no, transcript string, segments array<struct<...>>`` (D8 rows,
    failed chunks already removed, or flagged by the boolean column ``ok``: failed
    chunks are then skipped inside the aggregation).  Output: ``key, transcript,
    segments, n_chunks``; a transcript without any valid chunk is left out.
    Texts are joined with ``array_join`` (SCL-3).
    """
    item = F.struct("chunk_no", "transcript", "segments")
    if ok:
        item = F.when(F.col(ok), item)
    agg = enhanced.groupBy(key).agg(
        F.array_sort(F.collect_list(item)).alias("_c"),
        F.count(item).alias("n_chunks"),
    ).where(F.col("n_chunks") > 0)
    return agg.select(
        key,
        py_strip(F.array_join(F.transform("_c", lambda x: x["transcript"]), " ")).alias("transcript"),
        F.flatten(F.filter(F.transform("_c", lambda x: x["segments"]), lambda s: s.isNotNull())).alias("segments"),
        F.col("n_chunks").cast("bigint").alias("n_chunks"),
    )


def echo_chunks(payloads: DataFrame, *, key: str = "transcript_id") -> DataFrame:
    """Deterministic stand-in for the rewriting model: each chunk comes back as
    ``{transcript: segment texts joined by one space, segments: unchanged}``."""
    return payloads.select(
        key,
        "chunk_no",
        F.array_join(F.transform("segments", lambda x: x["text"]), " ").alias("transcript"),
        "segments",
    )


def combine_chunks_long(enhanced: DataFrame, *, key: str = "transcript_id", ok: str | None = None) -> DataFrame:
    """AGG-5 / SET-1 without a transcript-wide list: one row per enhanced segment
    with its position ``(chunk_no, pos)`` in the recombined transcript.  Nothing is
    grouped, so a transcript of any size stays spread over the cluster; writing
    it sorted by ``(key, chunk_no, pos)`` gives the recombined document in order."""
    rows = enhanced if ok is None else enhanced.where(F.col(ok))
    return rows.select(key, "chunk_no", F.posexplode("segments").alias("pos", "seg")).select(
        key, "chunk_no", F.col("pos").cast("bigint").alias("pos"), "seg.timestamp", "seg.speaker", "seg.text"
    )
