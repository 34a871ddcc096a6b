"""Queries: token_counts, pack_chunks_*, chunk_sizes, chunk_payload, combine_chunks.

Stand-in: ``conversations`` are transcripts (conv_id), turns are segments.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions.text import NON_WS, WS
from parlance.operators.packing import chunk_table, pack_chunks, token_counts
from parlance.operators.recombine import chunk_payload, combine_chunks, combine_chunks_long, echo_chunks
from parlance.plans.registry import query
from parlance.sources.tables import conversation_segments

WORDS_SQL = f"len(regexp_extract_all(text, '{NON_WS}'))"


def packing_cte(budget: int) -> str:
    """Recursive CTE computing the greedy fold row by row (the oracle's brute force)."""
    return f"""
WITH RECURSIVE s AS (
  SELECT conv_id, turn, text, CAST({WORDS_SQL} AS BIGINT) AS n_tokens FROM conversations
), r AS (
  SELECT conv_id, turn, CASE WHEN n_tokens > {budget} THEN 1 ELSE 0 END::BIGINT AS chunk_no, n_tokens AS cur
  FROM s WHERE turn = 0
  UNION ALL
  SELECT s.conv_id, s.turn,
         CASE WHEN r.cur + s.n_tokens > {budget} THEN r.chunk_no + 1 ELSE r.chunk_no END,
         CASE WHEN r.cur + s.n_tokens > {budget} THEN s.n_tokens ELSE r.cur + s.n_tokens END
  FROM r JOIN s ON s.conv_id = r.conv_id AND s.turn = r.turn + 1
), packed AS (
  SELECT r.conv_id, r.turn, r.chunk_no, s.n_tokens, s.text FROM r JOIN s USING (conv_id, turn)
)"""


def _packed(spark, sf_dir, budget):
    segs = token_counts(conversation_segments(spark, sf_dir))
    return pack_chunks(segs, budget)


@query(
    "token_counts",
    f"SELECT conv_id, turn, CAST({WORDS_SQL} AS BIGINT) AS n_tokens FROM conversations",
)
def q_token_counts(spark, sf_dir):
    segs = token_counts(conversation_segments(spark, sf_dir))
    return segs.select(F.col("transcript_id").alias("conv_id"), F.col("seg_no").alias("turn"), "n_tokens")


def _register_pack(budget: int):
    @query(f"pack_chunks_{budget}", packing_cte(budget) + "\nSELECT conv_id, turn, chunk_no FROM packed")
    def q(spark, sf_dir):
        return _packed(spark, sf_dir, budget).select(
            F.col("transcript_id").alias("conv_id"), F.col("seg_no").alias("turn"), "chunk_no"
        )

    return q


for _b in (150, 60, 40):
    _register_pack(_b)


@query(
    "chunk_sizes",
    packing_cte(40)
    + """
SELECT conv_id, chunk_no, count(*)::BIGINT AS n_segments, sum(n_tokens)::BIGINT AS n_tokens FROM packed GROUP BY ALL
UNION ALL
SELECT conv_id, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM packed GROUP BY conv_id HAVING min(chunk_no) > 0""",
)
def q_chunk_sizes(spark, sf_dir):
    return chunk_table(_packed(spark, sf_dir, 40)).select(
        F.col("transcript_id").alias("conv_id"), "chunk_no", "n_segments", "n_tokens"
    )


@query(
    "chunk_payload",
    packing_cte(60)
    + """
SELECT conv_id, chunk_no, count(*)::BIGINT AS n_segments, sum(n_tokens)::BIGINT AS n_tokens,
       min(turn) AS first_turn, max(turn) AS last_turn,
       md5(string_agg(text, chr(31) ORDER BY turn)) AS text_md5
FROM packed GROUP BY ALL""",
)
def q_chunk_payload(spark, sf_dir):
    payload = chunk_payload(_packed(spark, sf_dir, 60))
    return payload.select(
        F.col("transcript_id").alias("conv_id"),
        "chunk_no",
        F.col("n_segments").cast("bigint").alias("n_segments"),
        "n_tokens",
        F.col("first_seg").alias("first_turn"),
        F.col("last_seg").alias("last_turn"),
        F.md5(F.array_join(F.transform("segments", lambda x: x["text"]), "\u001f")).alias("text_md5"),
    )


@query(
    "combine_chunks",
    packing_cte(60)
    + f"""
SELECT conv_id,
       regexp_replace(string_agg(text, ' ' ORDER BY turn), '^{WS}|{WS}$', '', 'g') AS transcript,
       count(*)::BIGINT AS n_segments,
       count(DISTINCT chunk_no)::BIGINT AS n_chunks
FROM packed GROUP BY conv_id""",
)
def q_combine_chunks(spark, sf_dir):
    combined = combine_chunks(echo_chunks(chunk_payload(_packed(spark, sf_dir, 60))))
    return combined.select(
        F.col("transcript_id").alias("conv_id"),
        "transcript",
        F.size("segments").cast("bigint").alias("n_segments"),
        "n_chunks",
    )


@query(
    "combine_chunks_long",
    packing_cte(60)
    + """
SELECT conv_id, chunk_no, (row_number() OVER (PARTITION BY conv_id, chunk_no ORDER BY turn) - 1)::BIGINT AS pos, role AS speaker, text
FROM packed JOIN conversations USING (conv_id, turn, text)""",
)
def q_combine_chunks_long(spark, sf_dir):
    """Recombination as ordered rows, with no list per transcript."""
    rows = combine_chunks_long(echo_chunks(chunk_payload(_packed(spark, sf_dir, 60))))
    return rows.select(F.col("transcript_id").alias("conv_id"), "chunk_no", "pos", "speaker", "text")


def _enhance_oracle() -> str:
    from parlance.operators.entities import DEFAULT_CATALOGUE

    n_ent = " + ".join(f"len(list_distinct(regexp_extract_all(transcript, '{rx}')))" for _, rx in DEFAULT_CATALOGUE)
    return packing_cte(60) + f"""
, t AS (
  SELECT conv_id,
         regexp_replace(string_agg(text, ' ' ORDER BY turn), '^{WS}|{WS}$', '', 'g') AS transcript,
         count(*)::BIGINT AS n_segments, count(DISTINCT chunk_no)::BIGINT AS n_chunks
  FROM packed GROUP BY conv_id
)
SELECT conv_id, length(transcript)::BIGINT AS transcript_chars, n_segments, n_chunks, 0::BIGINT AS n_lost,
       'OK' AS status, ({n_ent})::BIGINT AS n_entities,
       CASE WHEN transcript = '' THEN 'missing_transcript' END AS reject_reason,
       CASE WHEN transcript <> '' THEN 'stt-' || conv_id || '_enhanced.json' END AS output_key
FROM t"""


@query("enhance_transcripts", _enhance_oracle())
def q_enhance_transcripts(spark, sf_dir):
    """Entry point A end to end on conversations (budget 60, echo model)."""
    from parlance.operators.enhance import enhance

    doc = enhance(conversation_segments(spark, sf_dir), budget=60)
    n_ent = F.aggregate(F.map_values("entities"), F.lit(0), lambda acc, v: acc + F.size(v)).cast("bigint")
    return doc.select(
        F.col("transcript_id").alias("conv_id"),
        F.length("transcript").cast("bigint").alias("transcript_chars"),
        F.size("segments").cast("bigint").alias("n_segments"),
        "n_chunks", "n_lost", "status", n_ent.alias("n_entities"), "reject_reason", "output_key",
    )
