"""Queries: top_terms, top_entities, job_history, job_progress, apply_vocabulary,
apply_vocabulary_table, language_counts (roadmap extensions, RM-2..6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions.text import NON_WS
from parlance.operators.analytics import (
    apply_vocabulary,
    job_history,
    job_progress,
    language_counts,
    state_durations,
    top_entities,
    top_terms,
)
from parlance.operators.entities import extract_entities
from parlance.plans.entities import _extract_sql
from parlance.plans.jobs import JOB_EVENTS_SQL, job_events
from parlance.plans.registry import query
from parlance.sources.tables import spread, table


@query(
    "top_terms",
    """SELECT term, count(*)::BIGINT AS n
FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents)
GROUP BY term ORDER BY n DESC, term LIMIT 50""",
)
def q_top_terms(spark, sf_dir):
    return top_terms(spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"), 50)


@query(
    "top_entities",
    f"""WITH x AS ({_extract_sql()})
SELECT category, value, count(DISTINCT doc_id)::BIGINT AS n_transcripts
FROM x GROUP BY ALL ORDER BY n_transcripts DESC, category, value LIMIT 20""",
)
def q_top_entities(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("transcript_id"), "text"), "transcript_id")
    return top_entities(extract_entities(docs), 20)


@query(
    "job_history",
    f"""WITH {JOB_EVENTS_SQL}
SELECT CAST(ts AS DATE) AS day, status, count(*)::BIGINT AS n_events, count(DISTINCT job_name)::BIGINT AS n_jobs
FROM job_events GROUP BY ALL""",
)
def q_job_history(spark, sf_dir):
    return job_history(job_events(spark, sf_dir))


@query(
    "job_progress",
    f"""WITH {JOB_EVENTS_SQL}
SELECT job_name,
       min(ts) FILTER (WHERE status = 'QUEUED') AS first_queued,
       min(ts) FILTER (WHERE status = 'IN_PROGRESS') AS first_in_progress,
       min(ts) FILTER (WHERE status = 'COMPLETED') AS first_completed,
       min(ts) FILTER (WHERE status = 'FAILED') AS first_failed,
       min(ts) AS first_ts, max(ts) AS last_ts,
       (epoch_us(min(ts) FILTER (WHERE status = 'COMPLETED')) - epoch_us(min(ts) FILTER (WHERE status = 'QUEUED'))) / 1e6
         AS turnaround_s,
       (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS span_s
FROM job_events GROUP BY job_name""",
)
def q_job_progress(spark, sf_dir):
    return job_progress(job_events(spark, sf_dir))


@query(
    "state_durations",
    f"""WITH {JOB_EVENTS_SQL},
s AS (SELECT *, lag(status) OVER o AS prior FROM job_events WINDOW o AS (PARTITION BY job_name ORDER BY ts, event_id)),
e AS (SELECT job_name, status, ts, lead(ts) OVER (PARTITION BY job_name ORDER BY ts, event_id) AS until
      FROM s WHERE prior IS NULL OR prior <> status)
SELECT job_name, status, count(*)::BIGINT AS n_entered, coalesce(sum(epoch_us(until) - epoch_us(ts)), 0)::BIGINT / 1e6 AS seconds,
       max(epoch_us(until) - epoch_us(ts)) / 1e6 AS longest_s, max(ts) FILTER (WHERE until IS NULL) AS open_since
FROM e GROUP BY job_name, status""",
)
def q_state_durations(spark, sf_dir):
    return state_durations(job_events(spark, sf_dir))


# a small fixed vocabulary (literal map path)
VOCABULARY = {"the": "THE", "and": "AND", "und": "UND", "le": "LE", "la": "LA", "de": "DE", "in": "IN"}
VOCAB_SQL = "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in VOCABULARY.items()) + ") AS v(term, preferred)"


def _vocab_oracle(vocab_sql: str) -> str:
    return f"""WITH w AS (
  SELECT conv_id, turn, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i
  FROM conversations
), v AS (SELECT * FROM {vocab_sql})
SELECT conv_id, turn, string_agg(coalesce(v.preferred, w.w), ' ' ORDER BY w.i) AS text_out
FROM w LEFT JOIN v ON v.term = w.w GROUP BY conv_id, turn"""


@query("apply_vocabulary", _vocab_oracle(VOCAB_SQL))
def q_apply_vocabulary(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return apply_vocabulary(conv, VOCABULARY).select("conv_id", "turn", "text_out")


BENCH_VOCAB_SQL = """(SELECT term, min(upper(term) || '_' || item_id % 3) AS preferred
 FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM benchmark) GROUP BY term)"""


@query("apply_vocabulary_table", _vocab_oracle(BENCH_VOCAB_SQL))
def q_apply_vocabulary_table(spark, sf_dir):
    """Vocabulary of unknown size (derived from ``benchmark``): join path.  A term of several items has several preferred forms."""
    bench = table(spark, sf_dir, "benchmark").select("item_id", "text")
    vocab = (
        bench.select("item_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("term"))
        .select("term", F.concat(F.upper("term"), F.lit("_"), F.col("item_id") % 3).alias("preferred"))
    )
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return apply_vocabulary(conv, vocab).select("conv_id", "turn", "text_out")


@query(
    "language_counts",
    f"""SELECT lang, count(*)::BIGINT AS n_docs, sum(n_chars)::BIGINT AS n_chars,
       sum(len(regexp_extract_all(text, '{NON_WS}')))::BIGINT AS n_words
FROM documents GROUP BY lang""",
)
def q_language_counts(spark, sf_dir):
    return language_counts(spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", "text"), "doc_id"))
