"""Roadmap analytics (RM-2..RM-6): term / entity top-k, job history and progress,
custom vocabulary, language counts.

Top-k uses ``orderBy(...).limit(k)`` with a total tie-break, which Spark plans
as a per-partition top-k followed by a merge of k rows per partition
(TakeOrderedAndProject), after a partially aggregated count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.operators.ordered import with_next, with_prev
from parlance.schemas import JOB_STATES

TERM_PATTERN = r"[a-z]+"


def top_terms(docs: DataFrame, k: int = 50, *, text: str = "text") -> DataFrame:
    """RM-2: most frequent lower-cased ASCII letter runs over all texts."""
    terms = docs.select(F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(TERM_PATTERN), 0)).alias("term"))
    counts = terms.groupBy("term").agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    return counts.orderBy(F.desc("n"), F.asc("term")).limit(k)


def top_entities(long: DataFrame, k: int = 50, *, key: str = "transcript_id") -> DataFrame:
    """RM-2: entities mentioned by the most transcripts."""
    # values are unique within a transcript (AGG-6), so rows are transcripts
    counts = long.groupBy("category", "value").agg(F.count(F.col(key)).cast("bigint").alias("n_transcripts"))
    return counts.orderBy(F.desc("n_transcripts"), F.asc("category"), F.asc("value")).limit(k)


def job_history(events: DataFrame, *, job: str = "job_name") -> DataFrame:
    """RM-3: events and distinct jobs per day and status."""
    return events.groupBy(F.to_date("ts").alias("day"), "status").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_events"),
        F.count_distinct(job).cast("bigint").alias("n_jobs"),
    )


def job_progress(events: DataFrame, *, job: str = "job_name") -> DataFrame:
    """RM-3/RM-4: first time each job reached each state, its first and last event,
    the queued-to-completed turnaround and the whole span in seconds.  One
    partially aggregated pass (conditional minima, i.e. a pivot with fixed values)."""
    firsts = [F.min(F.when(F.col("status") == s, F.col("ts"))).alias(f"first_{s.lower()}") for s in JOB_STATES]
    agg = events.groupBy(job).agg(*firsts, F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    turnaround = F.timestamp_diff("MICROSECOND", F.col("first_queued"), F.col("first_completed")) / F.lit(1e6)
    span = F.timestamp_diff("MICROSECOND", F.col("first_ts"), F.col("last_ts")) / F.lit(1e6)
    return agg.withColumn("turnaround_s", turnaround).withColumn("span_s", span)


def state_spells(events: DataFrame, *, job: str = "job_name") -> DataFrame:
    """RM-3/RM-4: gaps and islands of a job's states.  A spell is a run of events of one status in ``(ts, event_id)``
    order, whatever restarts lie in it; it lasts until the first event of another status (the last spell of a
    job is open: no end).  One row per spell: job, ``status, start_ts, event_id`` (its first event) and ``end_ts``.

    Rows where the status changes are found by a skew-safe lag; each ends where the next of them begins, a
    skew-safe lead over those rows alone.  A hot job is split over tasks in both."""
    order = ["ts", "event_id"]
    rows = with_prev(events.select(job, "ts", "event_id", "status"), job, order, ["status", "event_id"])
    # the status of the row before; a job's first row has no row before it (an event id is never null)
    starts = rows.where(F.col("prev_event_id").isNull() | ~F.col("prev_status").eqNullSafe(F.col("status")))
    spells = with_next(starts.select(job, "ts", "event_id", "status"), job, order, ["ts"])
    return spells.select(job, "status", F.col("ts").alias("start_ts"), "event_id", F.col("next_ts").alias("end_ts"))


def state_durations(events: DataFrame, *, job: str = "job_name") -> DataFrame:
    """RM-3/RM-4: per job and status how often it was entered, the seconds spent in it over all spells that ended,
    the longest of them, and since when it has been in it (null: it is not)."""
    spells = state_spells(events, job=job)
    us = F.timestamp_diff("MICROSECOND", F.col("start_ts"), F.col("end_ts"))
    return spells.groupBy(job, "status").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_entered"),
        (F.coalesce(F.sum(us), F.lit(0)) / F.lit(1e6)).alias("seconds"),
        (F.max(us) / F.lit(1e6)).alias("longest_s"),
        F.max(F.when(F.col("end_ts").isNull(), F.col("start_ts"))).alias("open_since"),
    )


def apply_vocabulary(segments: DataFrame, vocab: dict[str, str] | DataFrame, *, text: str = "text") -> DataFrame:
    """RM-5: replace whole words (split on single spaces) by preferred forms.

    A vocabulary given as a dict has a fixed, known size and becomes a literal map (no
    shuffle).  Of a vocabulary table of unknown size (``term, preferred``; of a
    repeated term the smallest preferred form counts, null terms and forms count for nothing)
    only the words that occur are joined: the distinct words of each text meet their
    replacements, and those come back to the text as one map per row, so a text is
    neither exploded nor rebuilt word by word.  Rows are told apart by a row id of their
    own, so equal rows and nulls in other columns are kept as they are.
    """
    if isinstance(vocab, dict):
        m = F.create_map(*[F.lit(x) for kv in vocab.items() for x in kv])
        return segments.withColumn(
            "text_out",
            F.array_join(F.transform(F.split(F.col(text), " ", -1), lambda w: F.coalesce(F.try_element_at(m, w), w)), " "),
        )
    from parlance.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(segments.sparkSession)
    # the row id must not change between its two uses
    rows = segments.withColumn("_row", F.monotonically_increasing_id()).checkpoint(eager=True)
    words = rows.select("_row", F.explode(F.array_distinct(F.split(F.col(text), " ", -1))).alias("_w"))
    terms = vocab.where("term is not null and preferred is not null").groupBy(F.col("term").alias("_w")).agg(F.min("preferred").alias("_p"))
    known = words.join(terms, "_w").groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("_w", "_p"))).alias("_m"))
    word = lambda w: F.coalesce(F.try_element_at("_m", w), w)
    out = F.array_join(F.transform(F.split(F.col(text), " ", -1), word), " ")
    return rows.join(known, "_row", "left").withColumn("text_out", out).drop("_row", "_m")


def language_counts(docs: DataFrame, *, lang: str = "lang") -> DataFrame:
    """RM-6: documents, characters and words per language."""
    from parlance.functions.text import word_count

    return docs.groupBy(lang).agg(
        F.count(F.lit(1)).cast("bigint").alias("n_docs"),
        F.sum("n_chars").cast("bigint").alias("n_chars"),
        F.sum(word_count("text")).cast("bigint").alias("n_words"),
    )
