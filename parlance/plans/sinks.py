"""Queries: raw_transcript_read, sink_roundtrip, store_validation, start_records,
enhance_raw_transcripts, pipeline_status, transcript_segment_rows.

``raw_transcript_read`` writes the ``events`` table as raw transcripts (JSON
lines, one transcript per user and block of 100 event ids: signups are speaker
segments 600 s long, every event an item) to the shared checkpoint folder, reads
them back with the D4 schema and runs the interval join on them.
``sink_roundtrip`` writes ``conversations`` as enhanced transcripts to the
partitioned result table in two batches, writes one partition again and reads the
table back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions.times import epoch_seconds
from parlance.operators.segments import parsed_once, raw_segments_and_items, segment_text
from parlance.plans.registry import query
from parlance.schemas import SEGMENT_STRUCT
from parlance.sinks.results import export_json, store_validation, with_lineage, write_results
from parlance.sinks.store import ResultStore
from parlance.sources.tables import table
from parlance.sources.transcripts import read_enhanced, read_job_events, read_raw_transcripts
from parlance.streaming.flows import scratch_path

SEG_LEN_S = 600.0


def _raw_docs(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", "value", epoch_seconds("ts").alias("t")
    )
    ev = ev.withColumn("doc", F.floor(F.col("event_id") / 100))
    t_str = F.col("t").cast("string")
    seg = F.when(
        F.col("event_type") == "signup",
        F.struct(
            t_str.alias("start_time"),
            (F.col("t") + F.lit(SEG_LEN_S)).cast("string").alias("end_time"),
            F.concat(F.lit("spk_"), (F.col("event_id") % 3).cast("string")).alias("speaker_label"),
        ),
    )
    content = F.when(F.col("event_type") == "error", F.lit(".")).otherwise(F.col("event_type"))
    item = F.struct(
        F.when((F.col("event_type") == "click") & (F.col("value") < 10), F.lit(None).cast("string"))
        .otherwise(t_str).alias("start_time"),
        F.lit(None).cast("string").alias("end_time"),
        F.when(F.col("event_type") == "error", "punctuation").otherwise("pronunciation").alias("type"),
        F.when((F.col("event_type") == "purchase") & (F.col("value") < 5),
               F.array().cast("array<struct<content:string>>"))
        .otherwise(F.array(F.struct(content.alias("content")))).alias("alternatives"),
    )
    # a document holds at most 100 events (one block of event ids of one user)
    docs = ev.groupBy("user_id", "doc").agg(
        F.array_sort(F.collect_list(F.struct("event_id", seg.alias("s"), item.alias("i")))).alias("rows")
    )
    return docs.select(
        F.concat(F.lit("stt-u"), F.col("user_id").cast("string"), F.lit("-"), F.col("doc").cast("string")).alias("jobName"),
        F.struct(
            F.struct(F.filter(F.transform("rows", lambda r: r["s"]), lambda s: s.isNotNull()).alias("segments")).alias(
                "speaker_labels"
            ),
            F.transform("rows", lambda r: r["i"]).alias("items"),
        ).alias("results"),
    )


RAW_SQL = f"""
WITH ev AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) / 1e6 AS t,
                   'stt-u' || user_id || '-' || (event_id // 100) AS transcript_id FROM events),
seg AS (SELECT transcript_id, t AS s, t + {SEG_LEN_S} AS e FROM ev WHERE event_type = 'signup'),
it AS (SELECT transcript_id, event_id,
              CASE WHEN event_type = 'click' AND value < 10 THEN NULL ELSE t END AS t,
              NOT (event_type = 'purchase' AND value < 5) AS has_alt FROM ev),
words AS (SELECT seg.transcript_id, count(it.event_id) AS n
          FROM seg JOIN it ON it.transcript_id = seg.transcript_id AND it.t >= seg.s AND it.t <= seg.e AND it.has_alt
          GROUP BY seg.transcript_id)
SELECT ev.transcript_id,
       count(*) FILTER (WHERE event_type = 'signup')::BIGINT AS n_segments,
       count(*)::BIGINT AS n_items,
       count(*) FILTER (WHERE NOT (event_type = 'click' AND value < 10))::BIGINT AS n_timed_items,
       count(*) FILTER (WHERE event_type = 'purchase' AND value < 5)::BIGINT AS n_rejected_items,
       coalesce(any_value(words.n), 0)::BIGINT AS n_words
FROM ev LEFT JOIN words USING (transcript_id)
GROUP BY ev.transcript_id"""


@query("raw_transcript_read", RAW_SQL)
def q_raw_transcript_read(spark, sf_dir):
    path = scratch_path(spark, "raw_transcripts")
    _raw_docs(spark, sf_dir).write.mode("overwrite").json(path)
    raw = parsed_once(read_raw_transcripts(spark, path, multi_line=False))
    segs, items = raw_segments_and_items(raw)
    texts = segment_text(segs.select("transcript_id", "seg_no", "start_s", "end_s"), items)
    words = texts.groupBy("transcript_id").agg(F.sum("n_tokens").cast("bigint").alias("n_words"))
    seg_counts = segs.groupBy("transcript_id").agg(F.count(F.lit(1)).cast("bigint").alias("n_segments"))
    item_counts = items.groupBy("transcript_id").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_items"),
        F.count_if(F.col("start_s").isNotNull()).cast("bigint").alias("n_timed_items"),
        F.count_if(F.col("reject_reason").isNotNull()).cast("bigint").alias("n_rejected_items"),
    )
    out = item_counts.join(seg_counts, "transcript_id", "left").join(words, "transcript_id", "left")
    return out.select(
        "transcript_id",
        F.coalesce("n_segments", F.lit(0).cast("bigint")).alias("n_segments"),
        "n_items", "n_timed_items", "n_rejected_items",
        F.coalesce("n_words", F.lit(0).cast("bigint")).alias("n_words"),
    )


def _enhanced_from_conversations(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    seg = F.struct(
        F.col("turn").alias("_o"),
        F.col("turn").cast("string").alias("timestamp"),
        F.col("role").alias("speaker"),
        F.col("text").alias("text"),
    )
    per = conv.groupBy("conv_id").agg(F.array_sort(F.collect_list(seg)).alias("_s"))
    segs = F.transform("_s", lambda x: F.struct(x["timestamp"].alias("timestamp"), x["speaker"].alias("speaker"),
                                                x["text"].alias("text")))
    out = per.select(
        "conv_id",
        F.array_join(F.transform("_s", lambda x: x["text"]), " ").alias("transcript"),
        segs.alias("segments"),
        F.create_map().cast("map<string,array<string>>").alias("entities"),
        # two conversations share a job name, in different buckets
        F.concat(F.lit("results-"), F.col("conv_id") % 2).alias("bucket"),
        F.concat(F.lit("stt-c"), F.floor(F.col("conv_id") / 2), F.lit(".json")).alias("job_key"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 4).cast("int")).alias("ingest_date"),
    )
    return with_lineage(out).drop("bucket", "job_key")


ROUNDTRIP_SQL = """SELECT conv_id, DATE '2024-01-01' + (conv_id % 4)::INT AS ingest_date, count(*)::BIGINT AS n_segments,
       length(string_agg(text, ' ' ORDER BY turn))::BIGINT AS transcript_chars,
       'results-' || conv_id % 2 AS result_bucket, 'stt-c' || conv_id // 2 || '_enhanced.json' AS output_key, NULL::VARCHAR AS reject_reason
FROM conversations GROUP BY conv_id"""


def _stored(results):
    return store_validation(results).select(
        "result_bucket", "conv_id", "ingest_date", F.size("segments").cast("bigint").alias("n_segments"),
        F.length("transcript").cast("bigint").alias("transcript_chars"), "output_key", "reject_reason",
    )


@query("sink_roundtrip", ROUNDTRIP_SQL)
def q_sink_roundtrip(spark, sf_dir):
    """Equal job names in two buckets, named batches beside unnamed ones of the same days, a batch written again,
    and drafts that a later unnamed batch replaces: every conversation comes back once, as last written."""
    path = scratch_path(spark, "enhanced")
    enhanced = _enhanced_from_conversations(spark, sf_dir)
    third = F.col("conv_id") % 3
    write_results(enhanced.where(third == 0), path, batch="0001")
    write_results(enhanced.where(third > 0).withColumn("transcript", F.lit("draft")), path)
    write_results(enhanced.where(third == 1), path)
    write_results(enhanced.where(third == 2), path)
    write_results(enhanced.where((third == 0) & (F.col("ingest_date") == F.lit("2024-01-01").cast("date"))), path, batch="0001")
    return _stored(read_enhanced(spark, path))


@query(
    "enhanced_json_read",
    """SELECT 'results-' || conv_id % 2 AS result_bucket, 'stt-c' || conv_id // 2 || '_enhanced.json' AS result_key,
       count(*)::BIGINT AS n_segments, string_agg(text, ' ' ORDER BY turn) AS transcript, min(role) AS first_role
FROM conversations GROUP BY conv_id""",
)
def q_enhanced_json_read(spark, sf_dir):
    """SRC-6: every enhanced document exported as a line of JSON and read back with the D10 schema."""
    path = scratch_path(spark, "export")
    export_json(_enhanced_from_conversations(spark, sf_dir), path)
    back = read_enhanced(spark, path, fmt="json", multi_line=False, glob=None)
    return back.select("result_bucket", "result_key", F.size("segments").cast("bigint").alias("n_segments"), "transcript", F.array_min(F.col("segments.speaker")).alias("first_role"))


@query("results_compacted", ROUNDTRIP_SQL)
def q_results_compacted(spark, sf_dir):
    """The same rows through a store that is compacted between and after the writes, once over a base."""
    store = ResultStore(spark, scratch_path(spark, "store"))
    enhanced = _enhanced_from_conversations(spark, sf_dir)
    third = F.col("conv_id") % 3
    store.write(enhanced.where(third < 2).withColumn("transcript", F.lit("draft")))
    store.write(enhanced.where(third == 0), batch="0001")
    store.write(enhanced.where(third == 2), batch="0002")
    store.compact(ranges=4)
    store.write(enhanced.where(third < 2))
    store.compact()
    store.vacuum()
    return _stored(store.read())


@query(
    "store_validation",
    """SELECT d.doc_id,
       CASE WHEN d.text IS NULL OR d.text = '' THEN 'missing_transcript'
            WHEN l.doc_id IS NULL THEN 'missing_segments'
            WHEN d.lang = 'es' OR d.source IS NULL OR d.source = '' THEN 'missing_location' END AS reject_reason,
       CASE WHEN NOT (d.text IS NULL OR d.text = '') AND l.doc_id IS NOT NULL
                 AND NOT (d.lang = 'es' OR d.source IS NULL OR d.source = '')
            THEN 'stt-d' || d.doc_id || '_enhanced.json' END AS output_key
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
)
def q_store_validation(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("_labelled"))
    seg = F.struct(F.lit("0").alias("timestamp"), F.lit("spk_0").alias("speaker"), F.col("text").alias("text"))
    rows = docs.join(labels, "doc_id", "left").select(
        "doc_id",
        F.col("text").alias("transcript"),
        F.when(F.col("_labelled"), F.array(seg)).otherwise(F.array().cast(f"array<{SEGMENT_STRUCT}>")).alias("segments"),
        F.struct(
            F.when(F.col("lang") == "es", F.lit(None).cast("string")).otherwise(F.col("source")).alias(
                "transcriptionOutputBucket"
            ),
            F.concat(F.lit("stt-d"), F.col("doc_id").cast("string"), F.lit(".json")).alias("transcriptionJobName"),
        ).alias("s3"),
    )
    return store_validation(rows).select("doc_id", "reject_reason", "output_key")


RAW_BUDGET = 3


def _raw_enhance_oracle() -> str:
    from parlance.functions.text import WS
    from parlance.operators.entities import DEFAULT_CATALOGUE

    n_ent = " + ".join(f"len(list_distinct(regexp_extract_all(transcript, '{rx}')))" for _, rx in DEFAULT_CATALOGUE)
    b = RAW_BUDGET
    return f"""
WITH RECURSIVE ev AS (
  SELECT event_id, user_id, event_type, value, epoch_us(ts) / 1e6 AS t,
         'stt-u' || user_id || '-' || (event_id // 100) AS transcript_id FROM events
), seg AS (
  SELECT transcript_id, event_id, t AS s, t + {SEG_LEN_S} AS e,
         (row_number() OVER (PARTITION BY transcript_id ORDER BY event_id) - 1)::BIGINT AS seg_no
  FROM ev WHERE event_type = 'signup'
), it AS (
  SELECT transcript_id, event_id, t,
         CASE WHEN event_type = 'error' THEN '.' ELSE event_type END AS content
  FROM ev WHERE NOT (event_type = 'click' AND value < 10) AND NOT (event_type = 'purchase' AND value < 5)
), st AS (
  SELECT seg.transcript_id, seg.seg_no,
         coalesce(string_agg(it.content, ' ' ORDER BY it.event_id), '') AS text, count(it.event_id)::BIGINT AS n_tokens
  FROM seg LEFT JOIN it ON it.transcript_id = seg.transcript_id AND it.t >= seg.s AND it.t <= seg.e
  GROUP BY seg.transcript_id, seg.seg_no
), r AS (
  SELECT transcript_id, seg_no, CASE WHEN n_tokens > {b} THEN 1 ELSE 0 END::BIGINT AS chunk_no, n_tokens AS cur
  FROM st WHERE seg_no = 0
  UNION ALL
  SELECT st.transcript_id, st.seg_no,
         CASE WHEN r.cur + st.n_tokens > {b} THEN r.chunk_no + 1 ELSE r.chunk_no END,
         CASE WHEN r.cur + st.n_tokens > {b} THEN st.n_tokens ELSE r.cur + st.n_tokens END
  FROM r JOIN st ON st.transcript_id = r.transcript_id AND st.seg_no = r.seg_no + 1
), t AS (
  SELECT r.transcript_id,
         regexp_replace(string_agg(st.text, ' ' ORDER BY r.seg_no), '^{WS}|{WS}$', '', 'g') AS transcript,
         count(*)::BIGINT AS n_segments, count(DISTINCT r.chunk_no)::BIGINT AS n_chunks
  FROM r JOIN st USING (transcript_id, seg_no) GROUP BY r.transcript_id
), docs AS (
SELECT a.transcript_id, t.transcript, t.n_segments, coalesce(t.n_chunks, 0)::BIGINT AS n_chunks,
       CASE WHEN t.transcript_id IS NULL THEN 'FAILED' ELSE 'OK' END AS status,
       CASE WHEN t.transcript_id IS NULL THEN 0 ELSE {n_ent} END::BIGINT AS n_entities,
       CASE WHEN t.transcript IS NULL OR t.transcript = '' THEN 'missing_transcript' END AS reject_reason,
       CASE WHEN t.transcript <> '' THEN a.transcript_id || '_enhanced.json' END AS output_key
FROM (SELECT DISTINCT transcript_id FROM ev) a LEFT JOIN t USING (transcript_id))"""


def _raw_enhanced(spark, sf_dir):
    """Entry point A from raw transcripts: JSON read (SRC-3) -> interval join and
    segment text (JOIN-1, AGG-1) -> packing (budget 3) -> echo model -> cleaning
    -> recombination -> entities -> store validation; one row per raw transcript."""
    from parlance.operators.enhance import enhance

    path = scratch_path(spark, "raw_transcripts")
    _raw_docs(spark, sf_dir).write.mode("overwrite").json(path)
    raw = parsed_once(read_raw_transcripts(spark, path, multi_line=False))
    segs, items = raw_segments_and_items(raw)
    texts = segment_text(segs.select("transcript_id", "seg_no", "timestamp", "speaker", "start_s", "end_s", "reject_reason"), items)
    places = raw.select("transcript_id", F.concat(F.lit("media-"), F.pmod(F.crc32("transcript_id"), F.lit(2))).alias("bucket"), F.concat("transcript_id", F.lit(".json")).alias("job_key"))
    return enhance(texts.select("transcript_id", "seg_no", "timestamp", "speaker", "text", "reject_reason"), transcripts=places, budget=RAW_BUDGET)


@query("enhance_raw_transcripts", _raw_enhance_oracle() + " SELECT * FROM docs")
def q_enhance_raw_transcripts(spark, sf_dir):
    n_ent = F.aggregate(F.map_values("entities"), F.lit(0), lambda acc, v: acc + F.size(v)).cast("bigint")
    return _raw_enhanced(spark, sf_dir).select(
        "transcript_id", "transcript", F.when(F.col("segments").isNotNull(), F.size("segments")).cast("bigint").alias("n_segments"), "n_chunks", "status",
        n_ent.alias("n_entities"), "reject_reason", "output_key",
    )


@query(
    "pipeline_status",
    _raw_enhance_oracle()
    + """
SELECT transcript_id, CASE WHEN output_key IS NULL THEN 500 ELSE 200 END AS http_code,
       CASE WHEN output_key IS NULL THEN 'FAILED' ELSE 'COMPLETED' END AS status, output_key AS result_key,
       CASE WHEN output_key IS NOT NULL THEN transcript END AS transcript,
       CASE WHEN output_key IS NOT NULL THEN n_segments END AS n_segments,
       CASE WHEN output_key IS NOT NULL THEN n_entities END AS n_entities
FROM docs""",
)
def q_pipeline_status(spark, sf_dir):
    """Both entry points on one another: raw JSON -> enhance -> result table -> read by key -> status
    answers with the whole document, for every transcript.  Jobs write to two buckets."""
    from parlance.operators.jobs import status_report
    from parlance.operators.uploads import resolve_result_uri

    path = scratch_path(spark, "results")
    docs = _raw_enhanced(spark, sf_dir).withColumn("ingest_date", F.lit("2024-01-01").cast("date"))
    # beside every document another one under the same name, in a bucket that no job names
    both = docs.where(F.col("reject_reason").isNull()).withColumn("other", F.explode(F.array(F.lit(False), F.lit(True))))
    elsewhere = F.col("s3").withField("transcriptionOutputBucket", F.when(F.col("other"), "elsewhere").otherwise(F.col("s3.transcriptionOutputBucket")))
    write_results(both.withColumn("s3", elsewhere).withColumn("transcript", F.when(F.col("other"), "other").otherwise(F.col("transcript"))).drop("other"), path)
    results = read_enhanced(spark, path)
    ev = table(spark, sf_dir, "events").select(
        F.concat(F.lit("stt-u"), F.col("user_id").cast("string"), F.lit("-"), F.floor(F.col("event_id") / 100).cast("string")).alias("job_name")
    ).distinct()
    bucket = F.concat(F.lit("media-"), F.pmod(F.crc32("job_name"), F.lit(2)))
    latest = resolve_result_uri(
        ev.select("job_name", F.lit("COMPLETED").alias("status"), F.concat(F.lit("https://store.example.com/"), bucket, F.lit("/"), "job_name", F.lit(".json")).alias("uri")), "uri"
    ).select("job_name", "status", "uri", "result_bucket", "result_key")
    report = status_report(ev.select(F.substr("job_name", F.lit(5)).alias("file_name")), latest, results)
    n_ent = F.aggregate(F.map_values("result.entities"), F.lit(0), lambda acc, v: acc + F.size(v)).cast("bigint")
    return report.select(
        F.concat(F.lit("stt-"), "file_name").alias("transcript_id"), "http_code", "status",
        F.replace(F.col("result.s3.transcriptionJobName"), F.lit(".json"), F.lit("_enhanced.json")).alias("result_key"),
        F.col("result.transcript").alias("transcript"), F.when(F.col("has_result"), F.size("result.segments")).cast("bigint").alias("n_segments"),
        F.when(F.col("has_result"), n_ent).alias("n_entities"),
    )


@query(
    "start_records",
    """SELECT 'stt-o' || o_custkey AS job_name, 'QUEUED' AS status, count(*)::BIGINT AS n_events, max(o_orderkey) AS last_event
FROM orders GROUP BY o_custkey""",
)
def q_start_records(spark, sf_dir):
    """SNK-2 -> SRC-5 -> AGG-7: every order is a submission (upload id = order key); start records
    are appended in two writes, read back as the job log and reduced to the latest state per job."""
    from parlance.operators.jobs import latest_job_status
    from parlance.sinks.results import write_start_records

    path = scratch_path(spark, "job_events")
    orders = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("stt-o"), F.col("o_custkey").cast("string")).alias("job_name"), F.col("o_orderkey").cast("bigint").alias("event_id")
    )
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    even = F.col("event_id") % 2 == 0
    write_start_records(orders.where(even), path, ts=at)
    write_start_records(orders.where(~even), path, ts=at)
    events = read_job_events(spark, path)
    latest = latest_job_status(events).select("job_name", "status", "n_events")
    return latest.join(events.groupBy("job_name").agg(F.max("event_id").alias("last_event")), "job_name")


@query(
    "transcript_segment_rows",
    """SELECT conv_id, turn AS seg_no,
       printf('[%02d:%02d:%02d]', turn // 3600, (turn % 3600) // 60, turn % 60) AS hms,
       role AS speaker, text
FROM conversations""",
)
def q_transcript_segment_rows(spark, sf_dir):
    """D10 documents (conversations) -> D14 display rows: ``posexplode`` of the
    segment list (ORD-1), the timestamp string formatted as ``[HH:MM:SS]``."""
    from parlance.operators.segments import segment_view

    docs = _enhanced_from_conversations(spark, sf_dir)
    segs = docs.select(F.col("conv_id").alias("transcript_id"), F.posexplode("segments").alias("seg_no", "s")).select(
        "transcript_id", F.col("seg_no").cast("bigint").alias("seg_no"), "s.timestamp", "s.speaker", "s.text"
    )
    return segment_view(segs).select(F.col("transcript_id").alias("conv_id"), "seg_no", "hms", "speaker", "text")
