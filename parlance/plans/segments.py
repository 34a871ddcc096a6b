"""Queries: segment_text, segment_view, resolve_speakers, speaker_cap.

Stand-in for ``segment_text``: ``events`` per user is one transcript; each
``signup`` starts a speaker segment that ends at the user's next signup (so the
next signup's own item sits on a shared boundary and lands in both segments),
or one day later for the last one.  Every event is an item: ``error`` events are
punctuation ``.``, the others are words named after their type, and ``click``
events with ``value < 10`` carry no start time (dropped, like untimed items).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions.times import epoch_seconds, hms, js_parse_float
from parlance.operators.ordered import with_next
from parlance.operators.segments import resolve_speakers, segment_text, speaker_cap
from parlance.operators.speakers import infer_speakers
from parlance.plans.registry import query
from parlance.sources.tables import conversation_segments, spread, table

DAY_S = 86400.0


def event_segments_items(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("transcript_id"), "event_id", "event_type", "value", epoch_seconds("ts").alias("t")
    )
    signups = ev.where(F.col("event_type") == "signup").select(
        "transcript_id", F.col("event_id").alias("seg_no"), F.col("t").alias("start_s")
    )
    signups = with_next(signups, "transcript_id", "start_s", ["start_s"])
    # one row per signup: written once, since the bin plan and the join both read it
    segments = signups.select(
        "transcript_id", "seg_no", "start_s",
        F.coalesce("next_start_s", F.col("start_s") + F.lit(DAY_S)).alias("end_s"),
    ).checkpoint(eager=True)
    items = ev.select(
        "transcript_id",
        F.col("event_id").alias("item_no"),
        F.when((F.col("event_type") == "click") & (F.col("value") < 10), F.lit(None).cast("double"))
        .otherwise(F.col("t")).alias("start_s"),
        F.when(F.col("event_type") == "error", "punctuation").otherwise("pronunciation").alias("type"),
        F.when(F.col("event_type") == "error", ".").otherwise(F.col("event_type")).alias("content"),
    )
    return segments, items


SEGMENT_TEXT_SQL = """
WITH ev AS (
  SELECT user_id, event_id, event_type, value, epoch_us(ts) / 1e6 AS t FROM events
), seg AS (
  SELECT user_id, event_id AS seg_no, t AS start_s,
         coalesce(lead(t) OVER (PARTITION BY user_id ORDER BY t), t + 86400.0) AS end_s
  FROM ev WHERE event_type = 'signup'
), it AS (
  SELECT user_id, event_id AS item_no,
         CASE WHEN event_type = 'click' AND value < 10 THEN NULL ELSE t END AS start_s,
         CASE WHEN event_type = 'error' THEN 'punctuation' ELSE 'pronunciation' END AS type,
         CASE WHEN event_type = 'error' THEN '.' ELSE event_type END AS content
  FROM ev
)
SELECT s.user_id, s.seg_no, s.start_s, s.end_s,
       coalesce(string_agg(i.content, ' ' ORDER BY i.item_no), '') AS text,
       count(i.item_no)::BIGINT AS n_tokens
FROM seg s LEFT JOIN it i
  ON i.user_id = s.user_id AND i.start_s >= s.start_s AND i.start_s <= s.end_s
 AND i.type IN ('pronunciation', 'punctuation')
GROUP BY ALL
"""


@query("segment_text", SEGMENT_TEXT_SQL)
def q_segment_text(spark, sf_dir):
    segments, items = event_segments_items(spark, sf_dir)
    out = segment_text(segments, items)
    return out.select(F.col("transcript_id").alias("user_id"), "seg_no", "start_s", "end_s", "text", "n_tokens")


@query(
    "segment_view",
    """SELECT l_orderkey, l_linenumber,
       printf('[%02d:%02d:%02d]', floor(l_extendedprice / 3600)::BIGINT,
              floor(fmod(l_extendedprice, 3600) / 60)::BIGINT, floor(fmod(l_extendedprice, 60))::BIGINT) AS hms
FROM lineitem""",
)
def q_segment_view(spark, sf_dir):
    """SCL-5/6 over every lineitem: the price, written out as a timestamp string and
    parsed back with the lenient prefix parser, is formatted as ``[HH:MM:SS]``."""
    li = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_orderkey")
    ts = js_parse_float(F.col("l_extendedprice").cast("string"))
    return li.select("l_orderkey", "l_linenumber", hms(ts).alias("hms"))


# speaker names known for some labels; 'system' has none and keeps its label
SPEAKER_NAMES_SQL = "SELECT * FROM (VALUES ('user', 'Counsel'), ('assistant', 'Witness')) AS m(speaker_label, name)"


@query(
    "resolve_speakers",
    f"""WITH m AS ({SPEAKER_NAMES_SQL})
SELECT c.conv_id, c.turn, coalesce(m.name, c.role) AS speaker_name
FROM conversations c LEFT JOIN m ON m.speaker_label = c.role""",
)
def q_resolve_speakers(spark, sf_dir):
    segs = conversation_segments(spark, sf_dir)
    # one global map of fixed size (two rows), so it is broadcast
    names = spark.createDataFrame([("user", "Counsel"), ("assistant", "Witness")], "speaker_label string, name string")
    out = resolve_speakers(segs, F.broadcast(names))
    return out.select(F.col("transcript_id").alias("conv_id"), F.col("seg_no").alias("turn"), "speaker_name")


@query(
    "speaker_cap",
    """SELECT conv_id, count(DISTINCT role)::BIGINT AS n_speakers, count(DISTINCT role) <= 2 AS within_cap
FROM conversations GROUP BY conv_id""",
)
def q_speaker_cap(spark, sf_dir):
    out = speaker_cap(conversation_segments(spark, sf_dir), cap=2)
    return out.select(F.col("transcript_id").alias("conv_id"), "n_speakers", "within_cap")


# stand-in evidence: the first capitalised word of a turn names its speaker, one before a comma the next
# speaker, one that ends a sentence the previous one
EVIDENCE = (("self", "^([A-Z][a-z]+)", 3), ("next", "([A-Z][a-z]+), ", 2), ("previous", "([A-Z][a-z]+)[.]", 1))


@query(
    "infer_speakers",
    """WITH RECURSIVE s AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS nx, lag(role) OVER w AS pv FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
e AS (SELECT conv_id, role AS label, unnest(regexp_extract_all(text, '^([A-Z][a-z]+)', 1)) AS name, 3 AS weight FROM s
  UNION ALL SELECT conv_id, nx, unnest(regexp_extract_all(text, '([A-Z][a-z]+), ', 1)), 2 FROM s WHERE nx <> role
  UNION ALL SELECT conv_id, pv, unnest(regexp_extract_all(text, '([A-Z][a-z]+)[.]', 1)), 1 FROM s WHERE pv <> role),
p AS (SELECT conv_id, label, name, sum(weight)::BIGINT AS score FROM e GROUP BY ALL),
c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, label, name) AS k FROM p),
g AS (SELECT conv_id, 1::BIGINT AS k, [label] AS labels, [name] AS names, label, name, score, true AS taken FROM c WHERE k = 1
  UNION ALL
  SELECT c.conv_id, c.k, CASE WHEN f THEN list_append(labels, c.label) ELSE labels END, CASE WHEN f THEN list_append(names, c.name) ELSE names END, c.label, c.name, c.score, f
  FROM (SELECT c.*, g.labels, g.names, NOT list_contains(g.labels, c.label) AND NOT list_contains(g.names, c.name) AS f
        FROM g JOIN c ON c.conv_id = g.conv_id AND c.k = g.k + 1) c),
m AS (SELECT conv_id, label, name, score FROM g WHERE taken)
SELECT s.conv_id, s.turn, s.role, coalesce(m.name, s.role) AS speaker_name, m.score
FROM s LEFT JOIN m ON m.conv_id = s.conv_id AND m.label = s.role""",
)
def q_infer_speakers(spark, sf_dir):
    """JOIN-5 with names from the texts: evidence per conversation and role, one name per role, joined to every turn."""
    segs = conversation_segments(spark, sf_dir)
    names = infer_speakers(segs, EVIDENCE)
    out = resolve_speakers(segs, names)
    scores = names.select("transcript_id", F.col("speaker_label").alias("speaker"), "score")
    return out.join(scores, ["transcript_id", "speaker"], "left").select(
        F.col("transcript_id").alias("conv_id"), F.col("seg_no").alias("turn"), F.col("speaker").alias("role"), "speaker_name", "score"
    )
