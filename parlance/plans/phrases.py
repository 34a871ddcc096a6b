"""Queries: entities_phrases, apply_vocabulary_phrases.

Stand-in for tables of phrases: runs of one to three consecutive words of every ``benchmark`` item.
Runs overlap, and one phrase stands in several items, under several categories and preferred forms.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.operators.phrases import WORD, apply_vocabulary_phrases, entities_from_phrases
from parlance.plans.registry import query
from parlance.schemas import ENTITY_CATEGORIES
from parlance.sources.tables import spread, table

# (item, first word, words) -> phrase: all pairs, every third triple, and every fifth word alone if it is long
_PHRASES_SQL = rf"""w AS (SELECT item_id, regexp_extract_all(lower(text), '{WORD}') AS ws FROM benchmark),
runs AS (SELECT item_id, i, n, array_to_string(ws[i + 1 : i + n], ' ') AS phrase
  FROM (SELECT *, unnest(range(0, len(ws))) AS i FROM w) CROSS JOIN (VALUES (1), (2), (3)) AS k(n)
  WHERE i + n <= len(ws) AND (n = 2 OR (n = 3 AND i % 3 = 0) OR (n = 1 AND i % 5 = 0 AND length(ws[i + 1]) >= 6)))"""


def _matches_sql(source: str, keys: str) -> str:
    """Leftmost-longest matches m(<keys>, place, n, phrase, payload) of phrases p(phrase, payload) in ``source`` (<keys>, text)."""
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    cols = ", ".join(f"a.{k}" for k in keys.split(", "))
    return rf"""t AS (SELECT {keys}, regexp_extract_all(lower(text), '{WORD}') AS ws FROM {source}),
g AS (SELECT {keys}, i, n, array_to_string(ws[i + 1 : i + n], ' ') AS phrase
  FROM (SELECT *, unnest(range(0, len(ws))) AS i FROM t) CROSS JOIN (VALUES (1), (2), (3)) AS k(n) WHERE i + n <= len(ws)),
c AS (SELECT {keys}, i, max(n) AS n, arg_max(phrase, n) AS phrase, arg_max(payload, n) AS payload FROM g JOIN p USING (phrase) GROUP BY {keys}, i),
s AS (SELECT *, row_number() OVER (ORDER BY {keys}, i) AS r FROM c),
nxt AS (SELECT {cols}, a.i, a.n, a.phrase, a.payload, a.r,
   (CASE WHEN b1.i >= a.i + a.n THEN b1.r WHEN b2.i >= a.i + a.n THEN b2.r WHEN b3.i >= a.i + a.n THEN b3.r END) AS next_r
  FROM s a LEFT JOIN s b1 ON b1.r = a.r + 1 AND {on.replace('b.', 'b1.')} LEFT JOIN s b2 ON b2.r = a.r + 2 AND {on.replace('b.', 'b2.')}
  LEFT JOIN s b3 ON b3.r = a.r + 3 AND {on.replace('b.', 'b3.')}),
walk AS (SELECT min(r) AS r FROM s GROUP BY {keys} UNION ALL SELECT next_r FROM walk JOIN nxt USING (r) WHERE next_r IS NOT NULL),
m AS (SELECT {keys}, i AS place, n, phrase, payload FROM nxt WHERE r IN (SELECT r FROM walk))"""


def _phrases(spark, sf_dir):
    words = table(spark, sf_dir, "benchmark").select("item_id", F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)).alias("ws"))
    each = words.select("item_id", "ws", F.posexplode("ws").alias("i", "w"))
    i, m = F.col("i"), F.size("ws")
    runs = each.select("item_id", "i", "ws", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("n"))
    n = F.col("n")
    wanted = (n == 2) | ((n == 3) & (i % 3 == 0)) | ((n == 1) & (i % 5 == 0) & (F.length(F.get("ws", i)) >= 6))
    return runs.where((i + n <= m) & wanted).select("item_id", "i", "n", F.array_join(F.slice("ws", i + 1, n), " ").alias("term"))


_CATS_SQL = "[" + ", ".join(f"'{c}'" for c in ENTITY_CATEGORIES) + "]"


@query(
    "entities_phrases",
    rf"""WITH RECURSIVE {_PHRASES_SQL},
p AS (SELECT phrase, min((item_id + i) % 14) AS payload FROM runs GROUP BY phrase),
{_matches_sql("documents", "doc_id")},
f AS (SELECT doc_id, phrase, payload, min(place) AS place, min(n) AS n FROM m GROUP BY ALL),
v AS (SELECT f.*, regexp_extract_all(text, '{WORD}') AS ws FROM f JOIN documents USING (doc_id))
SELECT doc_id, {_CATS_SQL}[payload + 1] AS category, payload::INTEGER AS cat_pos,
       (row_number() OVER (PARTITION BY doc_id, payload ORDER BY place) - 1)::BIGINT AS pos, array_to_string(ws[place + 1 : place + n], ' ') AS words
FROM v""",
)
def q_entities_phrases(spark, sf_dir):
    """UDF-3 by phrases over all documents.  ``words`` is the value with its words set apart by one space."""
    names = F.array(*[F.lit(c) for c in ENTITY_CATEGORIES])
    gazetteer = _phrases(spark, sf_dir).select("term", F.get(names, ((F.col("item_id") + F.col("i")) % 14).cast("int")).alias("category"))
    docs = spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("transcript_id"), "text"), "transcript_id")
    out = entities_from_phrases(docs, gazetteer)
    words = F.array_join(F.regexp_extract_all("value", F.lit(WORD), F.lit(0)), " ")
    return out.select(F.col("transcript_id").alias("doc_id"), "category", "cat_pos", "pos", words.alias("words"))


@query(
    "apply_vocabulary_phrases",
    rf"""WITH RECURSIVE {_PHRASES_SQL},
p AS (SELECT phrase, min('<' || n || ':' || i || '>') AS payload FROM runs GROUP BY phrase),
{_matches_sql("conversations", "conv_id, turn")},
x AS (SELECT conv_id, turn, text, regexp_extract_all(text, '{WORD}') AS ws, regexp_split_to_array(text, '{WORD}') AS gaps FROM conversations),
y AS (SELECT conv_id, turn, unnest(range(0, len(ws))) AS i, ws, gaps FROM x),
z AS (SELECT y.conv_id, y.turn, y.i, CASE WHEN m.place = y.i THEN y.gaps[y.i + 1] || m.payload WHEN m.place IS NULL THEN y.gaps[y.i + 1] || y.ws[y.i + 1] ELSE '' END AS piece
      FROM y LEFT JOIN m ON m.conv_id = y.conv_id AND m.turn = y.turn AND y.i >= m.place AND y.i < m.place + m.n)
SELECT x.conv_id, x.turn, coalesce(string_agg(piece, '' ORDER BY i), '') || any_value(gaps[len(ws) + 1]) AS text_out,
       (SELECT count(*) FROM m WHERE m.conv_id = x.conv_id AND m.turn = x.turn)::BIGINT AS n_replaced
FROM x LEFT JOIN z USING (conv_id, turn) GROUP BY x.conv_id, x.turn""",
)
def q_apply_vocabulary_phrases(spark, sf_dir):
    """RM-5 by phrases over all turns of ``conversations``."""
    vocab = _phrases(spark, sf_dir).select("term", F.concat(F.lit("<"), "n", F.lit(":"), "i", F.lit(">")).alias("preferred"))
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return apply_vocabulary_phrases(conv, vocab).select("conv_id", "turn", "text_out", "n_replaced")
