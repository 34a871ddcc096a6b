"""Queries: entities_extract, entity_view, case_header, location_digits.

Stand-ins: ``documents.text`` for extraction.  For the views, ``customer`` rows
are entity mentions: transcripts of 32 consecutive customer keys, category
``c_custkey % 14`` in catalogue order (``VENUE``, unknown to the viewer, for
MACHINERY customers whose slot is JUDGE), value = customer name, or for LOCATION
a capitalised number word + the nation name.  ``part.p_size`` (1..50) drives
``location_digits``.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from parlance.operators.entities import (
    DEFAULT_CATALOGUE,
    case_header,
    entities_from_gazetteer,
    entities_from_map,
    entity_map,
    entity_view,
    extract_entities,
    words_to_digits,
)
from parlance.plans.registry import query
from parlance.schemas import (
    CATEGORY_COLORS,
    DEFAULT_COLOR,
    ENTITY_CATEGORIES,
    NUMBER_WORDS,
    PLURAL_LABELS,
)
from parlance.sources.tables import spread, table

WORDS_BY_NUMBER = [w for w, _ in sorted(NUMBER_WORDS.items(), key=lambda kv: int(kv[1]))]
NUMBER_WORDS_SQL = "(VALUES " + ", ".join(f"('{w}', '{d}', {d})" for w, d in NUMBER_WORDS.items()) + ") AS nw(word, digit, n)"
CATS_SQL = "(VALUES " + ", ".join(f"('{c}', {i})" for i, c in enumerate(ENTITY_CATEGORIES)) + ") AS cats(category, cat_pos)"


# ---------------------------------------------------------------------------
# entities_extract


def _extract_sql() -> str:
    parts = []
    categories = list(dict.fromkeys(cat for cat, _ in DEFAULT_CATALOGUE))
    for i, cat in enumerate(categories):
        vals = " || ".join(f"regexp_extract_all(text, '{rx}')" for c, rx in DEFAULT_CATALOGUE if c == cat)
        parts.append(f"SELECT doc_id, '{cat}' AS category, {i} AS cat_pos, {vals} AS vals FROM documents")
    return f"""WITH r AS ({' UNION ALL '.join(parts)}),
u AS (SELECT doc_id, category, cat_pos, unnest(vals) AS value, generate_subscripts(vals, 1) AS idx FROM r),
f AS (SELECT doc_id, category, cat_pos, value, min(idx) AS first_idx FROM u GROUP BY ALL)
SELECT doc_id, category, cat_pos,
       (row_number() OVER (PARTITION BY doc_id, category ORDER BY first_idx) - 1)::BIGINT AS pos, value
FROM f"""


@query("entities_extract", _extract_sql())
def q_entities_extract(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("transcript_id"), "text"), "transcript_id")
    out = extract_entities(docs)
    return out.select(F.col("transcript_id").alias("doc_id"), "category", "cat_pos", "pos", "value")


GAZETTEER_SQL = f"""gaz AS (
  SELECT term, CASE length(term) % 14 {' '.join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(ENTITY_CATEGORIES))} END AS category
  FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM benchmark) WHERE length(term) >= 4)"""


@query(
    "entities_gazetteer",
    f"""WITH {GAZETTEER_SQL},
w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS value,
             generate_subscripts(regexp_extract_all(text, '[A-Za-z]+'), 1) AS place FROM documents),
f AS (SELECT doc_id, lower(value) AS term, min(place) AS place, arg_min(value, place) AS value FROM w GROUP BY ALL)
SELECT doc_id, category, (row_number() OVER (PARTITION BY doc_id, category ORDER BY place) - 1)::BIGINT AS pos, value
FROM f JOIN gaz USING (term)""",
)
def q_entities_gazetteer(spark, sf_dir):
    """UDF-3 by lookup: words of ``benchmark`` of four letters or more, their category by length, over all documents."""
    terms = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("term")).distinct()
    names = F.array(*[F.lit(c) for c in ENTITY_CATEGORIES])
    gazetteer = terms.where(F.length("term") >= 4).select("term", F.get(names, F.length("term") % 14).alias("category"))
    docs = spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("transcript_id"), "text"), "transcript_id")
    out = entities_from_gazetteer(docs, gazetteer)
    return out.select(F.col("transcript_id").alias("doc_id"), "category", "pos", "value")


def judge_model_factory():
    """Deterministic stand-in for the entity model: the first word of a text is the judge, words of ten
    letters or more that begin with a capital are witnesses; a text with a bar gets no answer."""
    import json
    import re

    def model(texts: list[str]) -> list:
        out = []
        for t in texts:
            words = re.findall("[A-Za-z]+", t or "")
            found = {"JUDGE": words[:1], "WITNESS": list(dict.fromkeys(w for w in words if len(w) >= 10 and w[0].isupper()))}
            out.append(None if "|" in (t or "") else json.dumps({"entities": found}))
        return out

    return model


@query(
    "entities_model",
    """WITH t AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY conv_id),
w AS (SELECT conv_id, regexp_extract_all(text, '[A-Za-z]+') AS ws FROM t WHERE NOT contains(text, '|')),
u AS (SELECT conv_id, unnest(ws) AS value, generate_subscripts(ws, 1) AS place FROM w),
f AS (SELECT conv_id, value, min(place) AS place FROM u WHERE length(value) >= 10 AND regexp_matches(value, '^[A-Z]') GROUP BY ALL)
SELECT conv_id, 'OK' AS status, 'JUDGE' AS category, 0::BIGINT AS pos, ws[1] AS value FROM w WHERE len(ws) > 0
UNION ALL SELECT conv_id, 'OK', 'WITNESS', (row_number() OVER (PARTITION BY conv_id ORDER BY place) - 1)::BIGINT, value FROM f
UNION ALL SELECT conv_id, 'NER_FAILED', NULL, NULL, NULL FROM t WHERE contains(text, '|')""",
)
def q_entities_model(spark, sf_dir):
    """UDF-3 through the whole pipeline: ``enhance`` with an entity model, its entities in long form,
    and a row for every transcript the model failed on."""
    from parlance.operators.enhance import enhance
    from parlance.sources.tables import conversation_segments

    docs = enhance(conversation_segments(spark, sf_dir), entity_model=judge_model_factory, budget=60).checkpoint(eager=True)
    long = entities_from_map(docs).join(docs.select("transcript_id", "status"), "transcript_id")
    failed = docs.where("status = 'NER_FAILED'").select("transcript_id", "status")
    for c, kind in (("category", "string"), ("pos", "bigint"), ("value", "string")):
        failed = failed.withColumn(c, F.lit(None).cast(kind))
    out = long.select("transcript_id", "status", "category", "pos", "value").unionByName(failed)
    return out.withColumnRenamed("transcript_id", "conv_id")


# ---------------------------------------------------------------------------
# entity long table from customer


def _cap(c):
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substr(c, F.lit(2)))


def customer_entities(spark, sf_dir):
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    cats = F.array(*[F.lit(c) for c in ENTITY_CATEGORIES])
    words = F.array(*[F.lit(w) for w in WORDS_BY_NUMBER])
    slot = (F.col("c_custkey") % 14).cast("int")
    unknown = (F.col("c_mktsegment") == "MACHINERY") & (slot == 3)
    # nation has 25 rows at every scale factor: a fixed-size broadcast
    e = cust.join(F.broadcast(nation), cust.c_nationkey == nation.n_nationkey).select(
        F.floor(F.col("c_custkey") / 32).alias("transcript_id"),
        "c_custkey",
        F.when(unknown, F.lit("VENUE")).otherwise(F.element_at(cats, slot + 1)).alias("category"),
        F.when(unknown, F.lit(len(ENTITY_CATEGORIES))).otherwise(slot).alias("cat_pos"),
        F.when(
            slot == ENTITY_CATEGORIES.index("LOCATION"),
            F.concat(_cap(F.element_at(words, (F.col("c_nationkey") % 50 + 1).cast("int"))), F.lit(" "), F.col("n_name")),
        ).otherwise(F.col("c_name")).alias("value"),
    )
    # AGG-6: unique values, positions in first-appearance order (groups hold <= 32 rows)
    firsts = e.groupBy("transcript_id", "category", "cat_pos", "value").agg(F.min("c_custkey").alias("_first"))
    w = Window.partitionBy("transcript_id", "category").orderBy("_first")
    return firsts.select(
        "transcript_id", "category", "cat_pos", (F.row_number().over(w) - 1).cast("bigint").alias("pos"), "value"
    )


CUSTOMER_ENTITIES_SQL = f"""
e AS (
  SELECT c_custkey // 32 AS transcript_id, c_custkey,
         CASE WHEN c_mktsegment = 'MACHINERY' AND c_custkey % 14 = 3 THEN 'VENUE' ELSE cats.category END AS category,
         CASE WHEN c_mktsegment = 'MACHINERY' AND c_custkey % 14 = 3 THEN {len(ENTITY_CATEGORIES)} ELSE cats.cat_pos END AS cat_pos,
         CASE WHEN c_custkey % 14 = {ENTITY_CATEGORIES.index('LOCATION')}
              THEN upper(left(nw.word, 1)) || substr(nw.word, 2) || ' ' || n.n_name ELSE c_name END AS value
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN {CATS_SQL} ON cats.cat_pos = c.c_custkey % 14
  JOIN {NUMBER_WORDS_SQL} ON nw.n = c.c_nationkey % 50 + 1
), f AS (
  SELECT transcript_id, category, cat_pos, value, min(c_custkey) AS first FROM e GROUP BY ALL
), long AS (
  SELECT transcript_id, category, cat_pos, (row_number() OVER (PARTITION BY transcript_id, category ORDER BY first) - 1)::BIGINT AS pos, value
  FROM f
)"""

COLORS_SQL = "(VALUES " + ", ".join(f"('{c}', '{v}')" for c, v in CATEGORY_COLORS.items()) + ") AS col(category, color)"
PLURAL_SQL = "(VALUES " + ", ".join(f"('{c}', '{v}')" for c, v in PLURAL_LABELS.items()) + ") AS pl(category, plural)"


@query(
    "entity_view",
    f"""WITH {CUSTOMER_ENTITIES_SQL.strip()},
shown AS (SELECT * FROM long WHERE category NOT IN ('CASE_NUMBER', 'DATE')),
w AS (
  SELECT s.transcript_id, s.category, s.cat_pos, s.pos,
         CASE WHEN s.category = 'LOCATION' THEN string_agg(coalesce(nw.digit, t.w), ' ' ORDER BY t.i) ELSE s.value END AS value
  FROM shown s
  CROSS JOIN LATERAL (SELECT unnest(string_split(s.value, ' ')) AS w, generate_subscripts(string_split(s.value, ' '), 1) AS i) t
  LEFT JOIN {NUMBER_WORDS_SQL} ON nw.word = lower(t.w)
  GROUP BY s.transcript_id, s.category, s.cat_pos, s.pos, s.value
), g AS (
  SELECT transcript_id, category, cat_pos, string_agg(value, '|' ORDER BY pos) AS vals, count(*)::BIGINT AS n_values
  FROM w GROUP BY ALL
)
SELECT g.transcript_id, g.cat_pos, g.category,
       CASE WHEN g.n_values > 1 AND pl.plural IS NOT NULL THEN pl.plural
            WHEN g.category = 'LEGAL_TERM' THEN 'TERM' ELSE g.category END AS label,
       g.vals AS "values", g.n_values, coalesce(col.color, '{DEFAULT_COLOR}') AS color
FROM g LEFT JOIN {COLORS_SQL} ON col.category = g.category LEFT JOIN {PLURAL_SQL} ON pl.category = g.category""",
)
def q_entity_view(spark, sf_dir):
    view = entity_view(customer_entities(spark, sf_dir))
    return view.select(
        "transcript_id", "cat_pos", "category", "label", F.array_join("values", "|").alias("values"), "n_values", "color"
    )


@query(
    "case_header",
    f"""WITH {CUSTOMER_ENTITIES_SQL.strip()}
SELECT transcript_id,
       min_by(value, pos) FILTER (WHERE category = 'CASE_NUMBER') AS case_number,
       min_by(value, pos) FILTER (WHERE category = 'DATE') AS case_date,
       coalesce(string_agg(value, '|' ORDER BY pos) FILTER (WHERE category = 'PLAINTIFF'), '') AS plaintiffs,
       coalesce(string_agg(value, '|' ORDER BY pos) FILTER (WHERE category = 'DEFENDANT'), '') AS defendants,
       count(*) FILTER (WHERE category = 'CASE_NUMBER') = 0 AS missing_case_number
FROM long GROUP BY transcript_id""",
)
def q_case_header(spark, sf_dir):
    long = customer_entities(spark, sf_dir)
    hdr = case_header(long, transcripts=long.select("transcript_id"))
    return hdr.select(
        "transcript_id", "case_number", "case_date",
        F.array_join("plaintiffs", "|").alias("plaintiffs"), F.array_join("defendants", "|").alias("defendants"),
        "missing_case_number",
    )


LOCATION_SQL = """CASE p_partkey % 5
    WHEN 0 THEN word || ' ' || p_brand
    WHEN 1 THEN upper(word) || ' Main Street'
    WHEN 2 THEN upper(left(word, 1)) || substr(word, 2) || ', ' || p_type
    WHEN 3 THEN 'Suite ' || word
    ELSE word || '  ' || p_name END"""


@query(
    "location_digits",
    f"""WITH p2 AS (SELECT p_partkey, location FROM (SELECT p_partkey, d.word AS word, p_brand, p_type, p_name FROM part
  JOIN {NUMBER_WORDS_SQL.replace('nw(', 'd(')} ON d.n = p_size) q
  CROSS JOIN LATERAL (SELECT {LOCATION_SQL} AS location) l)
SELECT p2.p_partkey, p2.location,
       string_agg(coalesce(nw.digit, t.w), ' ' ORDER BY t.i) AS digits
FROM p2
CROSS JOIN LATERAL (SELECT unnest(string_split(p2.location, ' ')) AS w, generate_subscripts(string_split(p2.location, ' '), 1) AS i) t
LEFT JOIN {NUMBER_WORDS_SQL} ON nw.word = lower(t.w)
GROUP BY p2.p_partkey, p2.location""",
)
def q_location_digits(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand", "p_type", "p_name")
    words = F.array(*[F.lit(w) for w in WORDS_BY_NUMBER])
    part = part.withColumn("word", F.element_at(words, F.col("p_size")))
    loc = part.select("p_partkey", F.expr(LOCATION_SQL.replace("left(word, 1)", "substr(word, 1, 1)")).alias("location"))
    return loc.select("p_partkey", "location", words_to_digits("location").alias("digits"))


@query(
    "entity_map_roundtrip",
    f"""WITH {CUSTOMER_ENTITIES_SQL.strip()}
SELECT transcript_id, category,
       (dense_rank() OVER (PARTITION BY transcript_id ORDER BY cat_pos) - 1)::INT AS cat_pos, pos, value
FROM long""",
)
def q_entity_map_roundtrip(spark, sf_dir):
    """Long entities -> one D9 map per transcript -> long again: category order
    survives as the map's key order, value order as list order."""
    maps = entity_map(customer_entities(spark, sf_dir))
    return entities_from_map(maps).select("transcript_id", "category", "cat_pos", "pos", "value")
