"""Entities: UDF-3 native extractor + AGG-6 unique values, PRJ-13 / JOIN-4 /
AGG-9 / SCL-7 / SCL-8 entity view, PRJ-12 / AGG-11 case header.

Entities are kept in long form ``(transcript_id, category, pos, value)`` for
analytics (``pos`` = first-appearance order of a value within its category) and
folded into the ``map<string, array<string>>`` document shape only per
transcript.  The extractor is a catalogue of ``(category, regex)`` rules applied
with ``regexp_extract_all`` over the whole text; a model can replace it through
``operators.models.apply_model``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.schemas import (
    CATEGORY_COLORS,
    DEFAULT_COLOR,
    ENTITY_CATEGORIES,
    HEADER_ONLY_CATEGORIES,
    NUMBER_WORDS,
    PLURAL_LABELS,
    SINGULAR_RENAMES,
)

# Default rule catalogue for the native extractor (ours; the rules use only the
# regex subset Java and RE2 agree on: no lookaround, no \b).
WORD_PATTERN = "[A-Za-z]+"
DEFAULT_CATALOGUE = (
    ("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("IP_ADDRESS", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"),
    ("LICENSE", r"[Ll]icensed under [^.\n]+\."),
    ("ACCOUNT_NUMBER", r"[0-9]{16}"),
    ("LICENSE", r"[Aa]ll rights reserved"),
)


def entities_from_gazetteer(docs: DataFrame, gazetteer: DataFrame, *, key: str = "transcript_id", text: str = "text") -> DataFrame:
    """UDF-3 by lookup: words of a text that a gazetteer table (``term, category``; lower-case single
    words, unique) lists, as the long entity table.  Values keep their spelling at first appearance; ``pos``
    is that order within the category.  Distinct words of a text are joined, so no text is shuffled."""
    order = {c: i for i, c in enumerate(ENTITY_CATEGORIES)}
    words = docs.select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(WORD_PATTERN), 0)).alias("at", "value"))
    first = words.withColumn("term", F.lower("value")).groupBy(key, "term").agg(F.min(F.struct("at", "value")).alias("v"))
    hits = first.join(gazetteer.select("term", "category"), "term")
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col("category")), F.lit(len(order)))
    per = hits.groupBy(key, "category").agg(F.array_sort(F.collect_list("v")).alias("vs"))  # a text's terms of one category
    return per.select(key, "category", rank.alias("cat_pos"), F.posexplode(F.transform("vs", lambda v: v["value"])).alias("pos", "value")).withColumn("pos", F.col("pos").cast("bigint"))


def extract_entities(docs: DataFrame, catalogue=DEFAULT_CATALOGUE, *, key: str = "transcript_id", text: str = "text") -> DataFrame:
    """UDF-3 + AGG-6: long entity table with unique values.  Categories are numbered as the catalogue first
    names them; the values of a category come rule by rule, those of one rule in the order of first appearance."""
    rules: dict[str, list[str]] = {}
    for cat, rx in catalogue:
        rules.setdefault(cat, []).append(rx)
    found = lambda rx: F.regexp_extract_all(F.col(text), F.lit(rx), 0)
    per_category = [
        F.struct(F.lit(cat).alias("category"), F.lit(i).alias("cat_pos"), F.array_distinct(F.concat(*map(found, rxs))).alias("vals"))
        for i, (cat, rxs) in enumerate(rules.items())
    ]
    each = docs.select(key, F.explode(F.array(*per_category)).alias("r")).select(key, "r.*")
    return each.select(key, "category", "cat_pos", F.posexplode("vals").alias("pos", "value")).withColumn(
        "pos", F.col("pos").cast("bigint")
    )


def entity_map(long: DataFrame, *, key: str = "transcript_id") -> DataFrame:
    """Long form -> D9 map per transcript, categories in ``cat_pos`` order.  A category under several
    ``cat_pos`` is one list: its values in the order of (cat_pos, pos), each once, in the place of the smallest."""
    per_cat = long.groupBy(key, "category").agg(
        F.min("cat_pos").alias("cat_pos"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("cat_pos", "pos", "value"))), lambda x: x["value"])).alias("values"),
    )
    return per_cat.groupBy(key).agg(
        F.map_from_entries(
            F.transform(F.array_sort(F.collect_list(F.struct("cat_pos", "category", "values"))),
                        lambda x: F.struct(x["category"], x["values"]))
        ).alias("entities")
    )


def number_words_map() -> Column:
    """SCL-7 dictionary as a literal map (fixed size: 50 entries)."""
    return F.create_map(*[F.lit(x) for kv in NUMBER_WORDS.items() for x in kv])


def words_to_digits(value) -> Column:
    """SCL-7: split on single spaces, replace whole number words (case-insensitive)."""
    v = F.col(value) if isinstance(value, str) else value
    m = number_words_map()
    return F.array_join(F.transform(F.split(v, " ", -1), lambda w: F.coalesce(F.try_element_at(m, F.lower(w)), w)), " ")


def category_dim(spark: SparkSession) -> DataFrame:
    """JOIN-4 dimension: colour and labels per known category (fixed size)."""
    rows = [
        (c, CATEGORY_COLORS.get(c), PLURAL_LABELS.get(c), SINGULAR_RENAMES.get(c, c))
        for c in ENTITY_CATEGORIES
    ]
    return spark.createDataFrame(rows, "category string, color string, plural string, singular string")


def entity_view(long: DataFrame, *, key: str = "transcript_id") -> DataFrame:
    """PRJ-13 + JOIN-4 + AGG-9 + SCL-7/8: one display row per non-empty category
    except CASE_NUMBER and DATE, with label, values and colour.  ``cat_pos`` keeps
    the map's key order for display (ORD-2).

    ``long`` must carry ``cat_pos`` (key order of the entity map).
    """
    shown = long.where(~F.col("category").isin(*HEADER_ONLY_CATEGORIES) & F.col("value").isNotNull())
    shown = shown.withColumn(
        "value", F.when(F.col("category") == "LOCATION", words_to_digits("value")).otherwise(F.col("value"))
    )
    per_cat = shown.groupBy(key, "category", "cat_pos").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("values"),
        F.count(F.lit(1)).cast("bigint").alias("n_values"),
    )
    dim = F.broadcast(category_dim(long.sparkSession))
    joined = per_cat.join(dim, "category", "left")
    label = (
        F.when((F.col("n_values") > 1) & F.col("plural").isNotNull(), F.col("plural"))
        .otherwise(F.coalesce(F.col("singular"), F.col("category")))
    )
    return joined.select(
        key, "cat_pos", "category", label.alias("label"), "values", "n_values",
        F.coalesce("color", F.lit(DEFAULT_COLOR)).alias("color"),
    )


def case_header(long: DataFrame, *, key: str = "transcript_id", transcripts: DataFrame | None = None) -> DataFrame:
    """PRJ-12 + AGG-11 (ORD-3): first case number, first date, plaintiffs, defendants.

    A missing category gives null (the viewer would throw) plus a flag.  With ``transcripts``
    (the list of all keys) a transcript without any entity has a row too."""
    def first_of(cat):
        return F.min_by(F.when(F.col("category") == cat, F.col("value")), F.when(F.col("category") == cat, F.col("pos")))

    def list_of(cat):
        return F.transform(
            F.array_sort(F.collect_list(F.when(F.col("category") == cat, F.struct("pos", "value")))),
            lambda x: x["value"],
        )

    agg = long.groupBy(key).agg(
        first_of("CASE_NUMBER").alias("case_number"),
        first_of("DATE").alias("case_date"),
        list_of("PLAINTIFF").alias("plaintiffs"),
        list_of("DEFENDANT").alias("defendants"),
        F.max((F.col("category") == "CASE_NUMBER").cast("int")).alias("_has_case"),
    )
    if transcripts is not None:
        none = F.array().cast("array<string>")
        agg = transcripts.select(key).distinct().join(agg, key, "left")
        agg = agg.withColumn("plaintiffs", F.coalesce("plaintiffs", none)).withColumn("defendants", F.coalesce("defendants", none))
    return agg.withColumn("missing_case_number", F.coalesce(F.col("_has_case"), F.lit(0)) == 0).drop("_has_case")


def entities_from_map(docs: DataFrame, entities: str = "entities", *, key: str = "transcript_id") -> DataFrame:
    """D9 map -> long form, keeping the key order of the map as ``cat_pos`` and the
    list order as ``pos`` (a missing map gives no rows)."""
    cats = docs.select(key, F.posexplode(F.map_entries(F.col(entities))).alias("cat_pos", "e"))
    return cats.select(
        key, F.col("e.key").alias("category"), F.col("cat_pos").cast("int").alias("cat_pos"),
        F.posexplode_outer(F.col("e.value")).alias("pos", "value"),
    ).where(F.col("value").isNotNull()).withColumn("pos", F.col("pos").cast("bigint"))
