"""Speaker segments: raw-transcript explode, JOIN-1 interval join, AGG-1 text,
JOIN-5 speaker names, AGG-10 speaker cap, SCL-5/6 segment view.

JOIN-1 plan
-----------
An item belongs to a segment iff ``seg.start <= item.start <= seg.end`` (both
ends inclusive, so an item on a shared boundary lands in both segments).  Spark
has no range join: without an equality key the condition plans as a
BroadcastNestedLoopJoin.  We add one: time is cut into bins, an item gets the
single bin ``floor(t / width)``, a segment lists every bin it overlaps; the join
is an equi-join on ``(transcript, tier, bin)`` with the range test as residual,
and each (item, segment) pair meets in exactly one bin, so nothing is
de-duplicated.  Long segments would list many bins, so segments are placed in
geometric tiers (width ``bin_s * fanout**tier``) where they span at most
``fanout`` bins; items are repeated once per tier actually used (usually one).
A hot transcript is split by its bins; AQE's skew-join splitting covers a hot bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import word_count
from parlance.functions.times import py_float
from parlance.session import scratch_path

ITEM_TYPES = ("pronunciation", "punctuation")


def _valid_time(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c)


def _finite(c: Column) -> Column:
    return _valid_time(c) & (F.abs(c) != F.lit(float("inf")))


def parsed_once(raw: DataFrame) -> DataFrame:
    """Raw transcripts as a columnar table in the shared folder: the JSON is parsed once, and
    segments, items and counts read the columns they need."""
    spark = raw.sparkSession
    path = scratch_path(spark, "raw")
    raw.write.parquet(path)
    return spark.read.schema(raw.schema).parquet(path)


def raw_segments_and_items(raw: DataFrame, key: str = "transcript_id"):
    """Explode D4 raw transcripts into D5 segments and D6 items (ordinals kept:
    ORD-1, array position is meaning, so every explode is a ``posexplode``).

    Times are parsed with Python's float syntax (SCL-4); an unparsable time gives
    null and a NaN time no match, both with a ``reject_reason`` instead of an error.
    """
    segs = raw.select(key, F.posexplode("results.speaker_labels.segments").alias("seg_no", "s")).select(
        key,
        F.col("seg_no").cast("bigint").alias("seg_no"),
        F.col("s.start_time").alias("timestamp"),
        F.col("s.speaker_label").alias("speaker"),
        py_float("s.start_time").alias("start_s"),
        py_float("s.end_time").alias("end_s"),
    )
    segs = segs.withColumn(
        "reject_reason",
        F.when(~_valid_time(F.col("start_s")) | ~_valid_time(F.col("end_s")), F.lit("bad_time")),
    )
    items = raw.select(key, F.posexplode("results.items").alias("item_no", "i")).select(
        key,
        F.col("item_no").cast("bigint").alias("item_no"),
        F.col("i.type").alias("type"),
        py_float("i.start_time").alias("start_s"),
        F.col("i.start_time").alias("start_raw"),
        # PRJ-7 / ORD-3: first alternative only (``get`` is null-safe under ANSI)
        F.get(F.col("i.alternatives"), 0)["content"].alias("content"),
    )
    items = items.withColumn(
        "reject_reason",
        F.when(F.col("start_raw").isNotNull() & ~_valid_time(F.col("start_s")), F.lit("bad_time"))
        .when(F.col("type").isin(*ITEM_TYPES) & F.col("content").isNull(), F.lit("no_alternative")),
    ).drop("start_raw")
    return segs, items


def timed_items(items: DataFrame) -> DataFrame:
    """PRJ-6: items that have a (valid) start time and a word/punctuation type."""
    return items.where(_valid_time(F.col("start_s")) & F.col("type").isin(*ITEM_TYPES))


def _bin_plan(segments: DataFrame, bin_s: float | None, fanout: int) -> tuple[float, int]:
    """Bin width and number of tiers from one aggregate over the segments.

    Without a given width a quarter of the median segment span is used: a typical
    segment lists about five bins and each item meets one or two candidate
    segments; tiers then cover the longest segment.  The result does
    not depend on the width, only the amount of work does."""
    span = F.col("end_s") - F.col("start_s")
    ok = _finite(F.col("start_s")) & _finite(F.col("end_s")) & (span >= 0)
    row = segments.where(ok).agg(
        F.percentile_approx(span, 0.5, 1000).alias("med"), F.max(span).alias("mx")
    ).first()
    med, mx = (row["med"], row["mx"]) if row else (None, None)
    if bin_s is None:
        bin_s = float(med) / 4.0 if med and med > 0 else 1.0
    tiers = 1
    while mx and mx / (bin_s * fanout ** (tiers - 1)) > fanout:
        tiers += 1
    return bin_s, tiers


def segment_text(
    segments: DataFrame,
    items: DataFrame,
    *,
    key: str = "transcript_id",
    bin_s: float | None = None,
    fanout: int = 64,
    tiers: int | None = None,
    closed: str = "both",
) -> DataFrame:
    """JOIN-1 + AGG-1 + AGG-2: every segment with its text and token count.

    ``closed="both"`` (default, as the service does) puts an item on a shared
    boundary into both segments; ``closed="left"`` uses ``start <= t < end`` so
    it lands only in the later one.

    ``segments``: key, seg_no, start_s, end_s, other attributes (kept).
    ``items``: key, item_no, start_s, type, content (untimed / other types dropped).
    Output: segment columns + ``text`` (contents in item order joined by one
    space, ``""`` when no item falls inside) + ``n_tokens``.
    """
    seg_cols = segments.columns
    timed = timed_items(items).select(key, "item_no", F.col("start_s").alias("_t"), "content")
    finite_items = timed.where(_finite(F.col("_t")))
    usable = segments.select(key, "seg_no", F.col("start_s").alias("_s"), F.col("end_s").alias("_e")).where(
        _valid_time(F.col("_s")) & _valid_time(F.col("_e")) & (F.col("_e") >= F.col("_s"))
    )
    # an infinite end reaches to the last item of its transcript; bins need finite ends
    endless = usable.where(~_finite(F.col("_s")) | ~_finite(F.col("_e")))
    reach = finite_items.groupBy(key).agg(F.min("_t").alias("_lo"), F.max("_t").alias("_hi"))
    clipped = endless.join(reach, key).select(key, "seg_no", F.greatest("_s", "_lo").alias("_s"), F.least("_e", F.col("_hi") + F.greatest(F.lit(1.0), F.abs("_hi") * 1e-9)).alias("_e")).where("_e >= _s")
    s = usable.where(_finite(F.col("_s")) & _finite(F.col("_e"))).union(clipped)
    if tiers is None or bin_s is None:
        as_segments = lambda s: s.select(F.col("_s").alias("start_s"), F.col("_e").alias("end_s"))
        width_given = bin_s
        bin_s, tiers = _bin_plan(as_segments(s), width_given, fanout)
        if tiers > 1:  # what reaches beyond the items of its transcript need not be long
            s = s.join(reach, key).select(key, "seg_no", F.greatest("_s", "_lo").alias("_s"), F.least("_e", F.col("_hi") + F.greatest(F.lit(1.0), F.abs("_hi") * 1e-9)).alias("_e")).where("_e >= _s")
            bin_s, tiers = _bin_plan(as_segments(s), width_given, fanout)
    # tier: smallest with at most `fanout` bins
    span_bins = (F.col("_e") - F.col("_s")) / F.lit(bin_s)
    tier = F.least(
        F.greatest(F.ceil(F.log(float(fanout), F.greatest(span_bins, F.lit(1.0)))) - 1, F.lit(0)),
        F.lit(tiers - 1),
    ).cast("int")
    s = s.withColumn("_tier", tier)
    width = F.lit(bin_s) * F.pow(F.lit(float(fanout)), F.col("_tier"))
    s = s.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_s") / width), F.floor(F.col("_e") / width))))

    if tiers > 1:  # items are repeated for the tiers that their own transcript has
        used = s.groupBy(key).agg(F.collect_set("_tier").alias("_tiers"))
        it = finite_items.join(used, key).withColumn("_tier", F.explode("_tiers")).drop("_tiers")
    else:
        it = finite_items.withColumn("_tier", F.lit(0))
    it = it.withColumn(
        "_bin", F.floor(F.col("_t") / (F.lit(bin_s) * F.pow(F.lit(float(fanout)), F.col("_tier"))))
    )
    if closed not in ("both", "left"):
        raise ValueError("closed must be 'both' or 'left'")
    upper = (F.col("_t") <= F.col("_e")) if closed == "both" else (F.col("_t") < F.col("_e"))
    pairs = s.join(it, [key, "_tier", "_bin"]).where((F.col("_s") <= F.col("_t")) & upper)
    # items at an infinite time can only lie in endless segments
    far = endless.join(timed.where(~_finite(F.col("_t"))), key).where((F.col("_s") <= F.col("_t")) & upper)
    columns = [key, "seg_no", F.struct("item_no", "content").alias("_it")]
    matched = pairs.select(*columns).union(far.select(*columns))

    # one aggregation over segments + pairs: empty segments survive as "" and the
    # segment attributes ride along, so there is no join back
    it_type = "struct<item_no:bigint,content:string>"
    attrs = [c for c in seg_cols if c not in (key, "seg_no")]
    seg_rows = segments.select(key, "seg_no", *attrs, F.lit(None).cast(it_type).alias("_it"))
    pair_rows = matched.select(
        key, "seg_no", *[F.lit(None).cast(segments.schema[c].dataType).alias(c) for c in attrs],
        F.col("_it").cast(it_type),
    )
    texts = seg_rows.unionByName(pair_rows).groupBy(key, "seg_no").agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in attrs],
        F.array_join(F.transform(F.array_sort(F.collect_list("_it")), lambda x: x["content"]), " ").alias("text"),
    )
    return texts.select(*seg_cols, "text").withColumn("n_tokens", word_count("text"))


def resolve_speakers(segments: DataFrame, speaker_map: DataFrame, *, key: str = "transcript_id") -> DataFrame:
    """JOIN-5: best known name for a speaker label, else the label itself.

    ``speaker_map``: [key,] speaker_label, name -- one row per (key, label) at most,
    so the join cannot multiply segments.  Without a key column the map applies
    to every transcript; the caller broadcasts it only when its size is fixed.
    """
    on = [key, "speaker"] if key in speaker_map.columns else ["speaker"]
    m = speaker_map.select(*on[:-1], F.col("speaker_label").alias("speaker"), F.col("name").alias("_name"))
    return segments.join(m, on, "left").withColumn("speaker_name", F.coalesce("_name", "speaker")).drop("_name")


def speaker_cap(segments: DataFrame, cap: int = 10, *, key: str = "transcript_id") -> DataFrame:
    """AGG-10: distinct speakers per transcript and whether the diarization cap holds."""
    return segments.groupBy(key).agg(F.count_distinct("speaker").cast("bigint").alias("n_speakers")).withColumn(
        "within_cap", F.col("n_speakers") <= cap
    )


def segment_view(segments: DataFrame, *, key: str = "transcript_id", ordered: bool = False) -> DataFrame:
    """D14 / SCL-5+6 / ORD-2: display rows ``(key, seg_no, hms, speaker, text)``;
    the ``timestamp`` string is read with the lenient prefix parser.  Sorting is
    presentation only (``ordered=True``), never relied on by other jobs."""
    from parlance.functions.times import hms, js_parse_float

    out = segments.select(key, "seg_no", hms(js_parse_float("timestamp")).alias("hms"), "speaker", "text")
    return out.orderBy(key, "seg_no") if ordered else out
