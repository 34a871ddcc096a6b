"""Document fingerprints: a Merkle tree over paragraphs and sections, in SQL functions only.

Leaves are the paragraphs of a text: its lines, cut after ``.``, ``!`` and ``?`` too, so that a
paragraph of several sentences has several leaves.  Leaves keep every character, so a text is its
leaves one after another.  Sections are runs of leaves: a section ends after a blank line and after
a leaf whose hash ends in 0 (one in 16), which the text itself decides, so an insertion moves no
later boundary.  A leaf's hash is the SHA-256 of its text, a section's that of its leaves' hashes,
the root's that of its sections' hashes.  Equal roots mean equal texts.

The fingerprint is a string: the root in hexadecimal, then for each section ``/``, 16 digits of its
hash, ``.`` and 8 digits for each of its leaves.  Two fingerprints tell, without the texts, whether
they are equal (``root``), which branches differ (``differing``: sections that the other tree
does not have, and in them the leaves it does not have) and how alike they are (``likeness``: distinct leaves
of both over distinct leaves of either, 1 for equal roots).

The next document in the order of ids is found without a single-task window: existing keys cut the
order into buckets of about equal numbers of rows, a row finds its bucket by binary search, and the first row of a
bucket goes to the bucket before it as well.  Text is shuffled once.  Equal ids are ordered by their
texts' hashes, then by their places in the files, so that one id on any number of rows is cut into buckets too.

Defined results: a null text is empty (no leaves, no sections); a null id comes first; repeated rows are rows like any other, of
which the next one may be an exact copy; a single document is its own next one; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.common import written

#: Most buckets into which the order is cut; their first keys are a literal of the plan.
BUCKETS = 1 << 16
_LEAF = r"[^.!?\n]+[.!?\n]?|[.!?\n]"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sha(x: Column) -> Column:
    return F.sha2(x.cast("binary"), 256)


def _boundary(leaf: Column, digest: Column) -> Column:
    return digest.endswith("0") | (leaf == "\n")


def _sections(leaves: Column, digests: Column) -> Column:
    """Leaf digests as an array of sections."""
    n = F.size(digests)
    places = F.sequence(F.lit(1), n)
    ends = F.filter(places, lambda i: (i == n) | _boundary(F.element_at(leaves, i), F.element_at(digests, i)))
    cut = _let(ends, lambda e: F.zip_with(F.concat(F.array(F.lit(0)), F.slice(e, 1, F.size(e) - 1)), e, lambda a, b: F.slice(digests, a + 1, b - a)))
    return F.when(n > 0, cut).otherwise(F.array().cast("array<array<string>>"))


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text, see above."""
    def of_sections(sections: Column) -> Column:
        hashed = F.transform(sections, lambda s: F.struct(_sha(F.array_join(s, "")).alias("h"), F.array_join(F.transform(s, lambda x: F.substring(x, 1, 8)), "").alias("l")))
        return _let(hashed, lambda hs: F.concat(
            _sha(F.array_join(F.transform(hs, lambda x: x["h"]), "")),
            F.array_join(F.transform(hs, lambda x: F.concat(F.lit("/"), F.substring(x["h"], 1, 16), F.lit("."), x["l"])), ""),
        ))

    leaves = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_LEAF), F.lit(0))
    return _let(leaves, lambda ls: _let(F.transform(ls, _sha), lambda ds: _let(_sections(ls, ds), of_sections)))


def root(fp: Column) -> Column:
    return F.substring(fp, 1, 64)


def branches(fp: Column) -> Column:
    """The tree below the root: an array of sections, each its hash (16 digits) and its leaves (8 digits each)."""
    return F.transform(
        F.filter(F.split(F.substr(fp, F.lit(65)), "/"), lambda s: s != ""),
        lambda s: F.struct(F.substring(s, 1, 16).alias("section"), F.regexp_extract_all(F.substr(s, F.lit(18)), F.lit("[0-9a-f]{8}"), F.lit(0)).alias("leaves")),
    )


def leaves_of(fp: Column) -> Column:
    return F.flatten(F.transform(branches(fp), lambda s: s["leaves"]))


def differing(fp: Column, other: Column) -> Column:
    """Leaves of ``fp`` that ``other`` does not have, as (leaf number from 0, section hash, leaf hash); equal sections are not entered."""
    def compare(mine: Column, others: Column) -> Column:
        known_sections = F.transform(others, lambda s: s["section"])
        known_leaves = F.flatten(F.transform(others, lambda s: s["leaves"]))
        counts = F.transform(mine, lambda s: F.size(s["leaves"]))
        before = F.transform(mine, lambda s, i: F.aggregate(F.slice(counts, 1, i), F.lit(0), lambda a, x: a + x))
        entered = F.filter(F.zip_with(mine, before, lambda s, b: F.struct(s["section"].alias("section"), s["leaves"].alias("leaves"), b.alias("b"))), lambda s: ~F.array_contains(known_sections, s["section"]))
        listed = F.flatten(F.transform(entered, lambda s: F.transform(s["leaves"], lambda x, i: F.struct((s["b"] + i).alias("leaf"), s["section"].alias("section"), x.alias("hash")))))
        return F.filter(listed, lambda x: ~F.array_contains(known_leaves, x["hash"]))

    return F.when(root(fp) == root(other), F.array().cast("array<struct<leaf:int,section:string,hash:string>>")).otherwise(
        _let(branches(fp), lambda a: _let(branches(other), lambda b: compare(a, b)))
    )


def likeness(fp: Column, other: Column) -> Column:
    """Distinct leaves that both have over distinct leaves that either has; 1 for equal roots."""
    share = _let(leaves_of(fp), lambda a: _let(leaves_of(other), lambda b: F.size(F.array_intersect(a, b)).cast("double") / F.greatest(F.size(F.array_union(a, b)), F.lit(1))))
    return F.when(root(fp) == root(other), F.lit(1.0)).otherwise(share)


def _placed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and an order of all rows: their ids, texts' hashes and places in files."""
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    place = [F.xxhash64("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]
    try:
        out = docs.select("doc_id", text, *place)
    except AnalysisException:  # not a table in files: make it one, so that every pass sees the same places
        out = written(docs.select("doc_id", text), "documents").select("doc_id", "text", *place)
    return out.withColumn("_hash", F.xxhash64("text"))


def with_next(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """doc_id, text, fingerprint, next_text and next_fingerprint of every document."""
    spark = docs.sparkSession
    rows = _placed(docs)
    key = F.struct("doc_id", "_hash", "_file", "_row")
    buckets = min(buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions")), BUCKETS)
    firsts = sorted(
        (r["k"] for r in rows.select("doc_id", "_hash", "_file", "_row").repartitionByRange(buckets, "doc_id", "_hash", "_file", "_row").groupBy(F.spark_partition_id()).agg(F.min(key).alias("k")).collect()),
        key=lambda k: tuple((x is not None, x) for x in k),
    )  # at most BUCKETS rows: the smallest key of each range
    kind = f"struct<doc_id:{docs.schema['doc_id'].dataType.simpleString()},_hash:bigint,_file:bigint,_row:bigint>"
    bounds = F.from_json(F.lit(json.dumps([k.asDict() for k in firsts])), f"array<{kind}>")
    steps, step = [], 1
    while step < len(firsts):
        steps.append(step)
        step *= 2
    bucket = F.lit(0)
    if steps:  # the last bound that is not above the key
        bucket = F.aggregate(F.array(*map(F.lit, reversed(steps))), F.lit(0), lambda at, s: F.when((at + s < len(firsts)) & (F.get(bounds, at + s) <= key), at + s).otherwise(at))
    own = F.struct(F.col("_bucket").alias("bucket"), F.lit(0).alias("guest"))
    # the first of a bucket is also a guest at the end of the bucket before; the first of all, behind the last
    guest = F.struct(F.pmod(F.col("_bucket") - 1, F.lit(max(len(firsts), 1))).alias("bucket"), F.when(F.col("_bucket") == 0, 2).otherwise(1).alias("guest"))
    dealt = (
        rows.withColumn("_bucket", bucket)
        .withColumn("_at", F.explode(F.when(F.get(bounds, F.col("_bucket")) == key, F.array(own, guest)).otherwise(F.array(own))))
        .select("doc_id", "text", "_hash", "_file", "_row", F.col("_at.bucket").alias("_bucket"), F.col("_at.guest").alias("_guest"), (F.col("_at.guest") == 2).alias("_after"))
        .repartition("_bucket")
        .withColumn("fingerprint", fingerprint(F.col("text")))
    )
    order = Window.partitionBy("_bucket").orderBy("_after", "doc_id", "_hash", "_file", "_row")
    return (
        dealt.withColumn("next_text", F.lead("text").over(order)).withColumn("next_fingerprint", F.lead("fingerprint").over(order))
        .where(F.col("_guest") == 0).select("doc_id", "text", "fingerprint", "next_text", "next_fingerprint")
    )


def with_edited(documents: DataFrame) -> DataFrame:
    """``with_next`` rows and ``edited``: the last quarter of the text replaced by as much of the beginning of the next one."""
    n = F.char_length("text")
    tail = F.floor(n / 4).cast("int")
    return documents.withColumn("n_chars", n.cast("bigint")).withColumn("edited", F.concat(F.substr("text", F.lit(1), n - tail), F.substr("next_text", F.lit(1), tail)))


def fingerprint_documents(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and n_differing: leaves of the edited text that the text does not have."""
    rows = (
        with_edited(with_next(docs, buckets))
        .select("doc_id", "n_chars", _sha(F.col("edited")).alias("edited_sha256"), "fingerprint", fingerprint(F.col("edited")).alias("edited_fingerprint"), "next_fingerprint")
    )
    mine = F.col("fingerprint")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(mine, F.col("edited_fingerprint")).alias("near_edited"), likeness(mine, F.col("next_fingerprint")).alias("near_next"),
        F.size(differing(F.col("edited_fingerprint"), mine)).cast("bigint").alias("n_differing"),
    )
