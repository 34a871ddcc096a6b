"""JOIN-5: names of speaker labels from what is said.

Evidence rules find a name in a segment's text and say whose it is: the speaker's own
(``self``: "my name is Ann Lee"), or that of whoever speaks next or spoke before (``next``: "Mr. Lee, please
continue", ``previous``: "thank you, Ms. Lee").  Neighbours are the nearest segments of the transcript by number, found by a
skew-safe lead and lag, and only if another label speaks there.

Evidence is summed per (transcript, label, name).  Names are then given greedily: the
strongest pair of a transcript first (ties: the smaller label, then the smaller name), after which its label and its name
are taken; every label has at most one name and every name at most one label.  With L labels in a transcript
the strongest L names of a label are enough, since the others can take at most L - 1 of them: what is
gathered per transcript is at most L x L pairs, whatever its length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.operators.ordered import with_next, with_prev

_NAME = r"((?:[A-Z][A-Za-z'-]+ ){0,2}[A-Z][A-Za-z'-]+)"

#: (whose name, pattern with the name as its first group, weight); ours, in the syntax that Java and RE2 share.
DEFAULT_EVIDENCE = (
    ("self", rf"[Mm]y name is {_NAME}", 5),
    ("self", rf"(?:I am|I'm) (?:Judge |Attorney |Counsel )?{_NAME}", 2),
    ("self", rf"{_NAME} for the (?:plaintiff|defendant|defense|state|prosecution)", 3),
    ("next", rf"(?:Mr\.|Mrs\.|Ms\.|Dr\.) {_NAME}, (?:please|go ahead|you may|would you|can you|could you)", 3),
    ("previous", rf"[Tt]hank you, (?:Mr\. |Mrs\. |Ms\. |Dr\. )?{_NAME}", 2),
)


def name_evidence(segments: DataFrame, rules=DEFAULT_EVIDENCE, *, key: str = "transcript_id") -> DataFrame:
    """(key, speaker_label, name, weight): every name found, by the label it speaks for.  ``segments``: key,
    seg_no, speaker, text.  Null labels and texts give none; a name said twice counts twice."""
    def found_by(whose: str, rx: str, weight: int) -> F.Column:
        names = F.regexp_extract_all("text", F.lit(rx), F.lit(1))
        return F.transform(names, lambda n: F.struct(F.lit(whose).alias("whose"), n.alias("name"), F.lit(weight).cast("bigint").alias("weight")))

    found = [found_by(*rule) for rule in rules]
    named = segments.select(key, "seg_no", "speaker", F.coalesce(F.concat(*found), F.array().cast("array<struct<whose:string,name:string,weight:bigint>>")).alias("found"))
    columns = ["speaker"]
    if any(whose == "previous" for whose, _, _ in rules):  # the lag comes first: it makes a column of the lead's name on its way
        named, columns = with_prev(named, key, "seg_no", ["speaker"]), [*columns, "prev_speaker"]
    if any(whose == "next" for whose, _, _ in rules):
        named, columns = with_next(named, key, "seg_no", ["speaker"]), [*columns, "next_speaker"]
    said = named.select(key, *columns, F.explode("found").alias("e")).select(key, *columns, "e.*")
    other = lambda c: F.when(F.col(c) != F.col("speaker"), F.col(c)) if c in columns else F.lit(None).cast("string")
    label = F.when(F.col("whose") == "self", F.col("speaker")).when(F.col("whose") == "next", other("next_speaker")).otherwise(other("prev_speaker"))
    return said.select(key, label.alias("speaker_label"), "name", "weight").where("speaker_label is not null and name <> ''")


def infer_speakers(segments: DataFrame, rules=DEFAULT_EVIDENCE, *, key: str = "transcript_id", least: int = 1) -> DataFrame:
    """(key, speaker_label, name, score): at most one name per label and one label per name, see above.
    Pairs of less evidence than ``least`` do not count.  Fits ``resolve_speakers`` as its map."""
    evidence = name_evidence(segments, rules, key=key)
    pairs = evidence.groupBy(key, "speaker_label", "name").agg(F.sum("weight").alias("score")).where(F.col("score") >= least)
    labels = pairs.groupBy(key).agg(F.count_distinct("speaker_label").alias("_labels"))
    place = F.row_number().over(Window.partitionBy(key, "speaker_label").orderBy(F.desc("score"), "name"))
    strong = pairs.withColumn("_place", place).join(labels, key).where("_place <= _labels")
    # strongest first: (-score, label, name) sorts as the greedy choice goes
    listed = strong.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "speaker_label", "name"))).alias("_all"))
    none = F.array().cast("array<struct<s:bigint,speaker_label:string,name:string>>")
    free = lambda taken, x: ~F.exists(taken, lambda t: (t["speaker_label"] == x["speaker_label"]) | (t["name"] == x["name"]))
    given = F.aggregate("_all", none, lambda taken, x: F.when(free(taken, x), F.concat(taken, F.array(x))).otherwise(taken))
    return listed.select(key, F.explode(given).alias("g")).select(key, "g.speaker_label", "g.name", (-F.col("g.s")).alias("score"))
