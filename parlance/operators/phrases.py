"""Phrases of several words in texts: leftmost-longest matches of a table of terms.

A word is a run of letters and digits of any script.  A phrase is a sequence of words, lower-cased;
it is found in a text wherever its words follow one another, whatever stands between them that is neither letter nor digit
(``U.S. Code``, ``cross-examination`` and line breaks are no obstacle).

Matches do not overlap: of all places where a phrase begins the leftmost counts, of the phrases
that begin there the longest (in words), and the search goes on behind it.

Terms are normalised to their words in Spark and become a token trie that tasks walk along each
text.  The table is measured first: it is sent out in blocks of at most about ``BLOCK`` bytes.  One block (the usual case) is one
pass over the texts.  With more blocks every pass notes the longest phrase of its block at each
place, the texts are checkpointed between passes so that one block at a time is held, and the last pass settles the matches.
A task takes Arrow batches of a few MB and notes the matches of ``PART`` bytes of text at a time, so its memory does not
depend on how many texts it gets.

Defined results: of a repeated phrase the smallest payload counts; terms without a word and null payloads count for
nothing; null texts have no matches and stay null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.operators.entities import ENTITY_CATEGORIES
from parlance.session import ensure_checkpoint_dir, limit_batches

#: Bytes of phrases and payloads that tasks hold at a time.
BLOCK = 2 << 20
#: Bytes of text whose matches a task holds at a time (one text, if it is longer).
PART = 1 << 18
#: A word in Spark's and in Python's regular expressions.
WORD = r"[\p{L}\p{N}]+"
_WORD = re.compile(r"[^\W_]+")

MATCH_DDL = "struct<at:int,n:int,begin:int,end:int,phrase:string,payload:string>"
_MATCH = pa.struct([("at", pa.int32()), ("n", pa.int32()), ("begin", pa.int32()), ("end", pa.int32()), ("phrase", pa.string()), ("payload", pa.string())])


def normalised(term) -> F.Column:
    """The words of a term, lower-cased, joined by one space."""
    return F.array_join(F.regexp_extract_all(F.lower(term), F.lit(WORD), F.lit(0)), " ")


def _trie(rows: list[tuple[str, str]]) -> dict:
    """Nested dictionaries by word; under ``""`` the (phrase, payload) that ends there."""
    root: dict = {}
    for phrase, payload in rows:
        node = root
        for word in phrase.split(" "):
            node = node.setdefault(word, {})
        node[""] = (phrase, payload)
    return root


def _longest(trie: dict, text: str) -> Iterator[tuple]:
    """(at, n, begin, end, phrase, payload) of the longest phrase at each word of a text where one begins."""
    places = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    words = [text[a:b].lower() for a, b in places]
    for i, word in enumerate(words):
        node, found, j = trie.get(word), None, i
        while node is not None:
            j += 1
            if "" in node:
                found = (j, node[""])
            node = node.get(words[j]) if j < len(words) else None
        if found:
            yield i, found[0] - i, places[i][0], places[found[0] - 1][1], *found[1]


def _settled(candidates: list[tuple]) -> list[tuple]:
    """Leftmost, of those the longest, and nothing that overlaps it."""
    out: list[tuple] = []
    free = 0
    for c in sorted(candidates, key=lambda c: (c[0], -c[1])):
        if c[0] >= free:
            out.append(c)
            free = c[0] + c[1]
    return out


def _parts(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """First row and number of rows of the pieces of a batch: at most ``PART`` bytes of text each, or one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts.cast(pa.string())), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    i, done = 0, 0
    while i < len(ends):
        j = max(i + 1, int(np.searchsorted(ends, done + PART, "right")))
        yield i, j - i
        i, done = j, int(ends[j - 1])


def _pass(rows: list[tuple[str, str]], text: str, first: bool, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _trie(rows)
        for batch in batches:
            for i, n in _parts(batch.column(text)):
                part = batch.slice(i, n)
                known = [None] * n if first else part.column("_matches").to_pylist()
                # one list for each field, so that a match is no object of its own
                fields, ends = [[] for _ in _MATCH.names], [0]
                for t, before in zip(part.column(text).to_pylist(), known):
                    found = [tuple(m.values()) for m in before or []] + (list(_longest(trie, t)) if t else [])
                    for values, of_row in zip(fields, zip(*(_settled(found) if last else found))):
                        values.extend(of_row)
                    ends.append(len(fields[0]))
                matches = pa.StructArray.from_arrays([pa.array(v, f.type) for v, f in zip(fields, _MATCH)], fields=list(_MATCH))
                columns = [c for c in part.schema.names if c != "_matches"]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), matches)], [*columns, "_matches"])

    return run


def match_phrases(texts: DataFrame, terms: DataFrame, *, text: str = "text", term: str = "term", payload: str = "payload") -> DataFrame:
    """``texts`` with ``_matches``: for each match its first word's number, its number of words, where it
    begins and ends in the text (code points, end exclusive), the phrase and its payload; in text order."""
    spark = texts.sparkSession
    ensure_checkpoint_dir(spark)
    limit_batches(spark)
    words = terms.select(normalised(term).alias("p"), F.col(payload).cast("string").alias("v")).where("p <> '' and v is not null")
    known = words.groupBy("p").agg(F.min("v").alias("v"))
    size = known.agg(F.coalesce(F.sum(F.octet_length("p") + F.octet_length("v") + 16), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK))
    out = texts
    for b in range(blocks):
        some = known if blocks == 1 else known.where(F.pmod(F.xxhash64("p"), F.lit(blocks)) == b)
        rows = sorted((r["p"], r["v"]) for r in some.collect())  # at most about BLOCK bytes
        schema = texts.schema if b == 0 else out.schema[:-1]
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + f", _matches array<{MATCH_DDL}>"
        out = out.mapInArrow(_pass(rows, text, b == 0, b == blocks - 1), ddl)
        if b < blocks - 1:
            out = out.checkpoint(eager=True)
    return out


def entities_from_phrases(docs: DataFrame, gazetteer: DataFrame, *, key: str = "transcript_id", text: str = "text") -> DataFrame:
    """UDF-3 by lookup of phrases: ``gazetteer`` (term, category) over whole texts, as the long entity table.
    A phrase counts once per text, spelled as at its first match; ``pos`` is that order within the category.
    A phrase listed under several categories belongs to the first of them in catalogue order (then by name)."""
    ranks = F.create_map(*[F.lit(x) for i, c in enumerate(ENTITY_CATEGORIES) for x in (c, i)])
    ranked = gazetteer.where(F.col("category").isNotNull()).select("term", F.concat(F.lpad(F.coalesce(F.try_element_at(ranks, F.col("category")), F.lit(len(ENTITY_CATEGORIES))).cast("string"), 3, "0"), F.lit(" "), F.col("category")).alias("payload"))
    matched = match_phrases(docs.select(key, text), ranked, text=text)
    # values are cut out in the row of their text; no text is shuffled or repeated
    spelled = F.transform("_matches", lambda m: F.struct(m["phrase"].alias("phrase"), m["payload"].alias("payload"), m["at"].alias("at"), F.substr(F.col(text), m["begin"] + 1, m["end"] - m["begin"]).alias("value")))
    hits = matched.select(key, F.explode(spelled).alias("m"))
    firsts = hits.groupBy(key, "m.phrase", "m.payload").agg(F.min(F.struct("m.at", "m.value")).alias("v"))
    per = firsts.groupBy(key, "payload").agg(F.array_sort(F.collect_list("v")).alias("vs"))  # a text's phrases of one category
    return per.select(
        key, F.substr("payload", F.lit(5)).alias("category"), F.substr("payload", F.lit(1), F.lit(3)).cast("int").alias("cat_pos"),
        F.posexplode(F.transform("vs", lambda v: v["value"])).alias("pos", "value"),
    ).withColumn("pos", F.col("pos").cast("bigint"))


def apply_vocabulary_phrases(segments: DataFrame, vocab: DataFrame, *, text: str = "text") -> DataFrame:
    """RM-5 for phrases: every match of a term of ``vocab`` (term, preferred) is replaced by its preferred form;
    all other characters of the text stay.  Adds ``text_out`` and ``n_replaced``."""
    matched = match_phrases(segments, vocab, text=text, payload="preferred")
    # what stands before each match and its replacement, then what stands behind the last one
    previous = F.concat(F.array(F.lit(0)), F.transform("_matches", lambda m: m["end"]))
    kept = F.zip_with("_matches", F.slice(previous, 1, F.size("_matches")), lambda m, p: F.concat(F.substr(F.col(text), p + 1, m["begin"] - p), m["payload"]))
    tail = F.substr(F.col(text), F.element_at(previous, -1) + 1)
    return matched.withColumn("text_out", F.concat(F.array_join(kept, ""), tail)).withColumn("n_replaced", F.size("_matches").cast("bigint")).drop("_matches")
