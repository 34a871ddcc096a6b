"""Quality rules: how far a document's characters and words are from its language.

Every document has two histograms: its characters over ``len(CLASSES)`` classes, and its
words over the common words of its language and one class for all others.  The
references are the same histograms summed over all documents of the language.  A
document fails if the Jensen-Shannon distance to a reference exceeds the rule's limit,
which is looser for short documents (their histograms scatter more) and does not apply
below a least length.  Fixed rules on length and repetition come first.

Common words are those with a share of at least ``SHARE`` in the language.  Such a word
has at least half that share in batches that hold half of its occurrences or more, so
batches report only words of half the share, and the words whose reported count reaches
half the share are bounded by 2 / SHARE for each language.  The second reading counts
these candidates exactly, and those below ``SHARE`` go to the class of all others, so
the common words do not depend on how rows fall into batches.  Languages are
primary subtags of two or three letters; any other value is ``und``.

Defined results: a null text has no words and fails the length rule; a null lang is
``und``; a document is compared with a reference that it is part of; repeated rows get
equal results; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import written
from parlance.llm.words import NOT_SPACE, _class, buffer_of, find_words, mix64, parts, shingles

#: Share of a language's words from which on a word is common.
SHARE = 0.002
#: Limits on the distances, for documents of at least this many characters or words.
CHAR_LIMIT, CHAR_LEAST = 0.18, 200
WORD_LIMIT, WORD_LEAST = 0.32, 40
#: Added to a limit, over the square root of the number of characters or words.
CHAR_SCATTER, WORD_SCATTER = 2.0, 1.5
MIN_WORDS, WINDOW_WORDS, MAX_REPEAT = 10, 5, 20

# character classes, by byte: bytes that continue a character are in none
CLASSES = ("lower", "upper", "digit", "space", "line", "stop", "quote", "symbol", "other", "beyond")
_CLASS = np.full(256, 8, np.uint8)
for _n, _ranges in enumerate((
    ((0x61, 0x7A),), ((0x41, 0x5A),), ((0x30, 0x39),), ((0x20, 0x20), (0x09, 0x09)), ((0x0A, 0x0A), (0x0D, 0x0D)),
    ((0x21, 0x21), (0x2C, 0x2C), (0x2E, 0x2E), (0x3A, 0x3B), (0x3F, 0x3F)), ((0x22, 0x22), (0x27, 0x29), (0x2D, 0x2D)),
)):
    _CLASS[_class(*_ranges)] = _n
_SYMBOLS = _class(*((b, b) for b in b"#*$%&|<>"))
_CLASS[_SYMBOLS] = 7
_CLASS[_class((0xC0, 0xFF))] = 9
_CLASS[_class((0x80, 0xBF))] = 10
_LINE = ~_class((0x0A, 0x0A))


def language(lang: Column) -> Column:
    """The primary subtag (en of en-US, pt of pt_br, deu) in lower case, of two or three letters; any other value is ``und``."""
    primary = F.regexp_extract(F.lower(lang), "^([a-z]{2,3})([-_].*)?$", 1)
    return F.when(primary != "", primary).otherwise("und")


def _repeats(key: np.ndarray) -> np.ndarray:
    """Marks the keys found more than once."""
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    out = np.zeros(len(key), bool)
    out[order] = same[1:] | same[:-1]
    return out


def _sum_by_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]


def _base(data: np.ndarray, at: np.ndarray, words) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    n = len(at) - 1
    salt = mix64(np.arange(n).astype(np.uint64))
    lines = find_words(data, at, _LINE, fold=False)
    first = np.searchsorted(words.start, lines.start)
    worded = np.flatnonzero(np.append(words.start, len(data) + 1)[first] < lines.end)
    distinct = np.unique(lines.hash[worded] ^ salt[lines.doc[worded]], return_index=True)[1]
    dup_lines = np.bincount(lines.doc[worded], minlength=n) - np.bincount(lines.doc[worded][distinct], minlength=n)
    h, index = shingles(words, WINDOW_WORDS)
    again = index[_repeats(h ^ salt[words.doc[index]])]
    edge = np.zeros(len(words.start) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + WINDOW_WORDS, -1)
    repeated = _sum_by_text(np.cumsum(edge[:-1]) > 0, words.first)
    in_word = NOT_SPACE[data] & (_CLASS[data] != 10)
    return [np.diff(words.first), _sum_by_text(in_word, at), _sum_by_text(_SYMBOLS[data], at), dup_lines, repeated]


def common_words(docs: DataFrame, share: float = SHARE) -> dict[str, np.ndarray]:
    """Hashes of the candidates for common words of each language (lang, text), at most 2 / share of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in parts(batch.column("text"), 1 << 22):
                words = find_words(*buffer_of(batch.column("text").slice(i, j - i)), NOT_SPACE, fold=False)
                names, code = np.unique(np.asarray(batch.column("lang").slice(i, j - i).to_pylist(), dtype=object).astype(str), return_inverse=True)
                of = code[words.doc]
                for c, name in enumerate(names.tolist()):
                    own, n = np.unique(words.hash[of == c], return_counts=True)
                    often = n >= share / 2 * n.sum()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * (int(often.sum()) + 1)), pa.array([None, *own[often].view(np.int64).tolist()], pa.int64()), pa.array([int(n.sum()), *n[often].tolist()], pa.int64())],
                        ["lang", "word", "n"],
                    )

    counts = docs.select("lang", "text").mapInArrow(run, "lang string, word bigint, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = written(counts, "words")
    total = counts.where("word is null").select("lang", F.col("n").alias("total"))
    rows = counts.where("word is not null").join(F.broadcast(total), "lang").where(F.col("n") >= share / 2 * F.col("total")).select("lang", "word").collect()
    out: dict[str, list[int]] = {}
    for r in rows:
        out.setdefault(r["lang"], []).append(r["word"])
    return {lang: np.sort(np.asarray(words, np.int64).view(np.uint64)) for lang, words in out.items()}


def _histograms(docs: DataFrame, vocabulary: dict[str, np.ndarray]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = np.zeros(0, np.uint64)
        for batch in batches:
            for i, j in parts(batch.column("text")):
                part = batch.slice(i, j - i)
                data, at = buffer_of(part.column("text"))
                words = find_words(data, at, NOT_SPACE, fold=False)
                base = _base(data, at, words)
                n = j - i
                doc_of = np.repeat(np.arange(n, dtype=np.int32), np.diff(at))
                chars = np.bincount(doc_of * 11 + _CLASS[data], minlength=n * 11).reshape(n, 11)[:, :10]
                languages = part.column("lang").to_pylist()
                sizes, counts = [0], []
                for row, lang in enumerate(languages):
                    known = vocabulary.get(lang, nothing)
                    own = words.hash[words.first[row] : words.first[row + 1]]
                    place = np.searchsorted(known, own)
                    hit = place < len(known)
                    hit[hit] = known[place[hit]] == own[hit]
                    counts.append(np.append(np.bincount(place[hit], minlength=len(known)), len(own) - int(hit.sum())))
                    sizes.append(sizes[-1] + len(counts[-1]))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), part.column("lang"), *(pa.array(b.astype(np.int64)) for b in base),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, n * 10 + 1, 10, dtype=np.int32)), pa.array(chars.reshape(-1).astype(np.int64))),
                        pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(counts).astype(np.int64) if counts else np.zeros(0, np.int64))),
                    ],
                    ["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "chars", "words"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "lang", "text").mapInArrow(
        run, f"doc_id {kind}, lang string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, chars array<bigint>, words array<bigint>"
    )


def _reference(rows: DataFrame, column: str) -> dict[str, np.ndarray]:
    """Sum of a histogram column by language: as many numbers as the histograms have classes."""
    sums = rows.select("lang", F.posexplode(column).alias("at", "n")).groupBy("lang", "at").agg(F.sum("n").alias("n")).collect()
    out: dict[str, dict[int, int]] = {}
    for r in sums:
        out.setdefault(r["lang"], {})[r["at"]] = r["n"]
    return {lang: np.asarray([by[i] for i in range(len(by))], float) for lang, by in out.items()}


def _common_classes(reference: np.ndarray) -> np.ndarray:
    """The classes of a word histogram whose exact share is at least ``SHARE``; the last class holds all others and is left out."""
    return np.flatnonzero(reference[:-1] >= SHARE * reference.sum())


def _folded(counts: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """A word histogram with every class but ``classes`` added to the class of all others."""
    return np.append(counts[classes], counts.sum() - counts[classes].sum())


def js_distance(counts: np.ndarray, reference: np.ndarray) -> float:
    """Jensen-Shannon distance (root of the divergence, base 2) of two histograms; 0 if one is empty."""
    if not counts.sum() or not reference.sum():
        return 0.0
    p, q = counts / counts.sum(), reference / reference.sum()
    m = (p + q) / 2
    term = lambda x: float((x[x > 0] * np.log2(x[x > 0] / m[x > 0])).sum())
    return float(np.sqrt(max(0.0, (term(p) + term(q)) / 2)))


def measure(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_chars,
    char_distance and word_distance."""
    docs = docs.select("doc_id", language(F.col("lang")).alias("lang"), "text")
    rows = written(_histograms(docs, common_words(docs)), "histograms")
    chars, words = _reference(rows, "chars"), _reference(rows, "words")
    classes = {lang: _common_classes(reference) for lang, reference in words.items()}
    words = {lang: _folded(reference, classes[lang]) for lang, reference in words.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            far = [[], []]
            for c, (column, reference) in enumerate((("chars", chars), ("words", words))):
                lists = batch.column(column)
                flat, at = lists.values.to_numpy(), lists.offsets.to_numpy()
                own = (flat[at[r] : at[r + 1]] for r in range(len(langs)))
                far[c] = [js_distance(_folded(h, classes[lang]) if column == "words" else h, reference[lang]) for h, lang in zip(own, langs)]
            lists = batch.column("chars")
            flat, at = lists.values.to_numpy(), lists.offsets.to_numpy()
            total = np.add.reduceat(np.append(flat, 0), at[:-1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(total), pa.array(far[0], pa.float64()), pa.array(far[1], pa.float64())], [*batch.schema.names[:-2], "n_chars", "char_distance", "word_distance"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"doc_id {kind}, lang string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_chars bigint, char_distance double, word_distance double"
    )


def apply_rules(docs: DataFrame) -> DataFrame:
    """``measure`` with base_failed (too short or too repetitive) and kept (false also where a distance is beyond its limit)."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    far = lambda d, n, limit, scatter, least: (F.col(n) >= least) & (F.col(d) > limit + scatter / F.sqrt(n))
    odd = far("char_distance", "n_chars", CHAR_LIMIT, CHAR_SCATTER, CHAR_LEAST) | far("word_distance", "n_words", WORD_LIMIT, WORD_SCATTER, WORD_LEAST)
    return measure(docs).withColumn("base_failed", base).withColumn("kept", ~base & ~odd)
