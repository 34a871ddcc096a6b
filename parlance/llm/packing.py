"""Documents packed into sequences of at most ``size`` tokens by exact-complement hashing.

Only documents longer than a sequence are cut.  How the pieces are packed depends on
how many there are of each length, so the plan is made from a histogram of at most
``size`` lengths: the longest pieces come first, and the gap each leaves is looked up
among the sums of one, two and three available lengths; a combination that fills the
gap exactly is used as often as the counts allow.  What finds no exact complement goes,
longest first, into the open sequence whose gap fits best (if best-fit alone needs fewer
sequences for these lengths, its plan is taken).  Every step uses up a length
or a kind of open sequence, so the plan's size is bounded by ``size`` too.  Pieces are
then ranked within their length and look up their sequence in the plan.

Tokens: the words of a batch are tokenized once each.  The tokenizer splits at white
space, between letters, digits and signs, so a text's ids are its words' ids in order.

Defined results: a null text is empty and one piece of the end id; repeated rows and
null ids are pieces like any other; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.common import literal_table, written
from parlance.llm.words import NOT_SPACE, SINGLE, _class, buffer_of, find_words, parts

#: Tokens of a sequence, and the id that ends a document.
SIZE, END = 2048, 0
#: Word hashes whose ids a worker keeps.
CACHE = 400_000
#: Bytes of text tokenized in one go.
PART = 1 << 19
#: Parts into which the pieces of one length are dealt before they are ranked.
SALTS = 64

# words are cut between ASCII letters (1), signs but the apostrophe (2) and digits (each alone)
_KINDS = np.zeros(256, np.uint8)
_KINDS[_class((0x21, 0x26), (0x28, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))] = 2
_KINDS[_class((0x41, 0x5A), (0x61, 0x7A))] = 1
_KINDS[_class((0x30, 0x39))] = SINGLE


@cache
def _tokenizer(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class _WordIds:
    """Ids of words, by word hash; forgets all when it is full.  Ids are kept one after another in flat arrays."""

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self.forget()

    def forget(self) -> None:
        self.at: dict[int, int] = {}
        self.first, self.ids = array("I", [0]), array("I")

    def of(self, hashes: np.ndarray, text_of) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, length) into the flat array of ids, for each hash; ``text_of(i)`` gives word i."""
        if len(self.at) > CACHE:
            self.forget()
        keys = hashes.tolist()
        place = np.fromiter((self.at.get(h, -1) for h in keys), np.int64, len(keys))
        new = np.flatnonzero(place < 0)
        if len(new):
            for i in range(0, len(new), 5000):
                some = new[i : i + 5000].tolist()
                for w, e in zip(some, self.tokenizer.encode_batch_fast([text_of(w) for w in some], add_special_tokens=False)):
                    self.at[keys[w]] = place[w] = len(self.first) - 1
                    self.ids.extend(e.ids)
                    self.first.append(len(self.ids))
        first = np.frombuffer(self.first, np.uint32)  # a view: gone before the next words are added
        begin, end = first[place].astype(np.int64), first[place + 1].astype(np.int64)
        return begin, end - begin, np.frombuffer(self.ids, np.uint32) if self.ids else np.zeros(0, np.uint32)


def _document_ids(texts: pa.Array, known: _WordIds) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, each with its end id, and where each begins."""
    data, at = buffer_of(texts)
    raw = data.tobytes()
    plain = b"<|" not in raw  # special tokens are known by their exact case
    words = find_words(data, at, NOT_SPACE, fold=plain, kinds=_KINDS if plain else None)
    distinct, example, which = np.unique(words.hash, return_index=True, return_inverse=True)
    start, end = words.start[example].tolist(), words.end[example].tolist()
    first, length, ids = known.of(distinct if plain else distinct ^ np.uint64(1), lambda i: raw[start[i] : end[i]].decode("utf-8", "replace"))
    first, length = first[which], length[which]
    del start, end, raw
    per_doc = np.add.reduceat(np.append(length, 0), np.minimum(words.first[:-1], len(length))) if len(at) > 1 else np.zeros(0, np.int64)
    per_doc = np.where(np.diff(words.first) > 0, per_doc, 0)
    begin = np.concatenate([[0], np.cumsum(per_doc + 1)])
    out = np.full(begin[-1], END, "<u4")
    total = int(length.sum())
    source = np.arange(total) + np.repeat(first - (np.cumsum(length) - length), length)
    out[np.arange(total) + np.repeat(words.doc, length)] = ids[source]
    return out, begin


def tokenize(docs: DataFrame, size: int = SIZE, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids if asked) of every piece."""
    path = tokenizer or _default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordIds(path)
        for batch in batches:
            for i, j in parts(batch.column("text"), PART):
                part = batch.slice(i, j - i)
                ids, begin = _document_ids(part.column("text"), known)
                count = np.diff(begin)
                pieces = -(-count // size)
                row = np.repeat(np.arange(j - i), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * size
                length = np.minimum(size, count[row] - start)
                a = begin[row] + start
                view = memoryview(ids).cast("B")
                crc = [zlib.crc32(view[4 * x : 4 * y]) for x, y in zip(a.tolist(), (a + length).tolist())]
                columns = [part.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                if with_ids:
                    ends = np.append(a, a[-1] + length[-1] if len(a) else 0).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids)


def _default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def exact_complement(free: np.ndarray, gap: int) -> tuple[int, ...] | None:
    """One, two or three lengths with ``free`` counts that add up to ``gap``; of those that do, one that can be used most often."""
    if gap < len(free) and free[gap]:
        return (gap,)

    def pair(gap: int, free: np.ndarray) -> tuple[int, tuple[int, int]] | None:
        a = np.arange(1, gap // 2 + 1)
        if not len(a):
            return None
        uses = np.minimum(free[a], free[gap - a])
        if gap % 2 == 0:
            uses[-1] = free[gap // 2] // 2
        best = int(uses.argmax())
        return (int(uses[best]), (int(a[best]), gap - int(a[best]))) if uses[best] > 0 else None

    two = pair(gap, free)
    if two:
        return two[1]
    for a in sorted(np.flatnonzero(free[: gap // 3 + 1]).tolist(), key=lambda a: -free[a]):
        less = free.copy()
        less[a] -= 1
        two = pair(gap - a, less)
        if two:
            return (a, *two[1])
    return None


def plan_packing(counts: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as (lengths, how many such sequences), for ``counts`` pieces of each length.

    Exact complements can use up small pieces that many large ones would have needed; where they
    leave sequences over the least possible number, best-fit alone is tried too and the shorter plan taken."""
    plan = _plan(counts, size, exact=True)
    needed = lambda plan: sum(times for _, times in plan)
    least = -(-sum(x * n for x, n in counts.items()) // size)
    return plan if needed(plan) == least else min(plan, _plan(counts, size, exact=False), key=needed)


def _plan(counts: dict[int, int], size: int, exact: bool) -> list[tuple[tuple[int, ...], int]]:
    free = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        free[length] = n
    out: list[tuple[tuple[int, ...], int]] = []
    for long in range(size, 0, -1) if exact else ():
        while free[long]:
            if long == size:
                lengths: tuple[int, ...] = (long,)
            else:
                free[long] -= 1
                rest = exact_complement(free, size - long)
                free[long] += 1
                if rest is None:
                    break
                lengths = (long, *rest)
            need = {x: lengths.count(x) for x in lengths}
            times = int(min(free[x] // k for x, k in need.items()))
            for x, k in need.items():
                free[x] -= times * k
            out.append((lengths, times))
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for long in range(size, 0, -1):
        while free[long]:
            gap = min((g for g in open_ if g >= long), default=None)
            if gap is not None:
                lengths, n = open_[gap].pop()
                times = int(min(n, free[long]))
                if n > times:
                    open_[gap].append((lengths, n - times))
                if not open_[gap]:
                    del open_[gap]
                made, left = (*lengths, long), gap - long
            else:
                each = int(min(size // long, free[long]))
                times, made, left = int(free[long] // each), (long,) * each, size - each * long
            free[long] -= times * made.count(long) if gap is None else times
            open_.setdefault(left, []).append((made, times))
    return out + [x for kinds in open_.values() for x in kinds]


def _plan_rows(plan: list[tuple[tuple[int, ...], int]]) -> list[dict]:
    """Ranks lo to hi of a length go, ``k`` to a sequence, into the sequences from ``sequence`` on, at ``offset``."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for lengths, times in plan:
        offset = 0
        for x in sorted(set(lengths), reverse=True):
            k, lo = lengths.count(x), used.get(x, 0)
            used[x] = lo + times * k
            out.append({"len": x, "lo": lo, "hi": used[x], "k": k, "sequence": sequence, "offset0": offset})
            offset += k * x
        sequence += times
    return out


def pack_pieces(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """``pieces`` (with ``length``; doc_id, piece and ids_crc32 order equals) plus sequence_id and offset."""
    keep = pieces.columns
    base = written(pieces.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")), "pieces")
    counts = base.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))  # at most size * SALTS rows
    by_length = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    plan = literal_table(base, _plan_rows(plan_packing(by_length, size)), "len:bigint,lo:bigint,hi:bigint,k:bigint,sequence:bigint,offset0:bigint")
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    nth = F.col("_rank") - F.col("lo")
    return (
        base.withColumn("_rank", rank)
        .join(F.broadcast(starts), ["length", "_salt"])
        .withColumn("_rank", F.col("_rank") + F.col("_before"))
        .join(F.broadcast(plan), (F.col("length") == F.col("len")) & (F.col("_rank") >= F.col("lo")) & (F.col("_rank") < F.col("hi")))
        .select(*keep, (F.col("sequence") + F.floor(nth / F.col("k"))).alias("sequence_id"), (F.col("offset0") + nth % F.col("k") * F.col("length")).alias("offset"))
    )


def pack_documents(docs: DataFrame, size: int = SIZE, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Every piece of ``docs`` with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids if asked)."""
    return pack_pieces(tokenize(docs, size, tokenizer, with_ids), size)
