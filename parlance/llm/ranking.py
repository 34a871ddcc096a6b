"""Ranked lexical search by an Aho-Corasick scan of the texts themselves.

The distinct terms of a block of items form one automaton whose patterns carry a guard on both
sides, `` term ``, so that only whole terms are met.  It is sent to the tasks, which read documents
in batches: every byte that is no term character becomes a space, texts are set apart by spaces,
and one pass of the automaton gives all occurrences in a batch.  An output is a term number; a table
from terms to items turns counts into the items' scores.  There is no index of the documents and no row
per occurrence.

One pass gathers N, L and df of the block's terms (as many numbers as the block has terms); a second
one scores.  A task keeps the best ``k`` documents of each item seen so far (a document below the
k-th best of its own task cannot be among the k best of all), and these candidates are reduced in
two steps, first within (item, part), then within the item.

Items are dealt into blocks of at most about BLOCK bytes of terms, one automaton each, so what is
broadcast is bounded however many items there are.  An item of more terms than that is cut into
several blocks by term: each gives its part of the score of every document that holds one of them,
and the parts are added by document before ranking.

Defined results: null texts have no terms and are no documents of the collection; null ids rank
behind others of the same score; repeated rows are documents of their own; rows of one item_id
(nulls: one item too) are one item with the terms of all; items without terms, or whose terms no document holds, give no
rows; empty tables give an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.common import summed_counts, written
from parlance.llm.words import ALNUM, FOLD, buffer_of, parts

#: Bytes of terms (with their guards) of one automaton.
BLOCK = 1 << 20
#: Bytes of text scanned in one go, and the most scores (documents x items) held at once.
WINDOW, SCORES = 1 << 19, 1 << 20
#: Candidates a task gathers before it drops those below the best k.
GATHER = 1 << 18
#: Parts in which candidates of one item are ranked before all of them are.
PARTS = 256

#: A term is a run of these characters; a Java pattern.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_GUARD = np.where(ALNUM, FOLD, np.uint8(0x20))


class TermScanner:
    """Counts the terms of a batch of texts; ``terms`` are lower-case and distinct."""

    def __init__(self, terms: list[str]):
        import ahocorasick

        self.size = len(terms)
        self.automaton = ahocorasick.Automaton()
        for i, term in enumerate(terms):  # bytes as characters of the same number
            self.automaton.add_word(f" {term.encode().decode('latin-1')} ", i)
        if terms:
            self.automaton.make_automaton()

    def count(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Terms of each text, with repeats; then (text, term, occurrences) of those known, in order."""
        data, at = buffer_of(texts)
        total, keys, counts = np.zeros(len(texts), np.int64), [], []
        a = 0
        while a < len(data):
            b = min(a + WINDOW, len(data))
            while b < len(data) and ALNUM[data[b]] and ALNUM[data[b - 1]]:  # go on to the end of the term
                gap = np.flatnonzero(~ALNUM[data[b : b + WINDOW]])
                b = b + int(gap[0]) if len(gap) else min(b + WINDOW, len(data))
            first = int(np.searchsorted(at, a, "right")) - 1
            cut = at[first + 1 : int(np.searchsorted(at, b))] - a  # where further texts begin in this window
            guarded = np.concatenate([[0x20], np.insert(_GUARD[data[a:b]], cut, 0x20), [0x20]]).astype(np.uint8)
            begin = cut + np.arange(len(cut)) + 1  # the guard in front of each of them
            inside = guarded != 0x20
            starts = np.flatnonzero(inside[1:] & ~inside[:-1])
            total += np.bincount(first + np.searchsorted(begin, starts, "right"), minlength=len(texts))
            if self.size:
                hits = np.fromiter((x for hit in self.automaton.iter(guarded.tobytes().decode("latin-1")) for x in hit), np.int64).reshape(-1, 2)
                text = first + np.searchsorted(begin, hits[:, 0] - 1, "right")
                key, n = np.unique(text * self.size + hits[:, 1], return_counts=True)
                keys.append(key)
                counts.append(n)
            a = b
        if not keys:
            return total, *(np.zeros(0, np.int64),) * 3
        key, back = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(back, np.concatenate(counts), len(key)).astype(np.int64)
        return total, key // self.size, key % self.size, n


class Block:
    """Terms of some items: ``items`` their ids, and the pairs (term, item) in the order of terms."""

    def __init__(self, pairs: list[tuple[object, str]]):
        self.items = sorted({i for i, _ in pairs}, key=lambda i: (i is None, i))
        self.terms = sorted({t for _, t in pairs})
        item, term = {i: n for n, i in enumerate(self.items)}, {t: n for n, t in enumerate(self.terms)}
        both = sorted({(term[t], item[i]) for i, t in pairs})
        self.of_item = np.array([i for _, i in both], np.int64)
        self.first = np.searchsorted(np.array([t for t, _ in both], np.int64), np.arange(len(self.terms) + 1))

    def statistics(self, docs: DataFrame) -> tuple[int, int, np.ndarray]:
        """N, L and the df of each term."""
        shared, size = docs.sparkSession.sparkContext.broadcast(self.terms), len(self.terms)
        made: list[TermScanner] = []

        def count(batch: pa.RecordBatch) -> np.ndarray:
            made or made.append(TermScanner(shared.value))
            out = np.zeros(size + 2, np.int64)
            texts = batch.column("text")
            for i, j in parts(texts):
                total, _, term, _ = made[0].count(texts.slice(i, j - i))
                out[:size] += np.bincount(term, minlength=size)
                out[size:] += (np.count_nonzero(total), total.sum())
            return out

        found = summed_counts(docs.select("text"), count, size + 2)
        return int(found[size]), int(found[size + 1]), found[:size]

    def scored(self, docs: DataFrame, statistics: tuple[int, int, np.ndarray], k: int | None) -> DataFrame:
        """item (number in the block), doc_id, score, row; the best k of each task, or all above 0 for ``k`` None."""
        n_docs, length, df = statistics
        weight = np.floor(1000 * np.log((2.0 * n_docs + 2) / (2.0 * df + 1))).astype(np.int64)
        spark = docs.sparkSession
        shared = spark.sparkContext.broadcast((self.terms, self.of_item, self.first, weight))
        n_items = len(self.items)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            terms, of_item, first, weight = shared.value
            scanner, best = TermScanner(terms), _Best(n_items, k)
            most = max(1, SCORES // n_items)
            for batch in batches:
                texts = batch.column("text")
                for i, j in parts(texts):
                    for p in range(i, j, most):
                        q = min(p + most, j)
                        total, text, term, tf = scanner.count(texts.slice(p, q - p))
                        m = 50 + 50 * total * n_docs // max(length, 1)
                        value = weight[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[text]))
                        fan = first[term + 1] - first[term]
                        step = np.arange(int(fan.sum())) - np.repeat(np.cumsum(fan) - fan, fan)
                        score = np.zeros((q - p) * n_items, np.int64)
                        np.add.at(score, np.repeat(text, fan) * n_items + of_item[np.repeat(first[term], fan) + step], np.repeat(value, fan))
                        best.offer(score.reshape(-1, n_items), batch.slice(p, q - p))
                if k is None:
                    yield from best.rows()
            if k is not None:
                yield from best.rows()

        return docs.select("doc_id", "text", "row").mapInArrow(run, f"item int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score bigint, row bigint")


class _Best:
    """The best ``k`` documents of each item among those offered so far (all for None)."""

    def __init__(self, items: int, k: int | None):
        self.k, self.floor = k, np.ones(items, np.int64)  # a score from which a document may count
        self.kept: list[pa.RecordBatch] = []
        self.n = 0

    def offer(self, scores: np.ndarray, rows: pa.RecordBatch) -> None:
        doc, item = np.nonzero(scores >= self.floor)
        if not len(doc):
            return
        at = pa.array(doc)
        self.kept.append(pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), rows.column("doc_id").take(at), pa.array(scores[doc, item]), rows.column("row").take(at)], ["item", "doc_id", "score", "row"]))
        self.n += len(doc)
        if self.k is not None and self.n > GATHER:
            self._prune()

    def _prune(self) -> None:
        table = pa.Table.from_batches(self.kept).sort_by([("item", "ascending"), ("score", "descending"), ("doc_id", "ascending")])
        item = table.column("item").to_numpy()
        start = np.searchsorted(item, np.arange(len(self.floor)))
        place = np.arange(len(item)) - start[item]
        last = np.flatnonzero(place == self.k - 1)
        self.floor[item[last]] = table.column("score").to_numpy()[last]  # equal scores may still win by their id
        self.kept = table.take(pa.array(np.flatnonzero(place < self.k))).combine_chunks().to_batches()
        self.n = sum(b.num_rows for b in self.kept)

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.k is not None and self.kept:
            self._prune()
        out, self.kept, self.n = self.kept, [], 0
        yield from out


def _best(df: DataFrame, k: int, *keys: str) -> DataFrame:
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of every item."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    folded = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    pairs = items.select("item_id", F.explode(F.array_distinct(F.regexp_extract_all(folded, F.lit(TERM), F.lit(0)))).alias("term")).distinct()
    bytes_ = F.sum(F.octet_length("term").cast("bigint") + 2)
    per_item = pairs.groupBy("item_id").agg(bytes_.alias("b"))
    total, large = per_item.agg(F.sum(F.when(F.col("b") <= BLOCK, F.col("b"))), F.coalesce(F.max("b"), F.lit(0))).first()
    kind = items.schema["item_id"].dataType
    result = spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score bigint")
    small = pairs
    if large > BLOCK:
        giants = [r["item_id"] for r in per_item.where(F.col("b") > BLOCK).select("item_id").collect()]
        listed, stored = F.lit(False), written(docs, "ranked-rows")  # row numbers that several passes agree on
        for g in giants:
            listed = listed | F.col("item_id").eqNullSafe(F.lit(g))
            result = result.unionByName(_rank_giant(stored, pairs.where(F.col("item_id").eqNullSafe(F.lit(g))), g, kind, k))
        small = pairs.where(~listed)
    blocks = -(-(total or 0) // BLOCK)
    for b in range(blocks):
        some = small if blocks == 1 else small.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        block = Block([(r["item_id"], r["term"]) for r in some.collect()])
        if not block.items:
            continue
        found = block.scored(docs, block.statistics(docs), k).withColumn("part", F.pmod(F.xxhash64("row"), F.lit(PARTS)))
        top = _best(_best(found, k, "item", "part"), k, "item")
        names = spark.createDataFrame(list(enumerate(block.items)), f"item int, item_id {kind.simpleString()}")
        result = result.unionByName(top.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return result


def _rank_giant(docs: DataFrame, pairs: DataFrame, item: object, kind, k: int) -> DataFrame:
    """One item of many terms: the parts of each document's score, from one block after another, added by its row."""
    size = pairs.agg(F.sum(F.octet_length("term").cast("bigint") + 2)).first()[0]
    blocks, parts_ = -(-size // BLOCK), None
    for b in range(blocks):
        terms = [(item, r["term"]) for r in pairs.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == b).collect()]
        if terms:
            block = Block(terms)
            found = block.scored(docs, block.statistics(docs), None)
            parts_ = found if parts_ is None else parts_.unionByName(found)
    whole = parts_.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sum("score").alias("score")).withColumn("part", F.pmod(F.xxhash64("row"), F.lit(PARTS)))
    top = _best(_best(whole, k, "part").withColumn("one", F.lit(0)), k, "one")
    return top.select(F.lit(item).cast(kind).alias("item_id"), "rank", "doc_id", "score")
