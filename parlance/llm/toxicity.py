"""Toxic documents and the sentences that make them so: multiple-instance learning.

A document is a bag of sentences and toxic if one of them is.  A sentence scores
p = sigmoid(bias + sum of the weights of its words), a document 1 - prod(1 - p)
(noisy-or).  Labels are known for documents only; the gradient of the document's loss
goes to its sentences, so the sentences that explain a label are found on the way.

Features are two per word, hashed into ``SLOTS`` weights: the word, and its first bytes with
its length (spelling families).  Those that toxic documents hold significantly more often
than others get weights.  Training takes at most ``sample`` labelled
documents of each class (the first by a hash of the id), their whole texts, weighted
back to the share of the classes; of rows that share an id the one whose text has the
smallest MD5 stands for the document.  Of each class documents are taken until
``sample_bytes`` of text are reached, so training, which runs in one task, holds at most
that and one document more.  Scoring runs over all texts.

Defined results: null and empty texts and texts without words score 0; rows without a
label are scored like any other; labels other than null and 0 count as toxic, of several
for one document the largest; without labels of both classes every score is 0; repeated
rows get equal scores; extra columns are ignored or, in ``without_toxic``, kept.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.words import _BYTE, _POW, ALNUM, FOLD, Words, _class, buffer_of, find_words, mix64, parts

SLOTS = 1 << 18
#: Labelled documents of each class that training takes at most.
SAMPLE = 6000
#: Bytes of text of each class after which training takes no further document.
SAMPLE_BYTES = 64 << 20
_PREFIX = 6
_END = _class((0x0A, 0x0A), (0x21, 0x21), (0x2E, 0x2E), (0x3F, 0x3F))  # \n ! . ?
STEPS, RATE, DECAY, BIAS, Z = 150, 0.1, 1e-6, -5.0, 3.5


def _features(data: np.ndarray, words: Words) -> np.ndarray:
    """Slots of the two features of each word, shape (words, 2)."""
    family = (np.minimum(words.end - words.start, 24)).astype(np.uint64) << np.uint64(56)
    for j in range(_PREFIX):
        at = words.start + j
        inside = at < words.end
        family += np.where(inside, _BYTE[FOLD[data[np.minimum(at, len(data) - 1)]]] * _POW[j], np.uint64(0))
    out = np.stack([words.hash, mix64(family + np.uint64(1))], 1)
    return (out & np.uint64(SLOTS - 1)).astype(np.int32)


def _sentences(data: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """First word of each sentence with words, and its document."""
    end = np.searchsorted(np.flatnonzero(_END[data]), words.start)
    new = np.ones(len(end), bool)
    new[1:] = (end[1:] != end[:-1]) | (words.doc[1:] != words.doc[:-1])
    first = np.flatnonzero(new)
    return first, words.doc[first]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, first) if len(first) else np.zeros(0)


def _noisy_or(z: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """log(1 - P) of each of n documents; 0 for those without sentences."""
    return -np.bincount(doc, weights=np.logaddexp(0, z), minlength=n)


def _count_documents(found: np.ndarray, slot: np.ndarray, doc: np.ndarray, toxic: np.ndarray) -> None:
    """Add to ``found`` (2 x SLOTS), by label, in how many documents each slot is."""
    for column in range(slot.shape[1]):
        pairs = np.unique(doc.astype(np.int64) * SLOTS + slot[:, column])
        for label in (0, 1):
            found[label] += np.bincount(pairs[toxic[pairs // SLOTS] == bool(label)] % SLOTS, minlength=SLOTS)


def _telling(found: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Slots found in toxic documents more often than chance explains: log odds ratio over its standard error >= ``Z``."""
    of = np.asarray([[(~toxic).sum()], [toxic.sum()]])
    with_, without = found + 0.5, np.maximum(of - found, 0) + 0.5
    odds = np.log(with_ / without)
    error = np.sqrt((1 / with_ + 1 / without).sum(0))
    return np.flatnonzero((odds[1] - odds[0]) / error >= Z)


def _no_weights() -> np.ndarray:
    """A model that finds nothing toxic."""
    weights = np.zeros(SLOTS + 1, np.float32)
    weights[-1] = -40
    return weights


def fit(labelled: Iterable[tuple[pa.Array, np.ndarray]], share: float) -> np.ndarray:
    """Weights (bias last) from batches of whole texts and their labels; ``share`` is the share of toxic labels overall.

    Texts are read once and not kept: of each word two slots stay, and of those only the telling ones."""
    slots, sizes, docs, labels, rows = [], [], [], [], 0
    found = np.zeros((2, SLOTS))
    for texts, toxic in labelled:
        labels.append(toxic)
        for i, j in parts(texts):
            data, at = buffer_of(texts.slice(i, j - i))
            words = find_words(data, at, ALNUM)
            first, doc = _sentences(data, words)
            size = np.diff(np.append(first, len(words.start)))
            slots.append(_features(data, words))
            sizes.append(size)
            docs.append(doc + rows)
            _count_documents(found, slots[-1], np.repeat(doc, size), toxic[i:j])
            rows += j - i
    weights = _no_weights()
    toxic = np.concatenate(labels) if labels else np.zeros(0, bool)
    if not any(map(len, slots)) or not toxic.any() or toxic.all():
        return weights
    names = _telling(found, toxic)
    index = np.full(SLOTS, len(names), np.int32)
    index[names] = np.arange(len(names))
    sentences, told_slots, told_sentences = 0, [], []
    for k, size in enumerate(sizes):
        slot = index[slots[k]]
        slots[k] = None
        # words without a telling feature change nothing: leave them out
        told = (slot < len(names)).any(1)
        told_slots.append(slot[told])
        told_sentences.append(np.repeat(np.arange(sentences, sentences + len(size)), size)[told])
        sentences += len(size)
    slot, sentence_of, doc, n = np.concatenate(told_slots), np.concatenate(told_sentences), np.concatenate(docs), len(toxic)
    w, b = np.zeros(len(names) + 1), BIAS
    weight = np.where(toxic, share / toxic.mean(), (1 - share) / (1 - toxic.mean()))
    weight /= weight.sum()
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, STEPS + 1):
        z = b + np.bincount(sentence_of, weights=w[slot].sum(1), minlength=sentences)
        p = _sigmoid(z)
        log_not = np.minimum(_noisy_or(z, doc, n), -1e-12)
        odds = np.exp(log_not) / -np.expm1(log_not)
        g = (np.where(toxic, -odds, 1.0) * weight)[doc] * p
        word_g = g[sentence_of]
        gw = sum(np.bincount(slot[:, c], weights=word_g, minlength=len(w)) for c in range(2)) + DECAY * w
        gw[-1] = 0
        gb = g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        scale = np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
        w -= RATE * scale * m / (np.sqrt(v) + 1e-7)
        b -= RATE * scale * mb / (np.sqrt(vb) + 1e-7)
    weights[names] = w[:-1]
    weights[-1] = b
    return weights


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> np.ndarray:
    """Weights learned from at most ``sample`` labelled documents of each class that are not held out, one row of
    each, as far as ``sample_bytes`` of text."""
    known = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg((F.max(F.abs("toxic")) > 0).alias("toxic"))
    )
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = counts.get(True, 0) / max(1, sum(counts.values()))
    order = F.xxhash64("doc_id")
    chosen = [known.where(F.col("toxic") == is_toxic).orderBy(order, "doc_id").limit(sample) for is_toxic in (True, False)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def labelled() -> Iterator[tuple[pa.Array, np.ndarray]]:
            taken = {True: 0, False: 0}
            for batch in batches:
                mask = []
                for toxic, size in zip(batch.column("toxic").to_pylist(), pc.binary_length(batch.column("text")).to_pylist()):
                    mask.append(taken[toxic] < sample_bytes)
                    taken[toxic] += size or 0
                kept = batch.filter(pa.array(mask, pa.bool_()))
                yield kept.column("text"), kept.column("toxic").to_numpy(zero_copy_only=False)

        weights = fit(labelled(), share)
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary())], ["weights"])

    few = docs.select("doc_id", "text").join(F.broadcast(chosen[0].union(chosen[1])), "doc_id")  # 2 * sample ids
    first = F.min(F.when(F.col("text").isNotNull(), F.struct(F.md5("text").alias("md5"), "text")))
    single = few.groupBy("doc_id", "toxic").agg(first.alias("first")).select("doc_id", F.col("first.text").alias("text"), "toxic")
    rows = single.repartition(1).sortWithinPartitions(order, "doc_id").select("text", "toxic").mapInArrow(run, "weights binary").collect()
    return np.frombuffer(bytes(rows[0]["weights"]), np.float32) if rows else _no_weights()


def _part_scores(texts: pa.Array, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, Words]:
    """Document scores; and of each sentence its logit, document, first and last word."""
    data, at = buffer_of(texts)
    words = find_words(data, at, ALNUM)
    first, doc = _sentences(data, words)
    z = weights[-1] + _sums(weights[:-1][_features(data, words)].sum(1, dtype=np.float64), first)
    return -np.expm1(_noisy_or(z, doc, len(at) - 1)), z, doc, first, np.append(first[1:], len(words.start)) - 1, words


def _scores(texts: pa.Array, weights: np.ndarray) -> np.ndarray:
    return np.concatenate([_part_scores(texts.slice(i, j - i), weights)[0] for i, j in parts(texts)] or [np.zeros(0)])


def score_documents(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id and score (0 to 1) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_scores(batch.column("text"), weights))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def toxic_sentences(docs: DataFrame, weights: np.ndarray, least: float = 0.5) -> DataFrame:
    """The offending sentences: doc_id, start and end (code points, first to last word), p and text of every sentence scoring ``least`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, j in parts(batch.column("text")):
                part = batch.slice(i, j - i)
                data, at = buffer_of(part.column("text"))
                _, z, doc, first, last, words = _part_scores(part.column("text"), weights)
                p = _sigmoid(z)
                for s in np.flatnonzero(p >= least).tolist():
                    a, b, begin = words.start[first[s]], words.end[last[s]], at[doc[s]]
                    front, body = (bytes(data[x:y]).decode("utf-8", "replace") for x, y in ((begin, a), (a, b)))
                    out.append({"doc_id": part.column("doc_id")[int(doc[s])].as_py(), "start": len(front), "end": len(front) + len(body), "p": float(p[s]), "text": body})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("doc_id", batch.schema.field("doc_id").type), ("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64()), ("text", pa.string())]))

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start bigint, end bigint, p double, text string")


def without_toxic(docs: DataFrame, weights: np.ndarray, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``least``, all columns as they were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch.column("text"), weights) < least))

    return docs.mapInArrow(run, docs.schema)
