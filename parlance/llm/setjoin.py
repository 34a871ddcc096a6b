"""Near-duplicate documents: a size-aware Jaccard join over word shingles.

A document's set holds the hashes of its distinct k-word shingles (of the whole word
sequence if it is shorter).  Documents link when ``den * |A & B| >= num * |A | B|``.

* Documents with equal sets are one node.
* Light sets (at most ``x`` shingles): two sets of sizes n and m link exactly if they
  share a subset of ``c = ceil(num (n + m) / (num + den))`` shingles, so every subset of
  that size is enumerated for each size m a partner may have, and equal subsets meet.
* Heavy sets: inverted lists.  Shingles are ordered by how frequent they are; of n
  shingles only the rarest n - ceil(num n / den) + 1 are listed, since linked sets share one of
  these.  Frequencies come from a sketch of ``COUNTERS`` counters over all documents (a
  fixed size; any order is right, a better one makes shorter lists).
* ``x`` is the boundary with the least cost: subsets enumerated below it against list
  entries scanned above it, both from the sizes of all sets.

Lists are not expanded into pairs.  A scan compares each entry with its neighbours, in an
order that differs from list to list, and verified links merge entries into components.
After a few scans (only over lists that still hold several components) entries are
compared with all entries of other components of their list, the largest component of a
list never with itself.  What that leaves out joins documents that are connected
already, so components are exact and a group of copies costs about as many pairs as it
has list entries.  Links are verified on whole sets.

Defined results: documents without words have no shingles and link with nothing; a row
with a null id keeps its size, links with nothing and gets a null component; repeated
rows are copies; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import free_name, hash_bitmap, written
from parlance.llm.words import NOT_SPACE, Words, buffer_of, find_words, mix64, parts, shingles

#: Counters of the frequency sketch: 8 MiB on every task.
COUNTERS = 1 << 21
_SLICES = 1024
#: The boundary between light and heavy sets is at most this; whole light sets are kept up to here.
MAX_LIGHT = 24
#: Scans of the lists: all but the last compare neighbours only, the last all entries of different components.
SCANS = 3
#: 64-bit words of a set's parity bitmap: bits that differ between two sets are shingles that only one of them has.
PARITY = 8
#: Bits of the bitmap of nodes whose sets are needed for verification: 4 MiB on every task.
BITS = 1 << 25


def required(n: int, m: int, num: int, den: int) -> int:
    """Shingles that linked sets of n and m shingles share at least."""
    return -(-num * (n + m) // (num + den))


def partner_sizes(n: int, num: int, den: int) -> range:
    return range(-(-num * n // den), den * n // num + 1)


def listed(n, num: int, den: int):
    """How many of the rarest shingles of a set of n are listed (works on columns and arrays)."""
    return n + (-num * n) // den + 1


def _tokens(words: Words, k: int, row: int, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sorted distinct shingle hashes of one text."""
    a, b = words.first[row], words.first[row + 1]
    if b - a >= k:
        return np.unique(hashes[first[row] : first[row + 1]])
    if b > a:
        h = np.asarray([b - a], np.uint64)
        for i in range(a, b):
            h = mix64(h + words.hash[i : i + 1])
        return h
    return np.zeros(0, np.uint64)


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) for the rows of a batch."""
    for i, j in parts(batch.column("text")):
        words = find_words(*buffer_of(batch.column("text").slice(i, j - i)), NOT_SPACE)
        hashes, index = shingles(words, k)
        first = np.searchsorted(index, words.first)
        for row in range(j - i):
            yield i + row, _tokens(words, k, row, hashes, first)


def frequency_sketch(docs: DataFrame, k: int) -> np.ndarray:
    """How often shingles of each of ``COUNTERS`` hash classes occur in all documents."""
    width = COUNTERS // _SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for i, j in parts(batch.column("text")):
                h, _ = shingles(find_words(*buffer_of(batch.column("text").slice(i, j - i)), NOT_SPACE), k)
                total += np.bincount((h & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        small = np.minimum(total, 0xFFFFFFFF).astype(np.uint32).reshape(_SLICES, width)
        yield _slices({s: small[s] for s in range(_SLICES) if small[s].any()}, np.uint32)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, counts in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist()):
                total[s] = total.get(s, 0) + np.frombuffer(counts, np.uint32).astype(np.int64)
        yield _slices({s: np.minimum(c, 0xFFFFFFFF) for s, c in total.items()}, np.uint32)

    ddl = "slice int, counts binary"
    rows = docs.select("text").mapInArrow(count, ddl).repartition("slice").mapInArrow(add, ddl).collect()  # _SLICES rows, 8 MiB in all
    out = np.zeros((_SLICES, width), np.uint32)
    for r in rows:
        out[r["slice"]] = np.frombuffer(bytes(r["counts"]), np.uint32)
    return out.reshape(-1)


def _slices(by: dict[int, np.ndarray], kind: type) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(by), pa.int32()), pa.array([c.astype(kind).tobytes() for c in by.values()], pa.binary())], ["slice", "counts"])


def _summaries(docs: DataFrame, sketch: np.ndarray, k: int, num: int, den: int) -> DataFrame:
    """doc_id, text_md5, n, sig (digest of the whole set), tokens (rarest first: the listed ones, all of a light set)
    scan (entries the lists of the listed ones may have), bits (of each of 64 * PARITY hash classes, whether an
    odd number of shingles is in it) and wide (the same in more classes for a large set, else empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ns, sigs, tokens, scans, sizes, bits, wides = [], [], [], [], [0], [], []
            for _, s in _sets(batch, k):
                n = len(s)
                ns.append(n)
                sigs.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                often = sketch[(s & np.uint64(COUNTERS - 1)).astype(np.int64)]
                order = np.argsort(often, kind="stable")  # ties by hash, since the set is sorted
                own = listed(n, num, den) if n else 0
                wide = _parity(s)
                bits.append(_folded(wide, PARITY))
                wides.append(wide if len(wide) > PARITY else wide[:0])
                scans.append(int(often[order[:own]].sum()))
                tokens.append(s[order[: max(own, n if n <= MAX_LIGHT else 0)]])
                sizes.append(sizes[-1] + len(tokens[-1]))
            flat = np.concatenate(tokens).view(np.int64) if tokens else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_md5"), pa.array(ns, pa.int64()), pa.array(sigs, pa.binary()), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat)), pa.array(scans, pa.int64()), pa.array(bits, pa.list_(pa.int64())), pa.array(wides, pa.list_(pa.int64()))],
                ["doc_id", "text_md5", "n", "sig", "tokens", "scan", "bits", "wide"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.md5("text").alias("text_md5"), "text").mapInArrow(run, f"doc_id {kind}, text_md5 string, n bigint, sig binary, tokens array<bigint>, scan bigint, bits array<bigint>, wide array<bigint>")


def boundary(nodes: DataFrame, num: int, den: int) -> int:
    """The light/heavy boundary of least cost, from the number of nodes of each size up to MAX_LIGHT."""
    rows = nodes.where(F.col("n") <= MAX_LIGHT).groupBy("n").agg(F.count(F.lit(1)).alias("c"), F.sum("scan").alias("s")).collect()
    count, scan = {r["n"]: r["c"] for r in rows}, {r["n"]: r["s"] for r in rows}
    best, least = 0, None
    for x in range(MAX_LIGHT + 1):
        subsets = sum(count.get(n, 0) * sum(comb(n, required(n, m, num, den)) for m in partner_sizes(n, num, den) if m <= x) for n in range(1, x + 1))
        # an entry is a row written and sorted, then compared with its list
        entries = sum(listed(n, num, den) * count.get(n, 0) + scan.get(n, 0) for n in range(1, MAX_LIGHT + 1) if den * n // num > x)
        if least is None or subsets + entries < least:
            best, least = x, subsets + entries
    return best


def light_links(nodes: DataFrame, x: int, num: int, den: int) -> DataFrame:
    """Links (a, b) among sets of at most ``x`` shingles.  Of sets meeting at a subset, the smaller sizes link
    with the larger ones; each links with the smallest node of the other size, which connects them all."""
    chosen = {(n, m): np.asarray(list(combinations(range(n), required(n, m, num, den)))) for n in range(1, x + 1) for m in partner_sizes(n, num, den) if 0 < m <= x}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_of, node = batch.column("n").to_numpy(), batch.column("node").to_numpy()
            for n in np.unique(n_of).tolist():
                rows = np.flatnonzero(n_of == n)
                for i in range(0, len(rows), 256):
                    some = rows[i : i + 256]
                    tokens = np.asarray(batch.column("tokens").take(pa.array(some)).flatten().to_numpy()).view(np.uint64).reshape(len(some), n)
                    tokens = mix64(tokens + np.uint64(0x51ED270B))
                    for m in partner_sizes(n, num, den):
                        if (n, m) in chosen:
                            picks = chosen[n, m]
                            key = np.zeros((len(some), len(picks)), np.uint64)
                            for c in range(picks.shape[1]):
                                key += tokens[:, picks[:, c]]
                            key = mix64(key.reshape(-1) + np.uint64(min(n, m) * 1000 + max(n, m)))
                            side = 0 if n < m else 1 if n > m else 2
                            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(key), side, np.int32)), pa.array(np.repeat(node[some], len(picks)))], ["key", "side", "node"])

    keys = nodes.where((F.col("n") > 0) & (F.col("n") <= x)).select("node", "n", "tokens").mapInArrow(run, "key bigint, side int, node bigint")
    side = lambda s: F.min(F.when(F.col("side").isin(s, 2), F.col("node")))
    meet = keys.groupBy("key").agg(side(0).alias("lo"), side(1).alias("hi"), F.count(F.lit(1)).alias("c")).where("c > 1 and lo is not null and hi is not null")
    return keys.join(meet, "key").select(F.col("node").alias("a"), F.least("lo", "hi").alias("b")).where("a <> b").distinct()


def _possible(n_a, n_b, at_a, at_b, num: int, den: int):
    """Whether sets can link that share a shingle at these places of their orders (columns or arrays)."""
    least = F.least if not isinstance(n_a, np.ndarray) else np.minimum
    fits = (den * n_a >= num * n_b) & (den * n_b >= num * n_a)
    most = least(at_a, at_b) + 1 + least(n_a - at_a - 1, n_b - at_b - 1)
    return fits & ((num + den) * most >= num * (n_a + n_b))


def _scan_lists(num: int, den: int, keep: bool):
    """Over entries (token, node, n, at, comp) sorted by token: the pairs (node, other) of neighbours in a list that
    are in different components and may link; with ``keep`` also, with null ``other``, the entries of lists of two
    or more.  A list cut by a batch is kept."""
    names = ["token", "node", "n", "at", "other"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token, node, n, at, comp = (batch.column(c).to_numpy() for c in ("token", "node", "n", "at", "comp"))
            if not len(token):
                continue
            same = token[1:] == token[:-1]
            if keep:
                listed_ = np.zeros(len(token), bool)
                listed_[1:] |= same
                listed_[:-1] |= same
                listed_[0] = listed_[-1] = True
                kept = pa.array(listed_)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).filter(kept) for c in names[:4]), pa.nulls(int(listed_.sum()), pa.int64())], names)
            i = np.flatnonzero(same & (comp[1:] != comp[:-1]))
            i = i[_possible(n[i], n[i + 1], at[i], at[i + 1], num, den)]
            if len(i):
                pair = np.unique(np.stack([np.minimum(node[i], node[i + 1]), np.maximum(node[i], node[i + 1])], 1), axis=0)
                gone = pa.nulls(len(pair), pa.int64())
                yield pa.RecordBatch.from_arrays([gone, pa.array(pair[:, 0]), gone, gone, pa.array(pair[:, 1])], names)

    return run


def _neighbours(entries: DataFrame, seed: int, num: int, den: int, keep: bool = False) -> DataFrame:
    """``_scan_lists`` over lists in an order that differs from list to list and by ``seed``, so that an entry
    meets other neighbours in each of its lists.  A range partitioning splits long lists."""
    order = F.pmod(F.xxhash64(F.lit(seed), "token", "node"), F.lit(1 << 16))
    dealt = entries.withColumn("order", order).repartitionByRange("token", "order", "node").sortWithinPartitions("token", "order", "node")
    return dealt.select("token", "node", "n", "at", "comp").mapInArrow(_scan_lists(num, den, keep), "token bigint, node bigint, n bigint, at bigint, other bigint")


def _parity(s: np.ndarray) -> np.ndarray:
    """Parity bitmap of a set as 64-bit words: PARITY of them for up to 128 * PARITY shingles, twice as many for twice as many."""
    words = PARITY
    while 128 * words < len(s):
        words *= 2
    odd = np.bincount((s >> np.uint64(32)).astype(np.int64) % (64 * words), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _folded(bits: np.ndarray, words: int) -> np.ndarray:
    """The same set's bitmap in fewer words."""
    return np.bitwise_xor.reduce(bits.reshape(-1, words), axis=0)


def _near_wide(num: int, den: int):
    """Keeps pairs that may link by the wide bitmaps of large sets (the larger of two widths folded to the smaller)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = (batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()).tolist()
            keep = []
            for total, x, y in zip(both, batch.column("wide_a"), batch.column("wide_b")):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                words = min(len(x), len(y))
                apart = int(np.unpackbits((_folded(x, words) ^ _folded(y, words)).view(np.uint8)).sum()) if words else 0
                keep.append((num + den) * (total - apart) >= 2 * num * total)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _near_bits(num: int, den: int) -> Column:
    """Whether sets can link whose parity bitmaps are ``bits_a`` and ``bits_b``: every bit that differs is a shingle not shared."""
    apart = sum((F.bit_count(F.col("bits_a")[i].bitwiseXOR(F.col("bits_b")[i])) for i in range(PARITY)), F.lit(0))
    both = F.col("n_a") + F.col("n_b")
    return (num + den) * (both - apart) >= 2 * num * both


def _whole_sets(docs: DataFrame, needed: DataFrame, k: int) -> DataFrame:
    """node, n, whole (the sorted set as bytes) of the ``needed`` nodes (node, rep, sig)."""
    bits = hash_bitmap(needed.select(F.xxhash64("rep").alias("h")), "h", BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = batch.column("h").to_numpy() % BITS
            batch = batch.filter(pa.array((bits[low >> 3] >> (low & 7).astype(np.uint8)) & 1 == 1))
            for i, j in parts(batch.column("text")):
                part = batch.slice(i, j - i)
                raw = [s.tobytes() for _, s in _sets(part, k)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([hashlib.blake2b(r, digest_size=16).digest() for r in raw], pa.binary()), pa.array(raw, pa.binary())], ["rep", "sig", "whole"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("doc_id").alias("h"), "text").mapInArrow(run, f"rep {kind}, sig binary, whole binary")
    return needed.join(found, ["rep", "sig"]).dropDuplicates(["node"]).select("node", "whole")


def _verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("left"), batch.column("right")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.searchsorted(x, y)
                at[at == len(x)] = 0
                both = int((x[at] == y).sum()) if len(x) else 0
                ok.append(den * both >= num * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return (
        pairs.join(sets.select(F.col("node").alias("a"), F.col("whole").alias("left")), "a")
        .join(sets.select(F.col("node").alias("b"), F.col("whole").alias("right")), "b")
        .select("a", "b", "left", "right")
        .mapInArrow(run, "a bigint, b bigint")
    )


def _linked(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs that link: by their bitmaps they may, and by the whole sets of their nodes they do."""
    bits = nodes.select("node", "n", "bits")
    for side in ("a", "b"):
        pairs = pairs.join(bits.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("bits").alias(f"bits_{side}")), side)
    pairs = pairs.where(_near_bits(num, den)).select("a", "b", "n_a", "n_b")
    wide = nodes.select("node", "wide")
    for side in ("a", "b"):
        pairs = pairs.join(wide.select(F.col("node").alias(side), F.col("wide").alias(f"wide_{side}")), side)
    pairs = written(pairs.select("a", "b", "n_a", "n_b", "wide_a", "wide_b").mapInArrow(_near_wide(num, den), "a bigint, b bigint"), "pairs")
    needed = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = written(_whole_sets(docs, nodes.select("node", "rep", "sig").join(needed, "node"), k), "whole")
    return _verify(pairs, sets, num, den)


def components(links: DataFrame) -> DataFrame:
    """node, comp (smallest node reachable) for every node of ``links`` (a, b).

    Every node takes its smallest neighbour as parent if that is smaller; parents are followed
    once more, links are drawn between parents, and so on until none is left.  Each round at
    least halves the nodes that still have links."""
    comp = None
    links = written(links.select("a", "b"), "links")
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        up = both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("up"))
        next_up = up.select(F.col("a").alias("up"), F.col("up").alias("upper"))
        up = written(up.join(next_up, "up").select("a", F.col("upper").alias("up")), "parents")
        left, right = up.select("a", F.col("up").alias("u")), up.select(F.col("a").alias("b"), F.col("up").alias("v"))
        links = written(
            links.join(left, "a").join(right, "b").where("u <> v").select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct(),
            "links",
        )
        if comp is None:
            comp = up.select(F.col("a").alias("node"), F.col("up").alias("comp"))
        else:
            higher = up.select(F.col("a").alias("comp"), F.col("up").alias("higher"))
            comp = comp.join(higher, "comp", "left").select("node", F.coalesce("higher", "comp").alias("comp"))
        comp = written(comp, "components")
    return links.select(F.col("a").alias("node"), F.col("b").alias("comp")) if comp is None else comp


def _merged(comp: DataFrame, links: DataFrame) -> DataFrame:
    """``comp`` (node, comp) after ``links`` (a, b) are added."""
    u, v = comp.select(F.col("node").alias("a"), F.col("comp").alias("u")), comp.select(F.col("node").alias("b"), F.col("comp").alias("v"))
    between = links.join(u, "a", "left").join(v, "b", "left").select(F.coalesce("u", "a").alias("a"), F.coalesce("v", "b").alias("b")).where("a <> b").distinct()
    upper = components(between)
    new = upper.join(comp.select("node"), "node", "left_anti")
    top = upper.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
    return written(comp.join(top, "comp", "left").select("node", F.coalesce("top", "comp").alias("comp")).union(new), "components")


def _unsettled(entries: DataFrame, comp: DataFrame) -> DataFrame:
    """The entries, with their components, of lists that hold more than one component."""
    entries = entries.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = entries.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("token")
    return entries.join(mixed, "token")


def _contested(entries: DataFrame, comp: DataFrame) -> DataFrame:
    """The entries, with their components, of lists that hold more than one component; ``main`` is the largest one of the list."""
    entries = entries.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    per = entries.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("c"))
    main = per.groupBy("token").agg(F.max(F.struct("c", "comp"))["comp"].alias("main"), F.count(F.lit(1)).alias("k")).where("k > 1")
    return entries.join(main.select("token", "main"), "token")


def _across(entries: DataFrame, bits: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) that share a listed shingle, may link by sizes, places and ``bits`` (node, bits), and are in different
    components; ``entries`` as ``_contested`` gives them."""
    entries = entries.join(bits, "node")
    b = entries.select("token", F.col("bits").alias("bits_b"), F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("at").alias("at_b"), F.col("comp").alias("comp_b"), (F.col("comp") == F.col("main")).alias("main_b"))
    a = entries.where("comp <> main").select("token", F.col("bits").alias("bits_a"), F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("at").alias("at_a"), F.col("comp").alias("comp_a"))
    met = a.join(b, "token").where((F.col("comp_a") != F.col("comp_b")) & (F.col("main_b") | (F.col("a") < F.col("b"))))
    met = met.where(_possible(F.col("n_a"), F.col("n_b"), F.col("at_a"), F.col("at_b"), num, den) & _near_bits(num, den))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, text_md5, n_shingles, component_id (smallest doc_id reachable by links of Jaccard >= num / den), one row per row."""
    summaries = written(_summaries(docs, frequency_sketch(docs, k), k, num, den), "sets")
    nodes = written(
        summaries.where("doc_id is not null and n > 0")
        .groupBy("sig").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.first("scan").alias("scan"), F.first("bits").alias("bits"), F.first("wide").alias("wide"))
        .withColumn("node", F.monotonically_increasing_id()),
        "nodes",
    )
    x = boundary(nodes, num, den)
    entries = (
        nodes.where(F.floor(F.col("n") * den / num) > x)
        .select("node", "n", F.posexplode(F.expr(f"slice(tokens, 1, cast(n - ceil({num} * n / {den}) + 1 as int))")).alias("at", "token"))
        .select("token", "node", "n", F.col("at").cast("bigint").alias("at"), F.col("node").alias("comp"))
    )
    scanned = written(_neighbours(entries, 0, num, den, keep=True), "lists")
    entries = scanned.where("other is null").drop("other")
    seen = written(scanned.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")).distinct(), "pairs")
    comp = components(_linked(docs, nodes, seen, k, num, den).union(light_links(nodes, x, num, den)))
    for scan in range(1, SCANS + 1):
        last = scan == SCANS
        if last:
            # written, so that the many joins of the pairs plan it once
            pairs = _across(written(_contested(entries, comp), "contested"), nodes.select("node", "bits"), num, den)
        else:
            pairs = _neighbours(_unsettled(entries, comp), scan, num, den).select(F.col("node").alias("a"), F.col("other").alias("b")).distinct()
        pairs = written(pairs.join(seen, ["a", "b"], "left_anti"), "pairs")
        if not pairs.isEmpty():
            comp = _merged(comp, _linked(docs, nodes, pairs, k, num, den))
            seen = seen.union(pairs)
    class_of = nodes.select("node", "sig", "rep").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    smallest = class_of.groupBy("comp").agg(F.min("rep").alias("component_id"))
    by_sig = class_of.join(smallest, "comp").select("sig", "component_id")
    linked = summaries.where("doc_id is not null and n > 0").join(by_sig, "sig").select("doc_id", "text_md5", F.col("n").alias("n_shingles"), "component_id")
    alone = summaries.where("doc_id is null or n = 0").select("doc_id", "text_md5", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.union(alone)


def without_near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one row of every group of linked documents: that of the smallest doc_id (of several texts
    under it, the one of the smallest md5).  Rows without words or id stay.  All columns as they were."""
    md5 = free_name(docs, "text_md5")
    classes = near_duplicates(docs, k, num, den).where("doc_id is not null and n_shingles > 0")
    keys = ["doc_id", md5]
    classes = written(classes.select("doc_id", F.col("text_md5").alias(md5), "component_id"), "classes")
    keeper = classes.groupBy("component_id").agg(F.min(F.struct(*keys)).alias("keeper"))
    told = classes.join(keeper, "component_id").withColumn("keeps", F.struct(*keys) == F.col("keeper"))
    dropped = written(told.where(~F.col("keeps")).select(*keys).distinct(), "dropped")
    repeated = written(told.where("keeps").groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(*keys), "repeated")
    marked = written(dropped.union(repeated), "marked")
    named = docs.withColumn(md5, F.md5("text"))
    # only documents whose key is in the bitmap of dropped and repeated ones meet the tables; the others do not move
    sure, maybe = _by_bitmap(named, hash_bitmap(marked.select(F.xxhash64(*keys).alias("h")), "h", BITS), keys)
    rest = maybe.join(dropped, keys, "left_anti")
    if not repeated.isEmpty():
        rest = rest.join(repeated, keys, "left_anti").unionByName(rest.join(repeated, keys, "left_semi").dropDuplicates(keys))
    return sure.unionByName(rest).select(*docs.columns)


def _by_bitmap(df: DataFrame, bits: np.ndarray, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """``df`` in two: the rows whose ``keys`` hash to no set bit, and those whose do."""
    h = free_name(df, "_h")
    hashed = df.withColumn(h, F.xxhash64(*keys))

    def part(hit: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                low = batch.column(h).to_numpy() % BITS
                yield batch.filter(pa.array(((bits[low >> 3] >> (low & 7).astype(np.uint8)) & 1 == 1) == hit))

        return hashed.mapInArrow(run, hashed.schema).drop(h)

    return part(False), part(True)
