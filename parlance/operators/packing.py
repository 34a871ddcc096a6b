"""AGG-3 / AGG-4: greedy sequential packing of segments into token budgets.

Semantics (per transcript, segments in ordinal order): keep a running count
``cur``; before adding a segment of ``n`` tokens, if ``cur + n > budget`` close
the current chunk (even when it is empty) and start a new one holding this
segment.  Hence an exact fit stays, an oversize segment gets a chunk of its own,
zero-token segments stay where they are, and an oversize *first* segment leaves
an empty chunk 0 (numbering then starts at 1).

Plan
----
The fold is order dependent, so it is not a window sum.  It is also the one
place where a single transcript must not end up in one task: a transcript is cut
into fragments of at most ``fragment_rows`` consecutive segments and every
fragment is processed in parallel.

* The fold: one shuffle on a key derived from transcript and fragment, a sort within
  partitions, and a ``mapInArrow`` pass that folds the sorted rows batch by batch with
  O(1) state carried across batch boundaries (no group is ever materialised).  It sees
  key, ordinal and token count only; other columns are joined to the chunk numbers afterwards.
* Transcripts of several fragments first: a fragment whose entering state is unknown is summarised as
  a piecewise function ``entering count -> (exit count, chunks closed)``; the
  greedy chains started from the different entry points are advanced together
  with ``numpy.searchsorted`` jumps, one step per chunk.  The summaries are
  composed in a tree (``fan_in`` children per node, so each task holds at most
  ``fan_in`` summaries of at most ``min(fragment_rows, budget) + 2`` rows), then
  entering states flow back down the tree and are joined to the fragments, and
  the same ``mapInArrow`` fold assigns final chunk numbers.

Rows keep all their columns; only ``chunk_no`` is added.  (key, ordinal) tells rows apart.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.functions.text import word_count
from parlance.session import ensure_checkpoint_dir

# Fixed value: the model batch budget, in whitespace words.
DEFAULT_BUDGET = 15000

DEFAULT_FRAGMENT_ROWS = 1 << 17
DEFAULT_FAN_IN = 512

_FUNC_SCHEMA = "lo long, is_shift boolean, val long, closes long"


# ---------------------------------------------------------------------------
# per-task numpy kernels


def _fold_groups(n, starts, ends, c_in, k_in, budget):
    """Greedy fold of several consecutive groups of one batch at once.

    ``n`` holds the token counts of all rows; group ``g`` covers rows
    ``starts[g]:ends[g]`` and enters with ``c_in[g]`` tokens already in its open
    chunk, whose number is ``k_in[g]``.  Returns (chunk_no per row, exit count,
    exit chunk number) per group.
    """
    m = len(n)
    P = np.cumsum(n, dtype=np.int64)
    Pex = P - n
    marks = np.zeros(m, dtype=np.int64)
    if m:
        # first close of each group: first j >= start with c_in + P[j] - Pex[start] > budget
        # (an entering count above the budget closes at the start itself)
        j = np.maximum(np.searchsorted(P, Pex[starts] - c_in + budget, side="right"), starts)
        last = np.full(len(starts), -1, dtype=np.int64)
        act = j < ends
        j, ends_a, idx = j[act], ends[act], np.nonzero(act)[0]
        while len(j):
            marks[j] = 1
            last[idx] = j
            nxt = np.maximum(np.searchsorted(P, Pex[j] + budget, side="right"), j + 1)
            keep = nxt < ends_a
            j, ends_a, idx = nxt[keep], ends_a[keep], idx[keep]
    csum = np.cumsum(marks)
    before = np.where(starts > 0, csum[np.maximum(starts - 1, 0)], 0)
    group_of_row = np.repeat(np.arange(len(starts)), ends - starts)
    chunk = k_in[group_of_row] + csum - before[group_of_row]
    closes = (csum[ends - 1] - before) if m else np.zeros(len(starts), dtype=np.int64)
    if m:
        total_from = np.where(last >= 0, Pex[np.maximum(last, 0)], Pex[starts])
        c_out = P[ends - 1] - total_from + np.where(last >= 0, 0, c_in)
    else:
        c_out = c_in
    return chunk, c_out, k_in + closes


def fragment_summary(n: np.ndarray, budget: int) -> pd.DataFrame:
    """Piecewise function of the entering count ``c`` in ``[0, budget + 1]``.

    Rows ``(lo, is_shift, val, closes)`` sorted by ``lo``; a row holds for
    ``lo <= c < next lo``.  A shift row means no chunk closes inside the fragment
    and the exit count is ``c + val``; otherwise the exit count is ``val`` after
    ``closes`` chunk closes.  (Counts above ``budget`` behave alike, so the top
    of the domain is ``budget + 1``.)
    """
    n = np.asarray(n, dtype=np.int64)
    m = len(n)
    P = np.cumsum(n)
    Pex = P - n
    total = int(P[-1])
    cmax = budget + 1
    cand = np.nonzero((n > 0) & (Pex <= budget))[0]
    if len(cand) == 0 or cand[0] != 0:
        cand = np.concatenate([[0], cand])
    lo = np.maximum(budget - P[cand] + 1, 0)
    # chains from every candidate first close, advanced together
    cur = cand.copy()
    closes = np.ones(len(cand), dtype=np.int64)
    act = np.arange(len(cand))
    while len(act):
        nxt = np.maximum(np.searchsorted(P, Pex[cur[act]] + budget, side="right"), cur[act] + 1)
        ok = nxt < m
        act = act[ok]
        cur[act] = nxt[ok]
        closes[act] += 1
    exit_c = total - Pex[cur]
    rows = pd.DataFrame({"lo": lo, "is_shift": False, "val": exit_c, "closes": closes})
    rows = rows[(rows.lo <= cmax)]
    if total <= budget:
        rows = pd.concat(
            [pd.DataFrame({"lo": [0], "is_shift": [True], "val": [total], "closes": [0]}), rows[rows.lo > budget - total]]
        )
    rows = rows.sort_values("lo", kind="stable").drop_duplicates("lo", keep="last")
    return _merge_runs(rows)


def _merge_runs(f: pd.DataFrame) -> pd.DataFrame:
    f = f.reset_index(drop=True)
    if len(f) <= 1:
        return f
    same = (
        (f.is_shift.values[1:] == f.is_shift.values[:-1])
        & (f.val.values[1:] == f.val.values[:-1])
        & (f.closes.values[1:] == f.closes.values[:-1])
    )
    keep = np.concatenate([[True], ~same])
    return f[keep].reset_index(drop=True)


def _evaluate(f: pd.DataFrame, c: int, budget: int):
    c = min(int(c), budget + 1)
    i = int(np.searchsorted(f.lo.values, c, side="right")) - 1
    if f.is_shift.values[i]:
        return c + int(f.val.values[i]), 0
    return int(f.val.values[i]), int(f.closes.values[i])


def compose(h: pd.DataFrame, g: pd.DataFrame, budget: int) -> pd.DataFrame:
    """Function ``g after h`` (fragment h is followed by fragment g)."""
    cmax = budget + 1
    h_lo, h_shift, h_val, h_closes = (h[c].to_numpy() for c in ("lo", "is_shift", "val", "closes"))
    g_lo, g_shift, g_val, g_closes = (g[c].to_numpy() for c in ("lo", "is_shift", "val", "closes"))
    h_shift, g_shift = h_shift.astype(bool), g_shift.astype(bool)
    his = np.append(h_lo[1:] - 1, cmax)
    # the values h yields: one for a constant piece, a range for a shifted one, split at g's breakpoints
    a = np.where(h_shift, h_lo + h_val, h_val)
    b = np.where(h_shift, np.minimum(his + h_val, cmax), h_val)
    first = np.searchsorted(g_lo, a, side="right") - 1
    count = np.where(a <= b, np.searchsorted(g_lo, b, side="right") - first, 0)
    piece = np.repeat(np.arange(len(a)), count)
    i = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count) + first[piece]
    shift, g_const = h_shift[piece], ~g_shift[i]
    value = np.where(shift, np.maximum(a[piece], g_lo[i]), a[piece])
    out = {
        "lo": np.where(shift, value - h_val[piece], h_lo[piece]),
        "is_shift": shift & ~g_const,
        "val": np.where(g_const, g_val[i], np.where(shift, h_val[piece] + g_val[i], value + g_val[i])),
        "closes": np.where(shift, 0, h_closes[piece]) + np.where(g_const, g_closes[i], 0),
    }
    return _merge_runs(pd.DataFrame(out))


# ---------------------------------------------------------------------------
# Spark plumbing


def _fold_batches(key, frag, tokens, budget, has_entry):
    def run(batches):
        carry_key, seen = None, False
        carry_state = (0, 0)
        for rb in batches:
            m = rb.num_rows
            if m == 0:
                continue
            kcol = rb.column(key)
            fcol = rb.column(frag) if frag else None
            # a null key is a key of its own
            change = pc.or_(
                pc.fill_null(pc.not_equal(kcol.slice(1), kcol.slice(0, m - 1)), False),
                pc.not_equal(pc.is_null(kcol.slice(1)), pc.is_null(kcol.slice(0, m - 1))),
            )
            if fcol is not None:
                change = pc.or_(change, pc.not_equal(fcol.slice(1), fcol.slice(0, m - 1)))
            change = np.asarray(change.to_numpy(zero_copy_only=False), dtype=bool)
            starts = np.concatenate([[0], np.nonzero(change)[0] + 1]).astype(np.int64)
            ends = np.append(starts[1:], m).astype(np.int64)
            if has_entry:
                c_in = np.asarray(rb.column("_c_in").to_numpy(zero_copy_only=False), dtype=np.int64)[starts]
                k_in = np.asarray(rb.column("_k_in").to_numpy(zero_copy_only=False), dtype=np.int64)[starts]
            else:
                c_in = np.zeros(len(starts), dtype=np.int64)
                k_in = np.zeros(len(starts), dtype=np.int64)
            first_key = (kcol[0].as_py(), fcol[0].as_py() if fcol is not None else None)
            if seen and first_key == carry_key:
                c_in[0], k_in[0] = carry_state
            n = np.asarray(pc.fill_null(rb.column(tokens), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            chunk, c_out, k_out = _fold_groups(n, starts, ends, c_in, k_in, budget)
            carry_key = (kcol[m - 1].as_py(), fcol[m - 1].as_py() if fcol is not None else None)
            carry_state, seen = (int(c_out[-1]), int(k_out[-1])), True
            yield rb.append_column("chunk_no", pa.array(chunk, type=pa.int64()))

    return run


def _clustered(df: DataFrame, *cols: str) -> DataFrame:
    """Hash-partition on a column derived from ``cols`` so that every group is in one
    partition.  ``mapInArrow`` declares no required distribution, so a plain
    ``repartition(cols)`` can be dropped as redundant when the child is already
    partitioned on ``cols`` (e.g. by a join), and AQE may later read that child
    through a local shuffle reader (join turned into a broadcast join), splitting
    groups.  A derived key is never redundant."""
    return df.withColumn("_cluster", F.xxhash64(*cols)).repartition("_cluster").drop("_cluster")


def _summaries(narrow: DataFrame, key: str, tokens: str, budget: int) -> DataFrame:
    """Level-0 function table: one piecewise function per (key, fragment)."""

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_ord", kind="stable")
        n = pdf[tokens].fillna(0).to_numpy(dtype=np.int64)
        if int(pdf._frag.iloc[0]) == 0:
            # the first fragment enters with an empty chunk 0: a constant function
            _, c_out, k_out = _fold_groups(
                n, np.array([0]), np.array([len(n)]), np.array([0]), np.array([0]), budget
            )
            f = pd.DataFrame({"lo": [0], "is_shift": [False], "val": [int(c_out[0])], "closes": [int(k_out[0])]})
        else:
            f = fragment_summary(n, budget)
        f.insert(0, "_node", int(pdf._frag.iloc[0]))
        f.insert(0, key, pdf[key].iloc[0])
        return f

    key_type = narrow.schema[key].dataType.simpleString()
    return narrow.groupBy(key, "_frag").applyInPandas(summarise, f"{key} {key_type}, _node long, {_FUNC_SCHEMA}")


def _up(funcs: DataFrame, key: str, key_type: str, fan_in: int, budget: int) -> DataFrame:
    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_node", "lo"], kind="stable")
        acc = None
        for _, f in pdf.groupby("_node", sort=True):
            f = f[["lo", "is_shift", "val", "closes"]].reset_index(drop=True)
            acc = f if acc is None else compose(acc, f, budget)
        acc.insert(0, "_node", int(pdf._node.iloc[0]) // fan_in)
        acc.insert(0, key, pdf[key].iloc[0])
        return acc

    return (
        funcs.withColumn("_parent", F.floor(F.col("_node") / fan_in))
        .groupBy(key, "_parent")
        .applyInPandas(combine, f"{key} {key_type}, _node long, {_FUNC_SCHEMA}")
    )


def _down(children: DataFrame, parents_entry: DataFrame, key: str, key_type: str, fan_in: int, budget: int) -> DataFrame:
    """Entering state of every child given the entering state of its parent."""

    def spread(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_node", "lo"], kind="stable")
        c, k = int(pdf._pc.iloc[0]), int(pdf._pk.iloc[0])
        out = []
        for node, f in pdf.groupby("_node", sort=True):
            out.append((pdf[key].iloc[0], int(node), c, k))
            f = f[["lo", "is_shift", "val", "closes"]].reset_index(drop=True)
            c, dk = _evaluate(f, c, budget)
            k += dk
        return pd.DataFrame(out, columns=[key, "_node", "_c_in", "_k_in"])

    parents = parents_entry.select(F.col(key).alias("_pkey"), F.col("_node").alias("_pnode"), F.col("_c_in").alias("_pc"), F.col("_k_in").alias("_pk"))
    joined = children.withColumn("_parent", F.floor(F.col("_node") / fan_in)).join(
        parents, F.col(key).eqNullSafe(F.col("_pkey")) & (F.col("_parent") == F.col("_pnode"))
    )
    return joined.groupBy(key, "_parent").applyInPandas(
        spread, f"{key} {key_type}, _node long, _c_in long, _k_in long"
    )


def pack_chunks(
    segments: DataFrame,
    budget: int = DEFAULT_BUDGET,
    *,
    key: str = "transcript_id",
    order: str = "seg_no",
    tokens: str = "n_tokens",
    fragment_rows: int = DEFAULT_FRAGMENT_ROWS,
    fan_in: int = DEFAULT_FAN_IN,
) -> DataFrame:
    """Add ``chunk_no`` (bigint) to every segment row.

    ``order`` must be a dense 0-based ordinal per key (``posexplode`` position or
    ``row_number() - 1``); fragments are ``order div fragment_rows``.  The plan is the
    same for every size: a transcript of one fragment has no summary and enters with
    (0, 0).  Null is a key like any other.
    """
    key_type = segments.schema[key].dataType.simpleString()
    out_schema = T.StructType(list(segments.schema.fields) + [T.StructField("chunk_no", T.LongType(), False)])

    with_frag = segments.withColumn("_frag", F.floor(F.col(order) / fragment_rows).cast("long"))
    narrow = with_frag.select(key, "_frag", F.col(order).alias("_ord"), tokens)
    long_keys = narrow.where(F.col("_frag") > 0).select(F.col(key).alias("_long")).distinct()
    narrow = narrow.join(long_keys, F.col(key).eqNullSafe(F.col("_long")), "left_semi")

    # up-sweep: composed functions per tree level, until every transcript is one node.
    # Each level is a small table (a few rows per fragment) used again by the down-sweep,
    # so it is written once to the checkpoint folder instead of being recomputed.
    ensure_checkpoint_dir(segments.sparkSession)
    levels = [_summaries(narrow, key, tokens, budget).checkpoint(eager=True)]
    while not levels[-1].where(F.col("_node") > 0).isEmpty():
        levels.append(_up(levels[-1], key, key_type, fan_in, budget).checkpoint(eager=True))
    # down-sweep: the root of every long transcript enters with (0, 0)
    entry = levels[-1].select(key, "_node").distinct().select(
        key, "_node", F.lit(0).cast("long").alias("_c_in"), F.lit(0).cast("long").alias("_k_in")
    )
    for lvl in range(len(levels) - 2, -1, -1):
        entry = _down(levels[lvl], entry, key, key_type, fan_in, budget)
    entry = entry.select(F.col(key).alias("_key"), F.col("_node").alias("_node_frag"), "_c_in", "_k_in")

    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("_frag") == F.col("_node_frag"))
    # the fold sees numbers only; all other columns meet their chunk number afterwards
    rest = [c for c in segments.columns if c not in (key, order, tokens)]
    rows = with_frag.join(entry, same, "left").select(
        key, order, tokens,
        "_frag",
        F.coalesce("_c_in", F.lit(0).cast("long")).alias("_c_in"),
        F.coalesce("_k_in", F.lit(0).cast("long")).alias("_k_in"),
    )
    rows = _clustered(rows, key, "_frag").sortWithinPartitions(key, "_frag", order)
    fold_schema = T.StructType(
        list(rows.schema.fields) + [T.StructField("chunk_no", T.LongType(), False)]
    )
    folded = rows.mapInArrow(_fold_batches(key, "_frag", tokens, budget, True), fold_schema)
    if rest:
        numbers = folded.select(F.col(key).alias("_nkey"), F.col(order).alias("_nord"), "chunk_no")
        folded = segments.join(numbers, F.col(key).eqNullSafe(F.col("_nkey")) & F.col(order).eqNullSafe(F.col("_nord")))
    return folded.select(*[F.col(f.name) for f in out_schema.fields])


def token_counts(segments: DataFrame, text: str = "text") -> DataFrame:
    """AGG-2 / SCL-1: ``n_tokens`` = whitespace word count of the segment text."""
    return segments.withColumn("n_tokens", word_count(text))


def chunk_table(packed: DataFrame, *, key: str = "transcript_id", tokens: str = "n_tokens") -> DataFrame:
    """One row per chunk: ``(key, chunk_no, n_segments, n_tokens)``.

    The empty chunk 0 that an oversize first segment leaves behind is emitted
    with 0 segments and 0 tokens, as the numbering implies.
    """
    chunks = packed.groupBy(key, "chunk_no").agg(
        F.count(F.lit(1)).alias("n_segments"), F.sum(tokens).cast("bigint").alias("n_tokens")
    )
    firsts = chunks.groupBy(key).agg(F.min("chunk_no").alias("_first"))
    empty0 = firsts.where(F.col("_first") > 0).select(
        key, F.lit(0).cast("long").alias("chunk_no"), F.lit(0).cast("long").alias("n_segments"),
        F.lit(0).cast("long").alias("n_tokens"),
    )
    return chunks.unionByName(empty0)
