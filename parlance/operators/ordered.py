"""Skew-safe "next row within key" (lead) without a per-key window.

``Window.partitionBy(key)`` puts every row of a key in one task; a key holding
a third of the data would then run on one core.  Here the rows are globally
range-sorted on ``(key, order)`` (range partitioning splits a hot key over many
partitions), the sorted table is checkpointed to the shared checkpoint folder so
partition contents are stable, each partition computes its local lead in one
Arrow pass, and the last row of every partition is completed from the first row
of the next non-empty partition (a table with one row per partition; it grows with the
partitions, so how it is joined is left to Spark).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.session import ensure_checkpoint_dir


def _local_lead(key: str, values: list[str]):
    def run(batches):
        pending = None  # last row of the previous batch (as a 1-row table)
        for rb in batches:
            if pending is not None:
                rb = pa.Table.from_batches([pending, rb]).combine_chunks().to_batches()[0]
            m = rb.num_rows
            if m == 0:
                continue
            # hold back the last row: its successor may be in the next batch
            body, pending = rb.slice(0, m - 1), rb.slice(m - 1, 1)
            if body.num_rows:
                yield _with_next(body, rb.slice(1, m - 1), key, values, last_in_part=False)
        if pending is not None and pending.num_rows:
            yield _with_next(pending, None, key, values, last_in_part=True)

    return run


def _with_next(body: pa.RecordBatch, nxt, key, values, last_in_part):
    n = body.num_rows
    cols = {name: body.column(name) for name in body.schema.names}
    if nxt is None:
        same = pa.array(np.zeros(n, dtype=bool))
    else:
        same = pc.equal(body.column(key), nxt.column(key))
    for v in values:
        src = nxt.column(v) if nxt is not None else pa.nulls(n, body.schema.field(v).type)
        cols[f"next_{v}"] = pc.if_else(same, src, pa.nulls(n, body.schema.field(v).type))
    cols["_last_in_part"] = pa.array(np.full(n, last_in_part))
    return pa.RecordBatch.from_pydict(cols)


def _first_rows(cols: list[str]):
    def run(batches):
        for rb in batches:
            if rb.num_rows:
                yield rb.select(cols).slice(0, 1)
                return

    return run


def with_next(
    df: DataFrame,
    key: str,
    order: str | list[str],
    values: list[str],
    num_partitions: int | None = None,
    descending: bool = False,
) -> DataFrame:
    """Add ``next_<v>`` for each ``v`` in ``values``: the value of the following
    row of the same ``key`` in ``order`` (null for the last row of a key).
    ``descending=True`` walks the order backwards (a lag)."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    order = [order] if isinstance(order, str) else list(order)
    sort = [F.col(key)] + [F.col(o).desc() if descending else F.col(o) for o in order]
    cols = list(dict.fromkeys([key, *order, *values, *df.columns]))
    # without an explicit count AQE may coalesce adjacent ranges (order is kept;
    # partition ids are taken after that)
    ranged = (
        df.select(*cols).repartitionByRange(num_partitions, *sort) if num_partitions
        else df.select(*cols).repartitionByRange(*sort)
    )
    ordered = ranged.sortWithinPartitions(*sort)
    # stable partition contents for the two passes below (shared checkpoint folder)
    ordered = ordered.withColumn("_pid", F.spark_partition_id()).checkpoint(eager=True)

    out_fields = list(ordered.schema.fields) + [
        T.StructField(f"next_{v}", ordered.schema[v].dataType, True) for v in values
    ] + [T.StructField("_last_in_part", T.BooleanType(), False)]
    local = ordered.mapInArrow(_local_lead(key, values), T.StructType(out_fields))

    first_cols = ["_pid", key, *values]
    firsts = ordered.mapInArrow(
        _first_rows(first_cols), T.StructType([ordered.schema[c] for c in first_cols])
    )
    # next non-empty partition's first row, for every partition id.  The table has
    # one row per partition, so this un-partitioned window (a single task) is
    # bounded by the partition count, not by the data.
    w = Window.orderBy("_pid")
    edge = firsts.select(
        F.lag("_pid").over(w).alias("_pid"),
        F.col(key).alias("_ekey"),
        *[F.col(v).alias(f"_e_{v}") for v in values],
    ).where(F.col("_pid").isNotNull())
    fixed = local.join(edge, "_pid", "left")
    take = F.col("_last_in_part") & (F.col("_ekey") == F.col(key))
    return fixed.select(
        *[F.col(c) for c in df.columns],
        *[F.when(take, F.col(f"_e_{v}")).otherwise(F.col(f"next_{v}")).alias(f"next_{v}") for v in values],
    )


def with_prev(
    df: DataFrame, key: str, order: str | list[str], values: list[str], num_partitions: int | None = None
) -> DataFrame:
    """Add ``prev_<v>``: the value of the preceding row of the same ``key`` (lag)."""
    out = with_next(df, key, order, values, num_partitions, descending=True)
    for v in values:
        out = out.withColumnRenamed(f"next_{v}", f"prev_{v}")
    return out
