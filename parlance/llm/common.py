"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.session import drop_scratch, scratch_path  # noqa: F401 - used and passed on


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or ``name`` with underscores appended until no column of ``df`` is called that."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: lineage ends
    there, so a lost executor costs a reread and never a recomputation with other row ids."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def literal_table(df: DataFrame, rows: list[dict], ddl: str) -> DataFrame:
    """A small table as a literal, so that nothing but SQL expressions is in the plan."""
    kind = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{ddl}>>")
    return df.sparkSession.range(1).select(F.inline(kind))


def summed_counts(df: DataFrame, of_batch: Callable[[pa.RecordBatch], np.ndarray], size: int, slices: int = 64) -> np.ndarray:
    """Sum over all batches of ``of_batch(batch)``, an integer array of a fixed ``size``.

    Every task adds up its batches and deals its sums out in slices; the slices are added by
    key, and ``size`` numbers reach the driver, however large the input."""
    width = -(-size // slices)

    def pack(by: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(by), pa.int32()), pa.array([c.astype(np.int64).tobytes() for c in by.values()], pa.binary())], ["slice", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width * slices, np.int64)
        for batch in batches:
            total[:size] += of_batch(batch)
        parts = total.reshape(slices, width)
        yield pack({s: parts[s] for s in range(slices) if parts[s].any()})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, counts in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist()):
                total[s] = total.get(s, 0) + np.frombuffer(counts, np.int64)
        yield pack(total)

    ddl = "slice int, counts binary"
    out = np.zeros((slices, width), np.int64)
    for r in df.mapInArrow(count, ddl).repartition("slice").mapInArrow(add, ddl).collect():
        out[r["slice"]] = np.frombuffer(bytes(r["counts"]), np.int64)
    return out.reshape(-1)[:size]


def hash_bitmap(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """Bitmap (as bytes, lowest bit first) of the lowest bits of the 64-bit hashes in ``column``: ``bits``
    bits, a power of two, whatever the input; gathered as at most bits / 32768 rows of 4096 bytes."""
    width = 1 << 15
    rows = (
        df.select(F.pmod(column, F.lit(bits)).alias("b")).distinct()
        .groupBy(F.floor(F.col("b") / width).cast("int").alias("slice"))
        .agg(F.bitmap_construct_agg(F.col("b") % width).alias("bits"))
        .collect()
    )
    out = np.zeros((bits // width, width // 8), np.uint8)
    for r in rows:
        out[r["slice"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out.reshape(-1)
