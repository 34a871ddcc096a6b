"""Vectors to centroids: k-means rounds whose nearest-centroid search is the threshold algorithm.

For every dimension the centroids are listed by their component.  A vector starts in each list at
its own value and walks outward, always to the nearer of the two neighbours not yet visited; a
centroid met in any list gets its exact distance.  The frontier of a list is the next centroid it
would visit: a centroid met in no list is at least that far away in every dimension, so the sum of
the squared frontier distances bounds its distance from below.  The search of a vector ends when
that sum is strictly above the best exact distance, so ties go to the smaller number.

All numbers are integers: components are floor(scale * x), a new centroid is the componentwise
floor of sum / count, and an empty one stays.  Tasks add up sums and counts of their vectors; as
many numbers as the centroids hold reach the driver after a round, whatever the input.

Defined results: vectors of another length, null vectors and those with a null or non-finite
component are left out; integer components end at -LIMIT and LIMIT (|x| up to 131072 at scale
1024), which keeps squared distances of ``dim`` <= 64 components within a long; null ids hash as the
empty text; vectors of equal hash start as centroids in the order of their components; repeated rows are
vectors like any other; fewer vectors than centroids give as many centroids as vectors; no vectors
give an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import literal_table, summed_counts, written

#: Largest integer component; (2 * LIMIT) ** 2 * 64 is a long.
LIMIT = 1 << 27
#: Vectors searched in one go; bounds the memory of a step.
BLOCK = 2048


class CentroidLists:
    """Centroids (k x d integers) with, for each dimension, their numbers and values in ascending order."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = np.ascontiguousarray(centroids, np.int64)
        self.number = np.argsort(self.centroids, axis=0, kind="stable")
        self.value = np.take_along_axis(self.centroids, self.number, 0)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid and its squared distance, for each row of ``vectors``."""
        out = [self._nearest(vectors[i : i + BLOCK]) for i in range(0, len(vectors), BLOCK)]
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*out))  # type: ignore[return-value]

    def _nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k, d = self.centroids.shape
        n, far, dims = len(vectors), np.int64(1 << 40), np.arange(d)
        right = np.stack([np.searchsorted(self.value[:, j], vectors[:, j]) for j in range(d)], 1)
        left = right - 1
        distance = np.full((n, k), np.iinfo(np.int64).max)
        best = distance.min(1)
        going = np.arange(n)
        for _ in range(k):  # every step visits one more place of each list
            x, lo, hi = vectors[going], left[going], right[going]
            below = np.where(lo >= 0, x - self.value[np.maximum(lo, 0), dims], far)
            above = np.where(hi < k, self.value[np.minimum(hi, k - 1), dims] - x, far)
            frontier = np.minimum(below, above)
            open_ = (frontier * frontier).sum(1) <= best[going]
            going, x, lo, hi = going[open_], x[open_], lo[open_], hi[open_]
            if not len(going):
                break
            down = (below <= above)[open_]
            met = self.number[np.where(down, lo, hi), dims]
            left[going], right[going] = lo - down, hi + ~down
            fresh = np.zeros((len(going), k), bool)
            fresh[np.arange(len(going))[:, None], met] = True
            fresh &= distance[going] == np.iinfo(np.int64).max
            row, c = np.nonzero(fresh)
            for i in range(0, len(row), 8 * BLOCK):
                r, m = row[i : i + 8 * BLOCK], c[i : i + 8 * BLOCK]
                gap = x[r] - self.centroids[m]
                distance[going[r], m] = (gap * gap).sum(1)
            best[going] = distance[going].min(1)
        nearest = distance.argmin(1)  # the first of equal ones
        return nearest, distance[np.arange(n), nearest]


def quantize(df: DataFrame, id_column: str, vector: str, dim: int, scale: int) -> DataFrame:
    """``id`` and ``v``, the integer components, of the rows that hold ``dim`` finite ones."""
    x = F.col(vector)
    whole = F.transform(x.cast("array<double>"), lambda c: F.floor(F.least(F.greatest(c * scale, F.lit(-float(LIMIT))), F.lit(float(LIMIT)))).cast("int"))
    finite = F.forall(x.cast("array<double>"), lambda c: c.isNotNull() & (F.abs(c) < F.lit(float("inf"))) & ~F.isnan(c))
    return df.where(x.isNotNull() & (F.size(x) == dim) & finite).select(F.col(id_column).alias("id"), whole.alias("v"))


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.int64)


def first_centroids(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The ``k`` vectors whose ``<seed>:<id>`` has the smallest hexadecimal SHA-256, in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    return np.array([r["v"] for r in vectors.orderBy(key, "v").limit(k).select("v").collect()], np.int64)


def next_centroids(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: every vector to its nearest centroid, then the floor of the mean of each."""
    k, d = centroids.shape
    lists = CentroidLists(centroids)

    def add(batch: pa.RecordBatch) -> np.ndarray:
        x = _matrix(batch, d)
        number, _ = lists.nearest(x)
        sums = [x[number == c].sum(0) for c in range(k)]
        return np.concatenate([*sums, np.bincount(number, minlength=k)])

    total = summed_counts(vectors.select("v"), add, k * d + k)
    sums, counts = total[: k * d].reshape(k, d), total[k * d :]
    return np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], centroids)


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``id``, ``cluster`` and ``distance`` (squared) of every vector."""
    d = centroids.shape[1]
    lists = CentroidLists(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, distance = lists.nearest(_matrix(batch, d))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(number.astype(np.int32)), pa.array(distance)], ["id", "cluster", "distance"])

    return vectors.mapInArrow(run, f"id {vectors.schema['id'].dataType.simpleString()}, cluster int, distance bigint")


def cluster_vectors(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", *, dim: int = 64, k: int = 8, rounds: int = 10, scale: int = 1024, seed: str = "3") -> tuple[DataFrame, np.ndarray]:
    """(id column, cluster, distance) of every kept vector after ``rounds`` rounds, and the final centroids."""
    if dim > 64:
        raise ValueError("squared distances of more than 64 components may pass a long")
    vectors = written(quantize(df, id_column, vector, dim, scale), "vectors")
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        return vectors.select(F.col("id").alias(id_column), F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")), np.zeros((0, dim), np.int64)
    for _ in range(rounds):
        centroids = next_centroids(vectors, centroids)
    return written(assign(vectors, centroids), "assigned").withColumnRenamed("id", id_column), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``assigned`` with the sum of distances of its cluster and of all, and the hash of its centroid."""
    by = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # at most k rows
    rows = [{"c": c, "cluster_inertia": by[c], "inertia": sum(by.values()), "centroid_sha256": hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()} for c in sorted(by)]
    facts = literal_table(assigned, rows, "c:int,cluster_inertia:bigint,inertia:bigint,centroid_sha256:string")
    return assigned.join(F.broadcast(facts), F.col("cluster") == F.col("c")).drop("c")
