"""Shards from a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` places on a ring of ``RING`` positions.  A row hashes
to a position and belongs to the first virtual node clockwise from it.  Shards have
a capacity; rows that find a shard full go on clockwise to the next virtual node
whose shard has room.  With ``slack=0`` the capacities add up to the number of rows,
so counts differ by at most one; with slack fewer rows move when a shard is added.

Only counts per arc of the ring (at most ``shards * vnodes`` of them, whatever the
input) reach the driver.  They say which ranks within an arc go to which shard;
ranks come from a window over (arc, part), where the part is the task that wrote the
row: an arc that one repeated key fills is split over as many parts as the input has.
All row work is DataFrame expressions.

Defined results: null ids hash by their text (null text: empty, 0 bytes); repeated
rows are rows like any other; an empty table gives an empty result; other columns of
the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.common import literal_table, written

#: Positions on the ring; a fixed table of this many rows is the only one that is broadcast besides the plan.
RING = 1 << 16


def _positions(df: DataFrame, shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(position, shard) of every virtual node, clockwise; positions taken twice go to the smaller shard."""
    rows = (
        df.sparkSession.range(shards * vnodes)
        .select((F.col("id") % shards).cast("int").alias("shard"), F.floor(F.col("id") / shards).alias("v"))
        .select(F.pmod(F.xxhash64(F.lit("vnode"), "shard", "v"), F.lit(RING)).alias("at"), "shard")
        .groupBy("at").agg(F.min("shard").alias("shard"))
        .collect()
    )
    return sorted((r["at"], r["shard"]) for r in rows)


def assign_arcs(owners: list[int], counts: dict[int, int], shards: int, slack: float = 0.0) -> list[dict]:
    """Which ranks of each arc go where: rows ``arc, lo, hi, shard, slot`` (``slot`` of rank ``lo``).

    ``owners[i]`` is the shard of virtual node i.  Arcs are served clockwise; what a
    full shard turns away tries the next virtual node in the next lap."""
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    if slack:
        room = [-int(-(1 + slack) * total // shards)] * shards
    filled, out = [0] * shards, []
    waiting = [(arc, arc, 0, n) for arc, n in sorted(counts.items()) if n]
    n_nodes = len(owners)
    live = set(owners)
    if any(room[s] for s in range(shards) if s not in live):  # a shard whose every position was taken
        owners = owners + [s for s in range(shards) if s not in live]
        n_nodes = len(owners)
    while waiting:
        again = []
        for arc, node, lo, hi in waiting:
            s = owners[node % n_nodes]
            take = min(hi - lo, room[s] - filled[s])
            if take:
                out.append({"arc": arc, "lo": lo, "hi": lo + take, "shard": s, "slot": filled[s]})
                filled[s] += take
                lo += take
            if lo < hi:
                node += 1
                while filled[owners[node % n_nodes]] >= room[owners[node % n_nodes]]:
                    node += 1
                again.append((arc, node, lo, hi))
        waiting = again
    return out


def shard_rows(df: DataFrame, key: Column, shards: int, *, tie: list[str], vnodes: int = 64, slack: float = 0.0) -> DataFrame:
    """``df`` with ``shard`` and ``slot`` (gapless from 0 in each shard).

    ``key`` is the 64-bit ring hash of a row and ``tie`` the columns that order rows of
    one arc.  ``df`` should be narrow: it is written once, since ranks and counts must
    come from the same rows."""
    ring = _positions(df, shards, vnodes)
    owners = [s for _, s in ring]
    keep = df.columns
    base = written(
        df.select("*", key.alias("_h"), F.spark_partition_id().alias("_part"))
        .withColumn("_at", F.pmod(F.col("_h"), F.lit(RING)).cast("int")),
        "ring",
    )
    nodes = literal_table(df, [{"at": a, "arc": i} for i, (a, _) in enumerate(ring)], "at:int,arc:int")
    last = Window.orderBy(F.col("_at").desc()).rowsBetween(Window.unboundedPreceding, 0)
    positions = (  # RING rows: every position with the virtual node clockwise from it
        df.sparkSession.range(0, RING, 1, 1).select(F.col("id").cast("int").alias("_at"))
        .join(F.broadcast(nodes.withColumnRenamed("at", "_at")), "_at", "left")
        .select("_at", F.coalesce(F.last("arc", ignorenulls=True).over(last), F.lit(0)).alias("arc"))
    )
    placed = base.join(F.broadcast(positions), "_at").drop("_at")
    counts = placed.groupBy("arc", "_part").agg(F.count(F.lit(1)).alias("_n"))
    per_arc = {r["arc"]: r["n"] for r in counts.groupBy("arc").agg(F.sum("_n").alias("n")).collect()}
    plan = literal_table(df, assign_arcs(owners, per_arc, shards, slack), "arc:int,lo:bigint,hi:bigint,shard:int,slot:bigint")
    before = Window.partitionBy("arc").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("arc", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))  # a row for each arc and part: joined by the key its ranks are dealt by
    rank = F.row_number().over(Window.partitionBy("arc", "_part").orderBy("_h", *tie)) - 1
    return (
        placed.withColumn("_rank", rank)
        .join(starts, ["arc", "_part"])
        .withColumn("_rank", F.col("_rank") + F.col("_before"))
        .join(F.broadcast(plan.withColumnRenamed("arc", "_arc")), (F.col("arc") == F.col("_arc")) & (F.col("_rank") >= F.col("lo")) & (F.col("_rank") < F.col("hi")))
        .select(*keep, "shard", (F.col("slot") + F.col("_rank") - F.col("lo")).alias("slot"))
    )


def shard_documents(docs: DataFrame, shards: int, *, vnodes: int = 64, slack: float = 0.0) -> DataFrame:
    """Documents to shards: doc_id, size (UTF-8 bytes + 16), text_crc32, shard, slot."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(
        "doc_id",
        (F.octet_length(text).cast("bigint") + 16).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.when(F.col("doc_id").isNull(), F.xxhash64(text)).otherwise(F.xxhash64("doc_id")).alias("_key"),
    )
    return shard_rows(narrow, F.col("_key"), shards, tie=["doc_id", "text_crc32", "size"], vnodes=vnodes, slack=slack).drop("_key")
