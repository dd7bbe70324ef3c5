"""Sharding by a consistent-hash ring with virtual nodes and bounded loads (operator 5).

Each shard owns ``VIRTUAL`` points of a ring of ``CELLS`` cells; a document belongs to the first point at or after the
cell of its key, its id and the checksum of its text (so an id that a third of all rows share has no cell of its own). Loads are bounded by an equal share (counts at most one apart), and what a full shard can't take
continues clockwise to the next shard with room. Only the documents beyond a bound move, and only as far as needed.

The flow is settled on the driver from one count per cell, a number of rows that is fixed by CELLS. Documents then take
their rank in their cell (equal rows are one row with a count until the end, and are dealt out again ``DEALT`` at a time)
and look up their place. All of it is DataFrame operations.

Edge cases: a null text has size 1 and checksum 0; null ids are one id; a very long text is only measured; repeated rows
take a slot each; shards with equal loads get what can't be divided by their number, lower ones first; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CELLS, VIRTUAL = 1 << 16, 64
DEALT = 4096


def ring(shards: int, virtual: int = VIRTUAL, cells: int = CELLS) -> list[tuple[int, int]]:
    """(cell, shard) of every point, in ring order; a point keeps its cell whatever the number of shards."""
    at = lambda s, v: int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest()) % cells
    return sorted((at(s, v), s) for s in range(shards) for v in range(virtual))


def flow(points: list[tuple[int, int]], loads: list[int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """Where the documents of each arc go: (arc, from rank, to rank, shard, first slot)."""
    own = [0] * shards
    for (_, s), n in zip(points, loads, strict=True):
        own[s] += n
    share, more = divmod(sum(loads), shards)
    room = [share] * shards
    for s in sorted(range(shards), key=lambda s: (-own[s], s))[:more]:
        room[s] += 1
    filled = [0] * shards
    rows = []

    def take(arc: int, rank: int, left: int, s: int) -> int:
        n = min(left, room[s])
        if n:
            rows.append((arc, rank, rank + n, s, filled[s]))
            filled[s] += n
            room[s] -= n
        return n

    over = []
    for arc, ((_, s), n) in enumerate(zip(points, loads, strict=True)):
        if (got := take(arc, 0, n, s)) < n:
            over.append((arc, got, n - got))
    for arc, rank, left in over:
        step = arc
        while left:
            step = (step + 1) % len(points)
            got = take(arc, rank, left, points[step][1])
            rank, left = rank + got, left - got
    return rows


def shard_rows(docs: DataFrame, shards: int = 8, virtual: int = VIRTUAL, cells: int = CELLS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each document."""
    spark = docs.sparkSession
    points = ring(shards, virtual, cells)
    text = F.coalesce("text", F.lit("")).cast("binary")
    cell = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.crc32(text)), F.lit(cells)).cast("int").alias("cell")
    counts = dict(docs.select(cell).groupBy("cell").agg(F.count("*").alias("n")).collect())  # a row for each cell at most
    places, loads = [], [0] * len(points)
    for c in range(cells):
        arc = bisect_left(points, (c, -1)) % len(points)
        places.append((c, arc, loads[arc]))
        loads[arc] += counts.get(c, 0)
    # Sizes of both tables are fixed by the ring alone.
    places = F.broadcast(spark.createDataFrame(places, "cell int, arc int, before long"))
    flows = F.broadcast(spark.createDataFrame(flow(points, loads, shards), "to_arc int, lo long, hi long, shard int, first long"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), cell)
    rows = rows.groupBy("cell", "doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    order = Window.partitionBy("cell").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("rank", F.sum("n").over(order) - F.col("n"))
    last = F.col("rank") + F.col("n") - 1
    rows = rows.withColumn("last", last).withColumn("rank", F.explode(F.sequence("rank", "last", F.lit(DEALT).cast("long")))).hint("rebalance")
    rows = rows.withColumn("rank", F.explode(F.sequence("rank", F.least("last", F.col("rank") + DEALT - 1)))).join(places, "cell").withColumn("rank", F.col("rank") + F.col("before"))
    placed = rows.join(flows, (F.col("arc") == F.col("to_arc")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("first") + F.col("rank") - F.col("lo")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op5_consistent_hash_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))
