"""Best-fit packing of documents into token sequences, after Martello and Toth's reduction (operator 6).

Lengths are integers up to the capacity, so an instance is its histogram: at most ``capacity`` counts, whatever the
number of documents. The plan is made on that histogram on the driver: sets of two or three lengths that provably
dominate every other way to fill a sequence holding one of them are fixed, with their multiplicity; the rest is packed by
best-fit decreasing, again with multiplicities. What is fixed is part of some best packing; what best fit packs may take
more sequences than needed. The plan's size depends on the capacity alone. Pieces are then numbered within their length,
in parallel buckets, and look up their place in the plan.

Edge cases: a null or empty text is its separator alone; repeated rows are packed as often as they occur; pieces of equal
length are alike, so their order is of no account; an empty table gives no rows; other columns are not read. A document
longer than a sequence is cut into full sequences, and its first piece has what remains.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.llm._store import written
from loomspark.llm._tokens import default_tokenizer, encoded

CAPACITY, SEPARATOR = 2048, 0
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: A pattern: how many sequences have it, and its lengths with how often each occurs.
Pattern = tuple[int, list[tuple[int, int]]]


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Sets fixed by dominance, and the counts that remain. Whatever is fixed is part of some best packing.

    A set dominates another if the other's members can be dealt into groups, none larger than the member of the first that
    takes its place. For a length, a set of it and at most two more is fixed if it dominates every set with that length that
    fits; where three more may fit besides it, nothing is fixed.
    """
    left = {k: n for k, n in counts.items() if n > 0}
    lengths = sorted(left)
    fixed: list[Pattern] = []

    def take(items: list[tuple[int, int]]) -> None:
        times = min(left[k] // n for k, n in items)
        fixed.append((times, items))
        for k, n in items:
            left[k] -= n * times
            if not left[k]:
                del left[k]
                lengths.pop(bisect_left(lengths, k))

    def largest(room: int, used: dict[int, int]) -> int:
        """The largest length with a copy to spare that fits, or 0."""
        i = bisect_right(lengths, room) - 1
        while i >= 0 and left[lengths[i]] <= used.get(lengths[i], 0):
            i -= 1
        return lengths[i] if i >= 0 else 0

    def pack(*items: int) -> None:
        take([(k, items.count(k)) for k in dict.fromkeys(items)])

    for top in sorted(left, reverse=True):
        while left.get(top, 0):
            room = capacity - top
            a = largest(room, {top: 1})
            if not a:
                pack(top)
                continue
            if a == room:
                pack(top, a)
                continue
            small = []
            for k in lengths[:4]:
                small += [k] * min(3, left[k] - (k == top))
            small += [capacity + 1] * 3
            if small[0] + small[1] > room:  # one more at most: the largest that fits
                pack(top, a)
                continue
            if small[0] + small[1] + small[2] <= room:  # three more may fit: nothing proven about them
                break
            best, deepest = 0, 0  # the largest sum of two that fit, and the largest lesser part
            for y in lengths:
                if 2 * y > room:
                    break
                used = {top: 1}
                used[y] = used.get(y, 0) + 1
                if left[y] < used[y]:
                    continue
                x = largest(room - y, used)
                if x >= y:
                    best, deepest = max(best, x + y), y
            if best <= a:  # the largest alone dominates any two, and more than two don't fit
                pack(top, a)
                continue
            used = {top: 1}
            used[a] = used.get(a, 0) + 1
            c = largest(room - a, used)
            if not c or deepest > c:
                break
            pack(top, a, c)  # the largest two, part by part, dominate any two
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing on counts: each length goes to the fullest open sequences that take it."""
    open_: dict[int, list[Pattern]] = defaultdict(list)
    rooms: list[int] = []
    done: list[Pattern] = []

    def add(times: int, items: list[tuple[int, int]], room: int) -> None:
        if times and not room:
            done.append((times, items))
        elif times:
            if not open_[room]:
                insort(rooms, room)
            open_[room].append((times, items))

    for k in sorted(counts, reverse=True):
        n = counts[k]
        while n:
            i = bisect_left(rooms, k)
            if i < len(rooms):
                room = rooms[i]
                times, items = open_[room].pop()
                if not open_[room]:
                    rooms.pop(i)
            else:
                room, items = capacity, []
                times = -(-n // (capacity // k))
            each = room // k
            full, rest = min(times, n // each), 0
            if full < times:
                rest = n - full * each
                add(times - full - (rest > 0), items, room)
            add(full, [*items, (k, each)], room - each * k)
            if rest:
                add(1, [*items, (k, rest)], room - rest * k)
            n -= full * each + rest
    for room in rooms:
        done += open_[room]
    return done


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """For each length: ranks [lo, hi) go to sequences first + (rank - lo) // each, at offset + length * ((rank - lo) % each)."""
    fixed, left = reduce_by_dominance(counts, capacity)
    used: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for times, items in fixed + best_fit(left, capacity):
        offset = 0
        for k, each in items:
            rows.append((k, used[k], used[k] + times * each, sequence, each, offset))
            used[k] += times * each
            offset += k * each
        sequence += times
    return rows


def _cut(tokenizer: str, capacity: int, separator: int):
    def run(batches):
        for batch in batches:
            for rows, ids, off in encoded(batch.column(1), tokenizer):
                lens = np.diff(off) + 1
                n = -(-lens // capacity)
                doc = np.repeat(np.arange(len(lens)), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                first = (lens - (n - 1) * capacity)[doc]
                start = np.where(piece == 0, 0, first + (piece - 1) * capacity)
                length = np.where(piece == 0, first, capacity)
                ids = ids.astype("<u4")
                end, tail = off[1:][doc], np.array([separator], "<u4").tobytes()
                crc = np.empty(len(doc), np.int64)
                for i, (a, m, e) in enumerate(zip((off[:-1][doc] + start).tolist(), length.tolist(), end.tolist(), strict=True)):
                    crc[i] = zlib.crc32(ids[a : a + m]) if a + m <= e else zlib.crc32(tail, zlib.crc32(ids[a:e]))
                yield pa.RecordBatch.from_arrays([batch.column(0)[rows].take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def token_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, separator: int = SEPARATOR) -> DataFrame:
    """The pieces of (doc_id, text): doc_id, piece, start, length, ids_crc32."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_cut(tokenizer or default_tokenizer(), capacity, separator), PIECE_SCHEMA)


def pack(pieces: DataFrame, capacity: int = CAPACITY, bucket_rows: int = 1000) -> DataFrame:
    """Adds sequence_id and offset to pieces, a written table with a column ``salt`` that tells its rows apart.

    A length that many pieces share is numbered in as many buckets as keep each under about ``bucket_rows``; the buckets'
    sizes are summed up in two steps, each over about the square root of their number.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    buckets = 1 + max(counts.values(), default=0) // bucket_rows
    wide = math.isqrt(buckets) + 1
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("salt"), F.lit(buckets)).cast("int")).withColumn("shelf", F.expr(f"cast(floor(bucket / {wide}) as int)"))
    sizes = dealt.groupBy("length", "shelf", "bucket").agg(F.count("*").alias("n"))
    in_shelf = sizes.select("length", "shelf", "bucket", (F.sum("n").over(Window.partitionBy("length", "shelf").orderBy("bucket")) - F.col("n")).alias("within"))
    shelves = dealt.groupBy("length", "shelf").agg(F.count("*").alias("n"))
    shelves = shelves.select("length", "shelf", (F.sum("n").over(Window.partitionBy("length").orderBy("shelf")) - F.col("n")).alias("ahead"))
    before = in_shelf.join(shelves, ["length", "shelf"]).select("length", "bucket", (F.col("within") + F.col("ahead")).alias("before"))
    ranked = dealt.withColumn("place", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("salt")) - 1)
    ranked = ranked.join(before, ["length", "bucket"]).withColumn("rank", F.col("place") + F.col("before"))
    places = spark.createDataFrame(plan(counts, capacity), "length long, lo long, hi long, first long, each long, at long")
    # The plan's size depends on the capacity alone.
    found = ranked.join(F.broadcast(places), (ranked["length"] == places["length"]) & (ranked["rank"] >= places["lo"]) & (ranked["rank"] < places["hi"]))
    nth = F.col("rank") - F.col("lo")
    return found.select("doc_id", "piece", "start", ranked["length"], "ids_crc32", (F.col("first") + (nth / F.col("each")).cast("long")).alias("sequence_id"), (F.col("at") + ranked["length"] * (nth % F.col("each"))).alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, separator: int = SEPARATOR) -> DataFrame:
    """All documents in as few sequences as the plan finds, one row for each piece."""
    pieces = token_pieces(docs, tokenizer, capacity, separator).withColumn("salt", F.monotonically_increasing_id())
    return pack(written(pieces, "token-pieces"), capacity)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
