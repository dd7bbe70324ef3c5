"""Removal of repeated byte strings, across and within documents (operator 8).

A byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere else. The collection's suffixes are sorted
column by column: each round inserts one symbol of every piece, which gives the next column of the Burrows-Wheeler transform,
and updates the common prefixes of neighbours (see ``spans.repeated_columns``). The whole collection would need as many
rounds as its longest document has bytes, so it is first cut into short pieces, of which few are left to compare:

1. every window of LENGTH bytes belongs to a run with one anchor (see ``spans``); a run whose anchor's k-gram is unique
   holds no repeat;
2. runs equal in whole with another are repeats in whole; one of each kind still stands for them in step 3;
3. the pieces of text of the runs around one anchor are built column-wise, at most 2 * LENGTH - GRAM rounds, in tasks of
   bounded size. Windows with a common prefix of LENGTH are repeats.

Where more than ``GROUP`` different runs have one anchor, they are first cut into blocks of ``BLOCK`` windows at fixed
distances from it, told apart by the bytes that all windows of a block share, and steps 2 and 3 are taken with these; what is
still more than GROUP is cut into single windows, for which step 2 decides everything. So no group is ever gathered.

Steps 1 and 2 compare hashes modulo the prime 2**61 - 1, two of them where they decide; step 3 compares bytes. The pieces are
kept in the shared folder as Parquet, read and written in sequence, and each task's columns in its memory.

Edge cases: null is empty; texts shorter than LENGTH, and empty tables, lose nothing; a very long text is as many runs;
repeated rows are each other's repeats; a string that overlaps its own copy counts; of equal hashes the last place is the
anchor, in all copies alike; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm._store import Tables, if_small
from loomspark.llm._text import U64, SubstringHash, mix, pieces, utf8
from loomspark.llm.spans import anchor_runs, repeated_columns

LENGTH, GRAM, BLOCK = 200, 32, 32
#: Different runs of one anchor that are compared in one task, and pieces that a task takes in all.
GROUP, TASK = 2_000, 30_000
#: Bytes of text that a task hashes at a time, or one longer text.
PIECE = 1 << 20
NO_ID = -1 << 63
ID = "id struct<d: long, t: long>"
KIND = ["key", "lo", "hi", "span", "span2"]
RUN = f"{ID}, at int, lo short, hi short, key long, span long, span2 long"


def _fields(id_, at, lo, hi, *hashes) -> tuple[list, list]:
    """Arrays and names of a row of RUN."""
    whole = [pa.array(at.astype(np.int32)), pa.array(lo.astype(np.int16)), pa.array(hi.astype(np.int16))]
    return [id_, *whole, *(pa.array(h.view(np.int64)) for h in hashes)], ["id", "at", *KIND[1:3], KIND[0], *KIND[3:]]


def _runs(length: int, gram: int):
    width = length - gram + 1

    def run(batches):
        for batch in batches:
            for rows, d, off in pieces(batch.column(1), PIECE):
                one, two = SubstringHash(d), SubstringHash(d, 1)
                doc, lo, hi, p = anchor_runs(d, off, length, gram)
                zero = p - (width - 1)
                yield pa.RecordBatch.from_arrays(*_fields(batch.column(0)[rows].take(pa.array(doc)), lo - off[doc], lo - zero, hi - zero, one(p, p + gram), one(lo, hi + length), two(lo, hi + length)))

    return run


def _ranges(count: np.ndarray) -> np.ndarray:
    return np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)


def _with_context(length: int):
    """Runs listed with their texts, and the bytes that their windows cover."""

    def run(batches):
        for batch in batches:
            listed = batch.column(2)
            bounds = np.frombuffer(listed.buffers()[1], np.int32)[listed.offset : listed.offset + len(listed) + 1].astype(np.int64)
            for rows, d, off in pieces(batch.column(1), PIECE):
                mine = slice(int(bounds[rows.start]), int(bounds[rows.stop]))
                own = listed.values[mine.start : mine.stop]
                doc = np.repeat(np.arange(len(off) - 1), np.diff(bounds[rows.start : rows.stop + 1]))
                at, lo, hi = (own.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("at", "lo", "hi"))
                size = hi - lo + length
                data = d[np.repeat(at + off[doc], size) + _ranges(size)] if len(doc) else d[:0]
                context = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())
                whole = [own.field(c) for c in ("at", "lo", "hi", "key", "open")]
                yield pa.RecordBatch.from_arrays([batch.column(0)[rows].take(pa.array(doc)), *whole, context], ["id", "at", "lo", "hi", "key", "open", "context"])

    return run


def _blocks(length: int, block: int):
    """Pieces cut into blocks of windows, by the bytes that a block's windows share."""

    def run(batches):
        for batch in batches:
            for rows, d, off in pieces(batch.column(6), PIECE):
                one, two = SubstringHash(d), SubstringHash(d, 1)
                at, first, last = (batch.column(i)[rows].to_numpy().astype(np.int64) for i in (1, 2, 3))
                n = last // block - first // block + 1
                which = np.repeat(np.arange(len(n)), n)
                b = _ranges(n) + (first // block)[which]
                lo, hi = np.maximum(first[which], b * block), np.minimum(last[which], b * block + block - 1)
                zero = off[which] - first[which]
                start, end = zero + lo, zero + hi + length
                # From the start of a block's last window, whether this piece has it or not, to the end of its first one.
                core = one(zero + b * block + block - 1, zero + b * block + length)
                size = end - start
                data = d[np.repeat(start, size) + _ranges(size)] if len(b) else d[:0]
                context = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(b), [None, pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())
                arrays, names = _fields(batch.column(0)[rows].take(pa.array(which)), (at - first)[which] + lo, lo, hi, core ^ mix(b.astype(U64) + U64(77)), one(start, end), two(start, end))
                yield pa.RecordBatch.from_arrays([*arrays, batch.column(5)[rows].take(pa.array(which)), context], [*names, "open", "context"])

    return run


def _columns(length: int):
    """The repeated windows of a task's open pieces, runs of them as one."""

    def run(batches):
        held = [b for b in batches if len(b)]  # bounded by TASK and GROUP
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        rows = rows.sort_by([("key", "ascending"), ("d", "ascending"), ("t", "ascending"), ("at", "ascending")])
        key, doc, text, at, lo = (rows.column(c).to_numpy().astype(np.int64) for c in ("key", "d", "t", "at", "lo"))
        new = np.ones(len(key), bool)  # a run of a repeated row is there more than once
        new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (text[1:] != text[:-1]) | (at[1:] != at[:-1])
        rows, own = rows.filter(pa.array(new)), np.flatnonzero(new)
        d, off = utf8(rows.column("context"))
        piece, place = repeated_columns(d, off, key[own], lo[own], length)
        is_open = rows.column("open").to_numpy()[piece]
        order = np.lexsort((place[is_open], piece[is_open]))
        piece, place = own[piece[is_open][order]], place[is_open][order]
        head = np.ones(len(piece), bool)
        head[1:] = (piece[1:] != piece[:-1]) | (place[1:] != place[:-1] + 1)
        first, last = np.flatnonzero(head), np.flatnonzero(np.append(head[1:], True)[: len(head)])
        one = piece[first]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[one], text[one], at[one] + place[first], at[one] + place[last])], ["d", "t", "lo", "hi"])

    return run


def _removed(length: int):
    """From texts and their repeated windows, the bytes that go."""

    def run(batches):
        for batch in batches:
            d, off = utf8(batch.column(1))
            spans = batch.column(2)
            span_off = np.frombuffer(spans.buffers()[1], np.int32)[spans.offset : spans.offset + len(spans) + 1]
            lo, hi = (spans.values.field(i).to_numpy(zero_copy_only=False) for i in range(2))
            out = [], [], []
            for i in range(len(spans)):
                text = d[off[i] : off[i + 1]]
                edge = np.zeros(len(text) + 1, np.int64)
                a, b = span_off[i], span_off[i + 1]
                np.add.at(edge, lo[a:b], 1)
                np.add.at(edge, hi[a:b] + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                for x, y in zip(out, (int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(text[~gone].tobytes()).hexdigest()), strict=True):
                    x.append(y)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], ["id", "n_removed", "n_spans", "kept_sha256"])

    return run


def repeated_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK, group: int = GROUP, task: int = TASK) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document."""
    tables = Tables()
    store = lambda df, name: tables.written(df, f"repeats-{name}", "zstd")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = keyed.withColumn("id", F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("d"), F.xxhash64("text").alias("t")))
    long = keyed.where(F.octet_length("text") >= length).select("id", "text")
    runs = store(long.mapInArrow(_runs(length, gram), RUN), "runs")
    twice = store(runs.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "keys")
    shared = store(runs.join(if_small(twice, 1_000_000), "key"), "shared-runs")
    tables.drop(runs, twice)

    def kinds(rows: DataFrame, is_open) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Kinds of equal rows; those that occur again; by key that is not settled, how many kinds it has."""
        found = store(rows.groupBy(*KIND).agg(F.count("*").alias("n"), F.max(is_open).alias("open"), F.min(F.struct("id", "at")).alias("one")), "kinds")
        keys = found.groupBy("key").agg(F.count("*").alias("kinds"), F.max((F.col("n") == 1) & F.col("open")).alias("some"))
        return found, store(found.where("n > 1 and open").select(*KIND), "again"), store(keys.where("kinds > 1 and some").select("key", "kinds"), "keys")

    def solid(rows: DataFrame, again: DataFrame) -> DataFrame:
        """First and last windows of the rows of these kinds, by document."""
        return store(rows.join(if_small(again, 100_000), KIND).select("id", F.col("at").alias("lo"), (F.col("at") + F.col("hi") - F.col("lo")).alias("hi")), "found")

    def columns(rows: DataFrame, count: int) -> DataFrame:
        """The repeated windows of these pieces, those of a key in one of as many tasks as their count needs."""
        rows = rows.select("id.d", "id.t", "at", "lo", "key", "open", "context").repartition(max(1, -(-count // task)), "key")
        found = rows.mapInArrow(_columns(length), "d long, t long, lo long, hi long")
        return store(found.select(F.struct("d", "t").alias("id"), F.col("lo").cast("int").alias("lo"), F.col("hi").cast("int").alias("hi")), "found")

    every, again, keys = kinds(shared, F.lit(True))
    found = [solid(shared, again)]
    tables.drop(shared, again)
    asked = every.join(if_small(keys.select("key")), "key").select("one.id", F.struct("one.at", "lo", "hi", "key", (F.col("n") == 1).alias("open")).alias("run"))
    asked = asked.groupBy("id").agg(F.collect_list("run").alias("runs"))
    rows = long.join(asked, "id").select("id", "text", "runs").mapInArrow(_with_context(length), f"{ID}, at int, lo short, hi short, key long, open boolean, context binary")
    rows = store(rows, "pieces")
    tables.drop(every)
    for width in (block, 1):
        many = keys.where(F.col("kinds") > group).select("key")
        few = keys.where(F.col("kinds") <= group)
        found.append(columns(rows.join(if_small(few.select("key")), "key"), few.agg(F.sum("kinds")).first()[0] or 0))
        if not many.take(1):
            break
        rows = rows.join(if_small(many), "key").dropDuplicates(["id", "key", "at"]).select("id", "at", "lo", "hi", "key", "open", "context")
        rows = store(rows.mapInArrow(_blocks(length, width), f"{RUN}, open boolean, context binary"), "blocks")
        every, again, keys = kinds(rows.drop("context"), F.col("open"))
        found.append(solid(rows.where("open").drop("context"), again))
        # One of each kind goes on; windows (blocks of one) of different kinds are different.
        rows = rows.join(every.select(*KIND, "one", "n"), KIND).where("id = one.id and at = one.at")
        rows = rows.select("id", "at", "lo", "hi", "key", (F.col("open") & (F.col("n") == 1)).alias("open"), "context")

    spans = found[0]
    for more in found[1:]:
        spans = spans.unionByName(more)
    spans = store(spans.groupBy("id").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "spans")  # before the texts are shuffled once more
    tables.close(spans)
    cut = long.join(spans, "id").select("id", "text", "spans").mapInArrow(_removed(length), f"{ID}, n_removed long, n_spans long, kept_sha256 string")
    cut = Tables().written(cut.dropDuplicates(["id"]), "repeats-removed")
    whole = keyed.select("id", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("whole_sha256"))
    return whole.join(cut, "id", "left").select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"))


def op8_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
