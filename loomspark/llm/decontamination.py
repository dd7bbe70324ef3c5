"""Benchmark decontamination by winnowing (operator 7).

Of the k-grams of words in every window of 10 words, the one with the least hash (the last of equals) is the window's
fingerprint. Equal windows have equal fingerprints at equal places, so any shared span of 10 words shares one. The
benchmark's fingerprints and windows set bits of a bitmap of bounded size, which every task holds; documents look up their
own fingerprints there, extend those found to their whole windows, and only windows whose bit is set are shuffled and
joined, exactly, with the benchmark's distinct windows. Items of fewer than 10 words are one window of their own length,
looked up at every place.

Benchmark and documents may be of any size: the bitmap saves work, the join decides. Equal windows of many items are one
row with a set of items, and a document meets each set once; its digest needs its items' ids together, which are at most
those of the benchmark.

Edge cases: a very long text is one row of many windows; windows of equal hash are equal fingerprints wherever they stand; a null text or one without words has no window; a document shorter than a window can hold short items only;
repeated rows are judged one by one; a null item_id is left out of n_items; an empty table gives no rows or no hits; other
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.llm._store import Tables, free_name, if_small, written
from loomspark.llm._text import ALNUM_WORD, LOWER, U64, mix, ngram_hash, pieces, run_hashes, runs, whole

WORDS, GRAM = 10, 5
#: Bits of the bitmap that stands before the join, for each window of the benchmark, and the most and least in all (32 MB, 8 KB).
BITS_EACH, MOST_BITS, LEAST_BITS = 32, 1 << 28, 1 << 16


def _words(d: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = LOWER[d]
    member = ALNUM_WORD[d]
    start, end, word_off = runs(member, off)
    return run_hashes(d[member], end - start), word_off


def fingerprints(words: np.ndarray, word_off: np.ndarray, n: int = WORDS, k: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the whole windows of n words, and the hash of each one's winning k-gram."""
    at = np.flatnonzero(whole(word_off, n))
    grams = ngram_hash(words, k)
    best = grams[at] if len(at) else np.zeros(0, U64)
    for i in range(1, n - k + 1):
        best = np.minimum(best, grams[at + i])
    return at, best


def _slot(hashes: np.ndarray, bits: int = MOST_BITS) -> np.ndarray:
    """The bit of each hash; of fewer bits, a power of two, the remainder."""
    return (mix(hashes + U64(0x51ED270B)) & U64(bits - 1)).astype(np.int64)


def _item_windows(n: int, k: int):
    def run(batches):
        for batch in batches:
            for rows, d, off in pieces(batch.column(1)):
                words, word_off = _words(d, off)
                lens = np.diff(word_off)
                at, best = fingerprints(words, word_off, n, k)
                parts = [(at, np.full(len(at), n), ngram_hash(words, n)[at] if len(at) else best, best)]
                for m in np.unique(lens[(lens > 0) & (lens < n)]).tolist():
                    at = word_off[:-1][lens == m]
                    own = ngram_hash(words, m)[at]
                    parts.append((at, np.full(len(at), m), own, own))
                at, size, own, best = (np.concatenate(x) for x in zip(*parts, strict=True))
                item = batch.column(0)[rows].take(pa.array(np.searchsorted(word_off, at, "right") - 1))
                yield pa.RecordBatch.from_arrays([item, pa.array(size.astype(np.int32)), pa.array(own.view(np.int64)), pa.array(_slot(own)), pa.array(_slot(best))], ["item_id", "size", "hash", "slot", "mark"])

    return run


def _candidates(bitmap: bytes, short: list[int], n: int, k: int, bits: int):
    def run(batches):
        from pyspark import TaskContext

        bit = np.frombuffer(bitmap, np.uint8)
        held = lambda hashes: (bit[(s := _slot(hashes, bits)) >> 3] >> (s & 7).astype(np.uint8)) & 1 != 0
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for rows, d, off in pieces(batch.column(1)):
                words, word_off = _words(d, off)
                at, best = fingerprints(words, word_off, n, k)
                at = at[held(best)]
                own = ngram_hash(words, n)[at] if len(at) else np.zeros(0, U64)
                keep = held(own)
                parts = [(at[keep], own[keep], n)]
                for m in short:
                    at = np.flatnonzero(whole(word_off, m))
                    own = ngram_hash(words, m)[at] if len(at) else np.zeros(0, U64)
                    keep = held(own)
                    parts.append((at[keep], own[keep], m))
                at, own = (np.concatenate([p[i] for p in parts]) for i in range(2))
                size = np.concatenate([np.full(len(p[0]), p[2], np.int32) for p in parts])
                order = np.argsort(at, kind="stable")
                at, own, size = at[order], own[order], size[order]
                doc = np.searchsorted(word_off, at, "right") - 1
                bounds = np.searchsorted(at, word_off).astype(np.int32)
                windows = pa.StructArray.from_arrays([pa.array((at - word_off[doc]).astype(np.int64)), pa.array(size), pa.array(own.view(np.int64))], ["at", "size", "hash"])
                count = len(word_off) - 1
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + count)), batch.column(0)[rows], pa.array(np.diff(word_off).astype(np.int64)), pa.ListArray.from_arrays(pa.array(bounds), windows)], ["row", "doc_id", "n_words", "windows"])
                row += count

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = WORDS, k: int = GRAM, bits: int | None = None, key: Column | None = None) -> DataFrame:
    """doc_id (or the key given instead), n_words, n_hit, n_items, items_sha256, contaminated of each document.

    bits, a power of two, is the size of the bitmap; by default it goes with the number of the benchmark's windows.
    """
    tables = Tables()
    items = tables.written(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(_item_windows(n, k), "item_id long, size int, hash long, slot long, mark long"), "benchmark-windows")
    bits = bits or min(max(1 << (BITS_EACH * items.count()).bit_length(), LEAST_BITS), MOST_BITS)
    short = sorted(r["size"] for r in items.where(F.col("size") < n).select("size").distinct().collect())  # at most n - 1
    slots = items.select(F.explode(F.array("slot", "mark")).alias("slot")).select((F.pmod("slot", F.lit(bits)) + 1).alias("slot"))  # Spark numbers buckets from 1
    parts = slots.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")).collect()  # bits / 8 bytes in all
    bitmap = bytearray(max((r["bucket"] * len(r["bits"]) for r in parts), default=0) or bits // 8)
    for r in parts:
        bitmap[(r["bucket"] - 1) * len(r["bits"]) : r["bucket"] * len(r["bits"])] = r["bits"]
    bitmap += bytes(max(0, bits // 8 - len(bitmap)))
    rows = docs.select((F.col("doc_id").cast("long") if key is None else key).alias("doc_id"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = tables.written(rows.mapInArrow(_candidates(bytes(bitmap), short, n, k, bits), f"row long, doc_id {kind}, n_words long, windows array<struct<at: long, size: int, hash: long>>"), "decontamination")
    windows = items.groupBy("size", "hash").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    windows = tables.written(windows.select("size", "hash", "items", F.xxhash64("items").alias("set")), "benchmark-sets")
    hits = found.where(F.size("windows") > 0).select("row", F.explode("windows").alias("w")).select("row", "w.*").join(windows.select("size", "hash", "set"), ["size", "hash"])
    hits = tables.written(hits.select("row", "at", "size", "set"), "decontamination-hits")
    tables.close(found, windows, hits)
    reach = F.max(F.col("at") + F.col("size")).over(Window.partitionBy("row").orderBy("at", "size").rowsBetween(Window.unboundedPreceding, -1))
    words = hits.select("row", "at", "size").distinct().withColumn("from", F.greatest(F.col("at"), F.coalesce(reach, F.lit(0))))
    words = words.groupBy("row").agg(F.sum(F.greatest(F.lit(0), F.col("at") + F.col("size") - F.col("from"))).alias("n_hit"))
    sets = windows.select("set", "items").dropDuplicates(["set"])
    named = hits.select("row", "set").distinct().join(sets, "set").groupBy("row").agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    joined = found.select("row", "doc_id", "n_words").join(words, "row", "left").join(named, "row", "left")
    listed = F.concat_ws(",", F.array_sort(F.transform(F.coalesce("items", F.array().cast("array<bigint>")), lambda x: x.cast("string"))))
    return joined.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, unchanged, without those that hold a passage of the benchmark."""
    id_, text = (free_name(c, *docs.columns) for c in ("hit_id", "hit_text"))
    key = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1 << 63)).alias("i"), F.xxhash64("text").alias("t"))
    hit = contamination(docs, benchmark, key=key).where("contaminated").select(F.col("doc_id.i").alias(id_), F.col("doc_id.t").alias(text))
    hit = if_small(written(hit.distinct(), "contaminated"))
    return docs.join(hit, (F.coalesce(docs["doc_id"].cast("long"), F.lit(-1 << 63)) == hit[id_]) & (F.xxhash64(docs["text"]) == hit[text]), "left_anti")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
with d as (select doc_id, {_WORDS} as w from documents),
b as (select item_id, {_WORDS} as w from benchmark),
bw as (select distinct item_id, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) as g
    from (select item_id, w, least(len(w), {WORDS}) as m from b where len(w) > 0)),
dw as (select doc_id, m, unnest(range(1, len(w) - m + 2)) as i, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) as g
    from d, (select distinct m from bw) where len(w) >= m),
hits as (select doc_id, i, m, item_id from dw join bw using (m, g)),
words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + m)) as p from (select distinct doc_id, i, m from hits)) group by doc_id),
items as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as s from hits group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (doc_id) left join items using (doc_id)
"""
