import zlib
from collections import Counter

from llm_data import SHAPE, awkward_rows
from pyspark.sql import functions as F

from loomspark.llm.sharding import CELLS, DEALT, flow, op5_consistent_hash_shards, ring, shard_rows


def lawful(found, rows, shards=8):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    counts = Counter(r.shard for r in found)
    assert all(0 <= s < shards for s in counts)
    assert max(counts.values(), default=0) - min([counts[s] for s in range(shards)]) <= 1
    for s, n in counts.items():
        assert sorted(r.slot for r in found if r.shard == s) == list(range(n))
    assert {(r.law, r.grown_shard) for r in found} <= {("rows", None)}


def test_laws_hold_on_driver_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    lawful(op5_consistent_hash_shards(spark, "/root/testdata/sf0.01").collect(), [(r.doc_id, r.text) for r in docs])


def test_awkward_rows_and_one_hot_key(spark, awkward):
    lawful(op5_consistent_hash_shards(spark, awkward).collect(), awkward_rows())
    rows = [(7, "same", "en", "a", 1)] * 333 + [(i, str(i), "en", "a", 1) for i in range(667)]
    lawful(shard_rows(spark.createDataFrame(rows, SHAPE)).collect(), rows)


def test_overflow_goes_clockwise_and_only_beyond_the_bound():
    points = [(0, 0), (10, 1), (20, 2), (30, 0)]
    rows = flow(points, [7, 1, 1, 3], 3)
    assert sorted(rows) == [(0, 0, 4, 0, 0), (0, 4, 7, 1, 1), (1, 0, 1, 1, 0), (2, 0, 1, 2, 0), (3, 0, 3, 2, 1)]


def test_ring_grows_into_the_new_shard_only():
    before, after = ring(8), ring(9)
    assert set(before) <= set(after) and {s for _, s in set(after) - set(before)} == {8}


def test_few_documents_move_when_a_shard_is_added(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    eight, nine = ({r.doc_id: r.shard for r in shard_rows(docs, n).collect()} for n in (8, 9))
    assert sum(eight[i] != nine[i] for i in eight) < 0.5 * len(eight)  # dealing anew would move 8 of 9


def test_empty(spark, empty):
    assert op5_consistent_hash_shards(spark, empty).count() == 0


def one_by_one(keys, shards):
    """Shard of each (cell, ...) key, dealt one document at a time over the ring: own shard first, then clockwise."""
    points, keys = ring(shards), sorted(keys)
    arc_of = [next((i for i, (c, _) in enumerate(points) if c >= k[0]), 0) for k in keys]
    # An arc's documents in the order of their cells; the arc of the first point also has the cells behind the last one.
    order = sorted(range(len(keys)), key=lambda i: (arc_of[i], keys[i]))
    own = Counter(points[a][1] for a in arc_of)
    share, more = divmod(len(keys), shards)
    room = {s: share + (s in sorted(range(shards), key=lambda s: (-own[s], s))[:more]) for s in range(shards)}
    told, waiting = {}, []
    for i in order:
        if room[s := points[arc_of[i]][1]]:
            room[s] -= 1
            told[i] = s
        else:
            waiting.append(i)
    for i in waiting:
        step = arc_of[i] + 1
        while not room[points[step % len(points)][1]]:
            step += 1
        told[i] = points[step % len(points)][1]
        room[told[i]] -= 1
    return Counter((keys[i], s) for i, s in told.items())


def test_ring_matches_dealing_one_by_one(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(docs.limit(40)).unionByName(docs.select(F.lit(5).cast("long").alias("doc_id"), F.lit("same").alias("text")).limit(300))
    keyed = docs.select(F.pmod(F.xxhash64("doc_id", F.crc32(F.col("text").cast("binary"))), F.lit(CELLS)), "doc_id", F.octet_length("text") + 1, F.crc32(F.col("text").cast("binary")))
    keys = [tuple(r) for r in keyed.collect()]
    cell_of = {k[1:]: k[0] for k in keys}
    for shards in (8, 3):
        found = Counter(((cell_of[(r.doc_id, r.size, r.text_crc32)], r.doc_id, r.size, r.text_crc32), r.shard) for r in shard_rows(docs, shards).collect())
        assert found == one_by_one(keys, shards)


def test_one_row_repeated_more_often_than_is_dealt_at_once(spark):
    rows = spark.range(3 * DEALT + 5).select(F.lit(1).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    lawful(shard_rows(rows).collect(), [(1, "same")] * (3 * DEALT + 5))
