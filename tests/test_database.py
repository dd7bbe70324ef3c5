"""Collections: reads, writes, durability, recovery, maintenance, search."""

import math

import pytest
from pyspark.sql import functions as F

from loomspark import cli
from loomspark.database import Database
from loomspark.plans import filters as P
from loomspark.streaming.upserts import upsert_stream
from loomspark.types import (
    AlreadyOpen,
    BatchAborted,
    BatchTooLarge,
    Cancelled,
    ChecksumMismatch,
    CollectionExists,
    CollectionNotFound,
    Config,
    DatabaseClosed,
    DatabaseNotFound,
    Document,
    DocumentNotFound,
    DuplicateId,
    Include,
    InvalidCollectionName,
    InvalidConfig,
    InvalidDocumentId,
    InvalidVectorData,
    InvalidVectorDimension,
    MetadataTooDeep,
    MetadataTooLarge,
    NoValidManifest,
    ReadOnly,
    TopKOutOfRange,
    ValidationError,
)

COMPASS = {"north": [0.0, 1.0], "east": [1.0, 0.0], "south": [0.0, -1.0], "northeast": [0.7, 0.7]}


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/db"


def compass(db):
    own = db.create_collection("c", 2)
    own.upsert_many([Document(k, v, {"name": k}) for k, v in COMPASS.items()])
    return own


def hits(response):
    return [h.id for h in response.hits]


def test_search_orders_by_score_then_id(spark, path):
    with Database(spark, path) as db:
        own = compass(db)
        found = own.search([1.0, 0.0], 3)
        assert hits(found) == ["east", "northeast", "north"] and found.stats.exact and found.stats.considered == 4
        assert found.hits[0].score == pytest.approx(1) and found.hits[0].distance == pytest.approx(0, abs=1e-9)
        assert hits(own.search([0.0, 1.0], 2, metric="l2")) == ["north", "northeast"]
        assert hits(own.search([1.0, 0.0], 9, min_score=0.5)) == ["east", "northeast"]
        assert own.search([1.0, 0.0], 1, metric="dot").hits[0].distance is None
        ties = db.create_collection("t", 2)
        ties.upsert_many([Document(i, [1.0, 1.0]) for i in ("d", "b", "a", "c")])
        ties.flush()
        assert hits(ties.search([1.0, 0.0], 3)) == ["a", "b", "c"]
        zero = db.create_collection("z", 2)
        zero.upsert_many([Document("zero", [0, 0]), Document("east", [1, 0])])
        assert [h.score for h in zero.search([1.0, 0.0], 2).hits] == [1.0, 0.0]
        assert hits(zero.search([0.0, 0.0], 2)) == ["east", "zero"]


def test_filters_in_search(spark, path):
    with Database(spark, path) as db:
        own = db.create_collection("shop", 2)
        rows = [("a", {"category": "x", "price": 3.5, "tags": ["new", 1]}), ("b", {"category": "x", "price": None, "raw": b"\x80"}), ("c", {"category": "y", "tags": []}), ("d", {"price": 7, "deep": {"a": {"b": [1, {"c": True}]}}})]
        own.upsert_many([Document(i, [1.0, 0.1 * k], m) for k, (i, m) in enumerate(rows)])
        ask = lambda f: sorted(hits(own.search([1.0, 0.0], 10, f)))
        for _ in range(2):  # buffered, then on disk
            assert ask({"category": "x"}) == ["a", "b"]
            assert ask(P.ne("category", "x")) == ["c", "d"]
            assert ask(P.gt("price", 3)) == ["a", "d"] and ask(P.is_null("price")) == ["b", "c"] and ask(P.exists("price")) == ["a", "b", "d"]
            assert ask(P.contains("tags", "new")) == ["a"] and ask(P.eq("tags", [])) == ["c"]
            assert ask(P.eq("raw", b"\x80")) == ["b"] and ask(P.gt("raw", b"\x7f")) == ["b"]
            assert ask(P.eq("deep", {"a": {"b": [1.0, {"c": True}]}})) == ["d"] and ask(P.eq("deep.a", {"b": []})) == []
            assert own.search([1.0, 0.0], 10, {"category": "x"}).stats.skipped == 2
            assert own.get("d").metadata == rows[3][1] and own.get("b").metadata == rows[1][1]
            own.flush()
        with pytest.raises(ValidationError):
            own.search([1.0, 0.0], 1, {"a": {"$near": 1}})


def test_writes_and_reports(spark, path):
    with Database(spark, path) as db:
        own = compass(db)
        with pytest.raises(DuplicateId):
            own.insert(Document("east", [1, 1]))
        own.insert(Document("west", [-1, 0], content=b"w"))
        assert own.upsert(Document("west", [-1, 0.5], content=b"W")) == "updated" and own.upsert(Document("up", [0, 2])) == "inserted"
        assert own.delete("up") and not own.delete("up") and "up" not in own and len(own) == 5
        own.flush()
        report = own.write_batch([("upsert", Document("n", [1, 1])), ("upsert", Document("n", [2, 2])), ("upsert", Document("east", [3, 3])), ("delete", "south"), ("delete", "none"), ("delete", "n")])
        assert (report.inserted, report.updated, report.deleted, report.missing_deletes) == (2, 1, 1, 2)
        assert [r.id for r in own.ids().collect()] == ["east", "north", "northeast", "west"]
        own.flush()
        assert own.require("east").vector == [3, 3] and own.get("west").content == b"W" and own.get("west", Include()).content is None
        assert [r.id for r in own.ids().collect()] == ["east", "north", "northeast", "west"]
        with pytest.raises(DocumentNotFound):
            own.require("south")
        with pytest.raises(BatchAborted) as e:
            own.write_batch([("upsert", Document("q", [1, 1])), ("upsert", Document("r", [1])), ("delete", "east")])
        assert (e.value.failed_at, e.value.total_ops) == (1, 3) and "q" not in own
        with pytest.raises(BatchTooLarge):
            own.write_batch([("delete", "x")] * 100_001)
        assert own.write_batch([]).inserted == 0


def test_state_survives_reopening(spark, path):
    db = Database(spark, path)
    own = compass(db)
    own.flush()
    own.delete("east")
    own.upsert(Document("west", [-1, 0], {"n": 1.5}))
    with pytest.raises(AlreadyOpen):
        Database(spark, path)
    db._release()  # as if the process had ended: nothing is flushed
    with Database(spark, path, Config(create_if_missing=False, read_only=True)) as again:
        assert [r.id for r in again.collection("c").ids().collect()] == ["north", "northeast", "south", "west"]
        assert again.collection("c").get("west").metadata == {"n": 1.5}
        with pytest.raises(ReadOnly):
            again.collection("c").delete("west")
    with Database(spark, path) as again:
        again.collection("c").flush()
        assert not again.files.names("c_c/log")
    with pytest.raises(DatabaseClosed):
        again.list_collections()


def test_torn_and_damaged_files(spark, path, tmp_path):
    db = Database(spark, path)
    own = compass(db)
    for i in range(3):
        own.upsert(Document(f"x{i}", [1, i]))
    db._release()
    log = sorted((tmp_path / "db/c_c/log").glob("[0-9]*.json"))
    for f in (tmp_path / "db/c_c/log").glob(".*.crc"):
        f.unlink()
    log[-1].write_text(log[-1].read_text()[:-9])
    db = Database(spark, path)
    assert "x1" in db.collection("c") and "x2" not in db.collection("c")
    db._release()
    log[1].write_text("nonsense")
    with pytest.raises(ChecksumMismatch):
        Database(spark, path)
    log[1].unlink()
    for f in (tmp_path / "db/_manifest").glob(".*.crc"):
        f.unlink()
    newest = sorted((tmp_path / "db/_manifest").glob("*.json"))[-1]
    newest.write_text(newest.read_text()[:-1])
    Database(spark, path).close()  # the one before is still valid
    for f in (tmp_path / "db/_manifest").glob("*.json"):
        f.write_text("")
    for f in (tmp_path / "db/_manifest").glob(".*.crc"):
        f.unlink()
    with pytest.raises(NoValidManifest):
        Database(spark, path)
    with pytest.raises(DatabaseNotFound):
        Database(spark, f"{path}-none", Config(create_if_missing=False))


def test_bulk_upsert_compaction_stats_and_verification(spark, path, tmp_path):
    with Database(spark, path) as db:
        own = db.create_collection("v", 3, "l2", id_kind="u64")
        rows = spark.range(1000).select("id", F.array(F.col("id") % 7, F.col("id") % 11, F.col("id") % 3).alias("vector"))
        assert own.upsert_frame(rows).inserted == 1000
        report = own.upsert_frame(rows.where("id >= 600 and id < 1100").withColumn("metadata", F.parse_json(F.lit('{"second":true}'))))
        assert (report.inserted, report.updated) == (0, 400)
        own.write_batch([("delete", i) for i in range(300)])
        own.flush()
        stats = own.stats()
        assert (stats["live"], stats["total_rows"], stats["segments"]) == (700, 1400, 2) and stats["dead_ratio"] == 0.5
        assert own.compact(0.3) == {"rewritten": 1, "created": 1, "reclaimed": 700}
        assert own.count() == 700 and own.stats()["dead_ratio"] == 0
        second = [(i % 7) ** 2 + (i % 11) ** 2 + (i % 3) ** 2 for i in range(600, 1000)]
        assert hits(own.search([0.0, 0.0, 0.0], 3, P.eq("second", True))) == sorted(range(600, 1000), key=lambda i: (second[i - 600], i))[:3]
        assert db.compact(0.0)["rewritten"] == 2 and own.count() == 700
        assert db.verify("full").is_clean and db.stats()["live"] == 700
        with pytest.raises(DuplicateId):
            own.upsert_frame(rows.unionByName(rows))
        assert own.upsert_frame(rows.unionByName(rows).withColumn("n", F.monotonically_increasing_id()), order="n").updated == 700
        with pytest.raises(InvalidVectorDimension):
            own.upsert_frame(rows.select("id", F.array(F.lit(1.0)).alias("vector")))
        with pytest.raises(InvalidVectorData):
            own.upsert_frame(rows.select("id", F.array(F.lit(1.0), F.lit(float("nan")), F.lit(2.0)).alias("vector")))
        batch = own.search_batch(rows.where("id % 500 = 0").select(F.col("id").alias("query_id"), F.col("vector").cast("array<float>").alias("vector")), 2)
        assert batch.count() == 4
    assert cli.main(["verify", path], spark) == 0 and cli.main(["get", path, "v", "5"], spark) == 0
    assert cli.main(["get", path, "v", "5000"], spark) == 4 and cli.main(["stats", path, "--json"], spark) == 0
    assert cli.main(["compact", path], spark) == 0 and cli.main(["inspect", path], spark) == 0 and cli.main(["version"]) == 0
    assert cli.main(["stats", f"{path}-none"], spark) == 1 and cli.main(["nothing"]) == 2
    part = next((tmp_path / "db/c_v").glob("seg-*/part-*.parquet"))
    data = bytearray(part.read_bytes())
    data[4 : len(data) // 2] = bytes(len(data) // 2 - 4)
    part.write_bytes(data)
    (part.parent / f".{part.name}.crc").unlink()
    assert cli.main(["verify", path], spark) == 3


def test_snapshots_pin_their_state(spark, path):
    with Database(spark, path) as db:
        own = compass(db)
        own.flush()
        before = own.frame()
        own.delete("east")
        own.flush()
        assert before.count() == 4 and own.count() == 3


def test_approximate_collection(spark, path):
    with Database(spark, path) as db:
        own = db.create_collection("a", 8, index="ann")
        draw = spark.range(2000).select(F.col("id").cast("string").alias("id"), F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.sin(F.col("id") * 0.37 + i * (F.col("id") % 12))).alias("vector"))
        own.upsert_frame(draw)
        query = own.get("77").vector
        fast, exact = own.search(query, 10, n_probe=12), own.search(query, 10, exact=True)
        assert fast.stats.index == "ann" and not fast.stats.exact and exact.stats.exact
        assert len(set(hits(fast)) & set(hits(exact))) >= 8 and hits(fast)[0] == "77"
        first = own.index()
        assert own.index() is first
        own.upsert(Document("new", query))
        assert own.index() is first and "new" in hits(own.search(query, 3))  # the index is kept, the new row found
        assert len(hits(own.search(query, 50, {"a": None}, n_probe=1))) == 50


def ring(spark, n):
    return spark.range(n).select(F.col("id").cast("string").alias("id"), F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.sin(F.col("id") * 0.37 + i * (F.col("id") % 12))).alias("vector"))


def test_index_snapshot_survives_reopening_and_takes_in_new_rows(spark, path, tmp_path):
    with Database(spark, path) as db:
        own = db.create_collection("a", 8, index="ann")
        own.upsert_frame(ring(spark, 1500))
        number, probes = own.build_index().number, own.index().n_probe
        own.upsert_frame(ring(spark, 2000).where("cast(id as int) >= 1500"))
        query = own.get("1700").vector
        assert own.stats()["indexed"] == 2000 and own.stats()["segments"] == 2
        assert own.stats()["index_stats"] == {"kind": "ann", "number": number, "cells": 39, "n_probe": probes, "largest_cell": max(own.index().sizes)} and sum(own.index().sizes) == 1500
        found = own.search(query, 5)
        assert found.hits[0].id == "1700" and not found.stats.exact and found.stats.scanned < 2000
        plan = own._on_disk(cells=[3])._jdf.queryExecution().toString()
        assert "PartitionFilters: [isnotnull(cell" in plan and "(cell" in plan
    with Database(spark, path, Config(create_if_missing=False, read_only=True)) as db:
        own = db.collection("a")
        assert own.index().number == number and own.index().n_probe == probes and db.verify("full").is_clean
    snapshot = tmp_path / f"db/c_a/index-{number}.json"
    snapshot.write_text(snapshot.read_text()[:-50])
    for f in (tmp_path / "db/c_a").glob(".index*.crc"):
        f.unlink()
    with Database(spark, path, Config(create_if_missing=False, read_only=True)) as db:  # exact, for want of an index
        own = db.collection("a")
        assert own.index() is None and own.search(query, 5).stats.exact and own.search(query, 5).hits[0].id == "1700"
        report = db.verify("quick")
        assert report.is_clean and any("can't be read" in w for w in report.warnings)
    with Database(spark, path) as db:  # fitted anew
        own = db.collection("a")
        assert own.search(query, 5).hits[0].id == "1700" and own.index().number != number and own.count() == 2000
        own.upsert_frame(ring(spark, 9000))
        assert own.compact(0.9)["created"] == 1 and own.stats()["indexed"] == 9000  # grown by more than REFIT


def test_a_temporary_database_and_segments_that_were_exchanged(spark, path, tmp_path):
    with Database.temporary(spark) as db:
        assert len(compass(db)) == 4
        where = db.files
    assert not where.exists()
    with Database(spark, path) as db:
        own = compass(db)
        own.flush()
        assert db.verify("checksums").is_clean
        other = own._segment_rows().withColumn("vector", F.transform("vector", lambda x: (x + 1).cast("float")))
        rows = other.collect()
        db.files.delete("c_c/seg-1")
        spark.createDataFrame(rows, other.schema).write.parquet(db.files.url("c_c/seg-1"))
        assert db.verify("quick").is_clean and "isn't what was written" in str(db.verify("checksums").errors)


def test_a_budget_counts_the_rows_read(spark, path):
    with Database(spark, path) as db:
        own = db.create_collection("a", 8, index="ann")
        own.upsert_frame(ring(spark, 3000))
        query = own.get("5").vector
        needed = own.search(query, 5).stats.scanned
        assert needed < 3000 and own.search(query, 5, max_scanned=needed).hits
        assert needed < own.search(query, 5, min_candidates=2500).stats.scanned >= 2500
        with pytest.raises(Cancelled):
            own.search(query, 5, max_scanned=needed - 1)
        with pytest.raises(Cancelled):
            own.search(query, 5, max_scanned=2999, exact=True)


def test_a_lock_dies_with_its_owner(spark, path, tmp_path):
    import subprocess
    import sys
    import time

    db = Database(spark, path)
    compass(db)
    db._release()
    gone = subprocess.run([sys.executable, "-c", "import os, socket; print(socket.gethostname(), os.getpid(), 'x')"], capture_output=True, text=True).stdout.strip()
    db.files.create("LOCK", gone)
    Database(spark, path).close()  # its process is gone
    db.files.create("LOCK", "elsewhere 1 x")
    with pytest.raises(AlreadyOpen):
        Database(spark, path)
    db.files._fs.setTimes(db.files._path("LOCK"), int((time.time() - 1000) * 1000), -1)
    with Database(spark, path) as again:  # its lease has run out
        assert again.collection("c").count() == 4


def test_collections_and_limits(spark, path):
    with Database(spark, path) as db:
        own = compass(db)
        db.create_collection("a", 3)
        assert db.list_collections() == ["a", "c"] and db.collection_exists("a")
        assert db.get_or_create_collection("c", 2) is own
        for wrong in (lambda: db.create_collection("c", 2), lambda: db.get_or_create_collection("c", 5)):
            with pytest.raises(CollectionExists):
                wrong()
        db.drop_collection("a")
        with pytest.raises(CollectionNotFound):
            db.collection("a")
        for name in ("..", "a/b", "café", "", "x" * 65):
            with pytest.raises(InvalidCollectionName):
                db.create_collection(name, 2)
        for bad, error in ((Document("", [1, 1]), InvalidDocumentId), (Document("x" * 513, [1, 1]), InvalidDocumentId), (Document("a\x07", [1, 1]), InvalidDocumentId), (Document("a", [1]), InvalidVectorDimension), (Document("a", [1, math.inf]), InvalidVectorData), (Document("a", [1, 1], {"x": "y" * 70_000}), MetadataTooLarge), (Document("a", [1, 1], {"x": math.nan}), ValidationError)):
            with pytest.raises(error):
                own.upsert(bad)
        deep: dict = {}
        for _ in range(20):
            deep = {"a": deep}
        with pytest.raises(MetadataTooDeep):
            own.upsert(Document("a", [1, 1], deep))
        for k in (0, 10_001):
            with pytest.raises(TopKOutOfRange):
                own.search([1.0, 1.0], k)
        with pytest.raises(Cancelled):
            own.search([1.0, 1.0], 1, max_scanned=3)
        for wrong in ({"flush_threshold": 0}, {"read_only": True}, {"durability": "none"}):
            with pytest.raises(InvalidConfig):
                Config(**wrong)


def test_automatic_flush_and_relaxed_durability(spark, path):
    with Database(spark, path, Config(flush_threshold=200, durability="relaxed")) as db:
        own = compass(db)
        assert own.stats()["segments"] == 1 and own.stats()["buffered"] == 0


def test_streaming_upserts_are_applied_once(spark, path, tmp_path):
    with Database(spark, path) as db:
        own = db.create_collection("s", 2, id_kind="u64")
        spark.range(10).select("id", F.array(F.lit(1.0), F.col("id").cast("double")).alias("vector")).write.parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("id long, vector array<double>").parquet(f"{tmp_path}/in")
        for _ in range(2):
            upsert_stream(stream, own, f"file://{tmp_path}/check").awaitTermination()
            assert own.count() == 10
        spark.range(5, 15).select("id", F.array(F.lit(2.0), F.col("id").cast("double")).alias("vector")).write.mode("append").parquet(f"{tmp_path}/in")
        upsert_stream(stream, own, f"file://{tmp_path}/check").awaitTermination()
        assert own.count() == 15 and own.get(7).vector == [2.0, 7.0]
