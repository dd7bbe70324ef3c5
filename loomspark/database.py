"""Databases of vector collections over Parquet segments.

A database is a folder. ``_manifest`` has numbered records, of which the highest valid one is the state; a commit is the
creation of the next. A collection is a list of immutable segments and a list of tombstone files: a row is dead if a
tombstone of its id has a later sequence number. Single writes go to a change log and a buffer on the driver, which a flush
turns into a segment; ``upsert_frame`` writes a segment from a DataFrame without passing the driver. A DataFrame from
``frame`` is the state at that moment.

The approximate index of a collection is a snapshot of centroids beside its segments, named in the manifest. Segments
written since are stored by cell; the others, and the buffer, are searched in whole. A snapshot that is missing or damaged
costs a new fit, never a result.

A LOCK file holds its owner's host and process and is touched while the owner lives: one whose process is gone, or that
wasn't touched for ``LEASE`` seconds, is taken over.
"""

from __future__ import annotations

import base64
import os
import socket
import threading
import time
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import asdict
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.functions.variant import from_variant, to_variant
from loomspark.functions.vectors import inverse_norm, valid_vector
from loomspark.operators import ann
from loomspark.operators.index import Flat, VectorIndex
from loomspark.operators.maintenance import collection_stats, duplicate_ids, marked, segment_stats
from loomspark.operators.search import knn, knn_batch
from loomspark.plans.filters import Filter, VariantFields, compile_filter
from loomspark.sources.files import Files, shared_folder
from loomspark.types import (
    FORMAT_VERSION,
    MAX_BATCH,
    METRICS,
    AlreadyOpen,
    BatchAborted,
    BatchReport,
    BatchTooLarge,
    Cancelled,
    ChecksumMismatch,
    CollectionExists,
    CollectionNotFound,
    CollectionSpec,
    Config,
    DatabaseClosed,
    DatabaseNotFound,
    Document,
    DocumentNotFound,
    DuplicateId,
    EngineError,
    Hit,
    Include,
    InvalidConfig,
    InvalidVectorData,
    InvalidVectorDimension,
    NotADatabase,
    NoValidManifest,
    ReadOnly,
    SearchResponse,
    SearchStats,
    ValidationError,
    VerifyReport,
    check_document,
    check_id,
    check_name,
    check_top_k,
    check_vector,
)

KEPT_MANIFESTS = 2
#: Seconds after which a LOCK that isn't touched any more is taken over.
LEASE = 120
#: An index is fitted anew by compact when its collection has grown by this factor.
REFIT = 4
VERIFY_LEVELS = ("quick", "checksums", "full")


def _kind(spec: CollectionSpec) -> T.DataType:
    return T.LongType() if spec.id_kind == "u64" else T.StringType()


def row_schema(spec: CollectionSpec) -> T.StructType:
    return T.StructType(
        [
            T.StructField("id", _kind(spec)),
            T.StructField("vector", T.ArrayType(T.FloatType(), False)),
            T.StructField("inv_norm", T.DoubleType()),
            T.StructField("metadata", T.VariantType()),
            T.StructField("content", T.BinaryType()),
            T.StructField("seq", T.LongType()),
            T.StructField("segment", T.LongType()),
        ]
    )


class Database:
    """One open database. Usable as a context manager."""

    def __init__(self, spark: SparkSession, path: str, config: Config = Config()):
        self.spark, self.config, self.files = spark, config, Files(spark, path)
        self._token, self._open = uuid.uuid4().hex, False
        self._collections: dict[str, Collection] = {}
        self._temporary = False
        there = self.files.exists("_manifest")
        if not there and not config.create_if_missing:
            raise NotADatabase(path) if self.files.exists() and self.files.names() else DatabaseNotFound(path)
        if not there and self.files.exists() and self.files.names():
            raise NotADatabase(f"{path} has other files")
        if not config.read_only:
            self._lock()
        self._open = True
        try:
            self.state = self._newest() if there else {"version": 0, "format": FORMAT_VERSION, "created_at_ms": int(time.time() * 1000), "collections": {}}
            if not there:
                self._commit()
            for name in self.state["collections"]:
                self._collections[name] = Collection(self, name)
        except BaseException:
            self._release()
            raise

    @classmethod
    def temporary(cls, spark: SparkSession, config: Config = Config()) -> Database:
        """A database in the shared folder that is gone when it is closed."""
        found = cls(spark, f"{shared_folder(spark)}/temporary-{uuid.uuid4().hex}", config)
        found._temporary = True
        return found

    def __enter__(self) -> Database:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    # The lock.

    def _lock(self) -> None:
        owner = f"{socket.gethostname()} {os.getpid()} {self._token}"
        if not self.files.create("LOCK", owner):
            if not self._abandoned(held := self.files.read("LOCK")) or self.files.read("LOCK") != held:
                raise AlreadyOpen(f"{self.files.root}: locked by {held}")
            self.files.delete("LOCK")
            if not self.files.create("LOCK", owner):
                raise AlreadyOpen(f"{self.files.root}: locked by {self.files.read('LOCK')}")
        self._released = threading.Event()

        def touch() -> None:
            while not self._released.wait(LEASE / 4):
                try:
                    self.files.touch("LOCK")
                except Exception:  # the session has ended; the lease runs out
                    return

        threading.Thread(target=touch, daemon=True).start()

    def _abandoned(self, owner: str) -> bool:
        """Whether the process that holds the lock is gone: known on its own host, and elsewhere by its lease."""
        host, _, rest = owner.partition(" ")
        pid = rest.partition(" ")[0]
        if host == socket.gethostname() and pid.isdigit():
            try:
                os.kill(int(pid), 0)
            except ProcessLookupError:
                return True
            except PermissionError:
                pass
            return False
        return time.time() - self.files.modified("LOCK") > LEASE

    # The manifest.

    def _newest(self) -> dict:
        names = [n for n in self.files.names("_manifest") if n.endswith(".json")]
        for name in reversed(names):
            found = self.files.read_record(f"_manifest/{name}")
            if found is not None:
                if found["format"] > FORMAT_VERSION:
                    raise EngineError(f"format {found['format']} is newer than {FORMAT_VERSION}")
                return found
        raise NoValidManifest(self.files.root)

    def _commit(self) -> None:
        """The state as the next record. One writer holds the lock; a record that is there already means another one."""
        names = self.files.names("_manifest")
        number = max([int(n.split(".")[0]) for n in names if n.endswith(".json")], default=0) + 1
        self.state["version"] = number
        if not self.files.create_record(f"_manifest/{number:020d}.json", self.state, self.config.durability != "relaxed"):
            raise AlreadyOpen("another writer has committed")
        for old in sorted(n for n in names if n.endswith(".json"))[: 1 - KEPT_MANIFESTS or None]:
            self.files.delete(f"_manifest/{old}")

    def _release(self) -> None:
        if not self.config.read_only and self._open:
            self._released.set()
            if self.files.exists("LOCK") and self.files.read("LOCK").endswith(self._token):
                self.files.delete("LOCK")
        self._open = False

    def _writable(self) -> None:
        self._check_open()
        if self.config.read_only:
            raise ReadOnly(self.files.root)

    def _check_open(self) -> None:
        if not self._open:
            raise DatabaseClosed(self.files.root)

    # Life.

    @property
    def is_open(self) -> bool:
        return self._open

    def close(self) -> None:
        """Flushes and releases the lock; again, it does nothing."""
        if not self._open:
            return
        try:
            if not self.config.read_only and not self._temporary:
                self.flush()
        finally:
            self._release()
            if self._temporary:
                self.files.delete("")

    def flush(self) -> None:
        self._writable()
        for c in self._collections.values():
            c.flush()

    # Collections.

    def create_collection(self, name: str, dimension: int, metric: str = "cosine", **options: Any) -> Collection:
        self._writable()
        spec = CollectionSpec(name, dimension, metric, created_at_ms=int(time.time() * 1000), **options)
        if name in self._collections:
            raise CollectionExists(name)
        self.state["collections"][name] = {"spec": asdict(spec), "segments": [], "dead": [], "seq": 0, "next": 1, "sources": {}, "index": None}
        self._commit()
        self._collections[name] = Collection(self, name)
        return self._collections[name]

    def collection(self, name: str) -> Collection:
        self._check_open()
        check_name(name)
        if name not in self._collections:
            raise CollectionNotFound(name)
        return self._collections[name]

    def get_or_create_collection(self, name: str, dimension: int, metric: str = "cosine", **options: Any) -> Collection:
        self._check_open()
        if name not in self._collections:
            return self.create_collection(name, dimension, metric, **options)
        found = self._collections[name]
        if not found.spec.same_shape(CollectionSpec(name, dimension, metric, **options)):
            raise CollectionExists(f"{name} has another dimension, metric or kind of id")
        return found

    def collection_exists(self, name: str) -> bool:
        self._check_open()
        return name in self._collections

    def drop_collection(self, name: str) -> None:
        self._writable()
        self.collection(name)
        del self.state["collections"][name], self._collections[name]
        self._commit()
        self.files.delete(f"c_{name}")

    def list_collections(self) -> list[str]:
        self._check_open()
        return sorted(self._collections)

    # All of them.

    def compact(self, min_dead_ratio: float = 0.3) -> dict[str, int]:
        self._writable()
        reports = [c.compact(min_dead_ratio) for c in self._collections.values()]
        return {k: sum(r[k] for r in reports) for k in ("rewritten", "created", "reclaimed")}

    def stats(self) -> dict[str, Any]:
        self._check_open()
        each = {n: self._collections[n].stats() for n in self.list_collections()}
        sums = {k: sum(s[k] for s in each.values()) for k in ("live", "total_rows", "segments", "buffered", "buffer_bytes")}
        return {"collections": each, **sums, "manifest": self.state["version"], "format": self.state["format"], "read_only": self.config.read_only, "durable_sync": self.config.durability != "relaxed"}

    def verify(self, level: str = "full") -> VerifyReport:
        """Looks for damage; whatever it finds is in the report, nothing is raised."""
        self._check_open()
        if level not in VERIFY_LEVELS:
            raise InvalidConfig(f"level {level!r}: one of {VERIFY_LEVELS}")
        report = VerifyReport(level)
        for name in self.list_collections():
            self._collections[name].verify_into(report)
        known = {f"c_{n}" for n in self._collections} | {"_manifest", "LOCK"}
        report.warnings += [f"orphan: {n}" for n in self.files.names() if n not in known and not n.startswith(".")]
        return report

    def cancel(self, tag: str) -> None:
        """Stops the running searches that were given this tag."""
        self.spark.interruptTag(tag)


class Collection:
    """Documents of one dimension under one metric."""

    def __init__(self, database: Database, name: str):
        self.database, self.name = database, name
        self.spark, self.files = database.spark, database.files
        self.spec = CollectionSpec(**self._state["spec"])
        self._buffer: dict[Any, tuple[int, Document | None]] = {}
        self._buffer_bytes = 0
        self._index: ann.Index | None = None
        self._recover()

    @property
    def _state(self) -> dict:
        try:
            return self.database.state["collections"][self.name]
        except KeyError:
            raise CollectionNotFound(self.name) from None

    # The change log.

    def _recover(self) -> None:
        """Buffers the committed changes since the last flush. A torn last file was never committed; any other is damage."""
        names = self.files.names(f"c_{self.name}/log")
        for name in names:
            ops = self.files.read_record(f"c_{self.name}/log/{name}")
            if ops is None:
                if name != names[-1]:
                    raise ChecksumMismatch(f"c_{self.name}/log/{name}")
                if not self.database.config.read_only:
                    self.files.delete(f"c_{self.name}/log/{name}")
                continue
            for op in ops:
                if op["seq"] > self._state["seq"]:
                    self._put(op["seq"], op["id"], None if op["op"] == "delete" else self._document(op))

    @staticmethod
    def _document(op: dict) -> Document:
        from pyspark.sql.types import VariantVal

        decode = lambda x: None if x is None else base64.b64decode(x)
        metadata = from_variant(VariantVal(decode(op["value"]), decode(op["keys"])))
        return Document(op["id"], op["vector"], metadata, decode(op["content"]))

    def _log(self, changes: Sequence[tuple[int, Any, Document | None]]) -> None:
        """One file for each commit: all of its changes or none."""
        if self.database.config.durability == "relaxed":
            return
        text = lambda x: None if x is None else base64.b64encode(x).decode()
        ops = []
        for seq, id_, doc in changes:
            op: dict[str, Any] = {"seq": seq, "id": id_, "op": "delete" if doc is None else "put"}
            if doc is not None:
                v = to_variant(doc.metadata)
                op |= {"vector": doc.vector, "value": text(bytes(v.value)), "keys": text(bytes(v.metadata)), "content": text(doc.content)}
            ops.append(op)
        if not self.files.create_record(f"c_{self.name}/log/{changes[0][0]:020d}.json", ops, self.database.config.durability == "full"):
            raise AlreadyOpen(f"{self.name}: another writer has logged these changes")

    def _put(self, seq: int, id_: Any, doc: Document | None) -> None:
        self._buffer[id_] = (seq, doc)
        self._buffer_bytes += 64 if doc is None else 64 + 4 * self.spec.dimension + 32 * len(doc.metadata or {}) + len(doc.content or b"")

    @property
    def _last_seq(self) -> int:
        return max([self._state["seq"], *(s for s, _ in self._buffer.values())])

    # Reads.

    def frame(self) -> DataFrame:
        """id, vector, inv_norm, metadata, content, seq, segment of all live documents (segment 0: not flushed yet)."""
        self.database._check_open()
        return self._with_buffer(self._on_disk())

    def _with_buffer(self, rows: DataFrame) -> DataFrame:
        if self._buffer:
            ids = self.spark.createDataFrame([(i,) for i in self._buffer], T.StructType([T.StructField("id", _kind(self.spec))]))
            rows = rows.join(ids, "id", "left_anti").select(*row_schema(self.spec).names).unionByName(self._buffered())
        return rows

    def _on_disk(self, segments: list[int] | None = None, cells: list[int] | None = None) -> DataFrame:
        rows = self._segment_rows(segments, cells)
        if not self._state["dead"]:
            return rows
        dead = self._tombstones().groupBy("id").agg(F.max("seq").alias("dead_to"))
        joined = rows.join(dead.withColumnRenamed("id", "dead_id"), (F.col("id") == F.col("dead_id")) & (F.col("seq") < F.col("dead_to")), "left_anti")
        return joined.select(*row_schema(self.spec).names)

    def _segment_rows(self, segments: list[int] | None = None, cells: list[int] | None = None) -> DataFrame:
        """Rows of all segments or of those named; of segments stored by the present index, only of the cells named."""
        shape, present = row_schema(self.spec), (self._state.get("index") or {}).get("number")
        chosen = [s for s in self._state["segments"] if segments is None or s["number"] in segments]
        urls = lambda own: [self.files.url(f"c_{self.name}/seg-{s['number']}") for s in own]
        parts = []
        if plain := [s for s in chosen if not s.get("index")]:
            parts.append(self.spark.read.schema(shape).parquet(*urls(plain)))
        by_cell = T.StructType([*shape.fields, T.StructField("cell", T.IntegerType())])
        for s in chosen:
            if s.get("index"):  # folders of cells are found in one segment at a time
                rows = self.spark.read.schema(by_cell).parquet(*urls([s]))
                parts.append((rows.where(F.col("cell").isin(cells)) if s["index"] == present and cells is not None else rows).select(*shape.names))
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], shape)

    def _tombstones(self) -> DataFrame:
        shape = T.StructType([T.StructField("id", _kind(self.spec)), T.StructField("seq", T.LongType())])
        paths = [self.files.url(f"c_{self.name}/dead-{n}") for n in self._state["dead"]]
        return self.spark.read.schema(shape).parquet(*paths) if paths else self.spark.createDataFrame([], shape)

    def _buffered(self) -> DataFrame:
        rows = [(i, d.vector, None, to_variant(d.metadata), None if d.content is None else bytearray(d.content), s, 0) for i, (s, d) in self._buffer.items() if d is not None]
        return self.spark.createDataFrame(rows, row_schema(self.spec)).withColumn("inv_norm", inverse_norm(F.col("vector")))

    def get(self, id_: Any, include: Include = Include(True, True, True)) -> Document | None:
        self.database._check_open()
        check_id(id_, self.spec)
        if id_ in self._buffer:
            doc = self._buffer[id_][1]
            return doc and Document(id_, doc.vector if include.vector else None, (doc.metadata or {}) if include.metadata else {}, doc.content if include.content else None)
        found = self._on_disk().where(F.col("id") == id_).select("id", *include.columns()).limit(1).collect()
        return self._returned(found[0], include) if found else None

    def _returned(self, row: Any, include: Include) -> Document:
        content = bytes(row["content"]) if include.content and row["content"] is not None else None
        return Document(row["id"], row["vector"] if include.vector else None, from_variant(row["metadata"]) if include.metadata else {}, content)

    def require(self, id_: Any, include: Include = Include(True, True, True)) -> Document:
        found = self.get(id_, include)
        if found is None:
            raise DocumentNotFound(f"{self.name}: {id_!r}")
        return found

    def contains(self, id_: Any) -> bool:
        self.database._check_open()
        check_id(id_, self.spec)
        return bool(self._existing([id_]))

    __contains__ = contains

    def ids(self) -> DataFrame:
        return self.frame().select("id").distinct().orderBy("id")

    def count(self) -> int:
        return self.frame().count()

    __len__ = count

    # Search.

    def _condition(self, where: Filter | dict | None):
        return None if where is None else compile_filter(where, VariantFields(F.col("metadata")))

    def search_frame(self, query: Any, k: int = 10, where: Filter | dict | None = None, metric: str | None = None, min_score: float | None = None, include: Include = Include(), rows: DataFrame | None = None) -> DataFrame:
        """The exact search as a DataFrame: id, score, distance and what is included."""
        check_top_k(k)
        vector = check_vector(query, self.spec.dimension)
        rows = self.frame() if rows is None else rows
        return knn(rows, vector, k, metric or self.spec.metric, self._condition(where), min_score, include=include.columns(), inverse="inv_norm")

    def search(self, query: Any, k: int = 10, where: Filter | dict | None = None, metric: str | None = None, min_score: float | None = None, include: Include = Include(), max_scanned: int | None = None, tag: str | None = None, n_probe: int | None = None, min_candidates: int = 0, exact: bool | None = None) -> SearchResponse:
        """The k best documents. max_scanned refuses a search that would read more rows; tag names it for Database.cancel.

        An approximate search visits n_probe cells, by default as many as the index was calibrated to, and more until they hold
        min_candidates rows; it is followed by an exact one if it finds fewer than k. scanned counts the rows read, considered those that the filter lets pass.
        """
        check_top_k(k)
        vector = check_vector(query, self.spec.dimension)
        if metric is not None and metric not in METRICS:
            raise InvalidConfig(f"metric {metric!r}: one of {METRICS}")
        condition = self._condition(where)
        own = self.index() if self.spec.index == "ann" and not exact and metric in (None, self.spec.metric) else None
        index: VectorIndex = own or Flat()
        if tag:
            self.spark.addTag(tag)
        try:
            found, approximate, scanned, considered = [], False, 0, 0
            for cells in index.ways(vector, n_probe, min_candidates):
                rows = self._with_buffer(self._on_disk(cells=cells))
                if max_scanned is not None and scanned + (n := rows.count()) > max_scanned:
                    raise Cancelled(f"{scanned + n} rows; at most {max_scanned} may be scanned")
                read, passed = Observation(), Observation()
                rows = rows.observe(read, F.count(F.lit(1)).alias("n"))
                rows = (rows if condition is None else rows.where(condition)).observe(passed, F.count(F.lit(1)).alias("n"))
                found = self.search_frame(vector, k, None, metric, min_score, include, rows).collect()
                scanned, considered, approximate = scanned + read.get["n"], considered + passed.get["n"], cells is not None
                if len(found) == k:
                    break
        finally:
            if tag:
                self.spark.removeTag(tag)
        hits = [Hit(r["id"], r["score"], r["distance"], self._returned(r, include)) for r in found]
        return SearchResponse(hits, SearchStats(index.kind, not approximate, considered, scanned, scanned - considered))

    def search_batch(self, queries: DataFrame, k: int = 10, where: Filter | dict | None = None, metric: str | None = None, min_score: float | None = None) -> DataFrame:
        """query_id, id, score, distance, rank for each row (query_id, vector) of queries."""
        return knn_batch(self.frame(), queries, k, metric or self.spec.metric, self._condition(where), min_score)

    # The approximate index.

    def index(self) -> ann.Index | None:
        """The index named in the manifest; where there is none that can be read, a new one, unless the database is read-only."""
        return self._restored() or (None if self.database.config.read_only else self.build_index())

    def _restored(self) -> ann.Index | None:
        entry = self._state.get("index")
        if not entry:
            return None
        if self._index is None or self._index.number != entry["number"]:
            name = f"c_{self.name}/index-{entry['number']}.json"
            value = self.files.read_record(name) if self.files.exists(name) else None
            fits = value is not None and value["metric"] == self.spec.metric and value["shape"][1] in (0, self.spec.dimension)
            self._index = ann.Index.restored(value, entry["number"]) if fits else None
        return self._index

    def build_index(self, cells: int | None = None, target: float = ann.TARGET) -> ann.Index | None:
        """Fits an index to the present rows, stores them by its cells, and makes both the state in one commit.

        target is the share of true neighbours that the cells visited by default are to hold.
        """
        self.database._writable()
        if self.spec.index != "ann":
            raise InvalidConfig(f"{self.name}: its index is flat")
        self.flush()
        live = self._on_disk()
        fitted = ann.fit(live, self.spec.metric, cells)
        if not len(fitted.centroids):
            return None
        state, old = self._state, self._state.get("index")
        number, replaced, gone = self._take_number(), list(state["segments"]), list(state["dead"])
        probing = ann.calibrated(ann.assign(live, fitted), fitted, target=target)
        self._index = ann.Index(fitted.centroids, fitted.metric, probing.n_probe, number, probing.sizes)
        self.files.delete(f"c_{self.name}/index-{number}.json")  # left by a run that ended before its commit
        self.files.create_record(f"c_{self.name}/index-{number}.json", self._index.snapshot())
        n = self._write_segment(live, self._index)
        state["segments"] = state["segments"][len(replaced) :]
        state["index"], state["dead"] = {"number": number, "rows": n}, []
        self.database._commit()
        for name in [f"seg-{s['number']}" for s in replaced] + [f"dead-{d}" for d in gone] + ([f"index-{old['number']}.json"] if old else []):
            self.files.delete(f"c_{self.name}/{name}")
        return self._index

    # Writes.

    def _existing(self, ids: Iterable[Any]) -> set:
        """Which of these ids are alive."""
        ids = list(dict.fromkeys(ids))
        found = {i for i in ids if i in self._buffer and self._buffer[i][1] is not None}
        rest = [i for i in ids if i not in self._buffer]
        if rest and self._state["segments"]:
            rows = self._on_disk()
            if len(rest) <= 1000:
                rows = rows.where(F.col("id").isin(rest))
            else:
                rows = rows.join(self.spark.createDataFrame([(i,) for i in rest], T.StructType([T.StructField("id", _kind(self.spec))])), "id", "left_semi")
            found |= {r["id"] for r in rows.select("id").collect()}  # at most as many as were asked for
        return found

    def insert(self, doc: Document) -> None:
        self.database._writable()
        own = Document(doc.id, check_document(doc, self.spec), doc.metadata, doc.content)
        if self._existing([doc.id]):
            raise DuplicateId(f"{self.name}: {doc.id!r}")
        self._apply([(doc.id, own)])

    def upsert(self, doc: Document) -> str:
        """inserted or updated."""
        self.database._writable()
        own = Document(doc.id, check_document(doc, self.spec), doc.metadata, doc.content)
        was = self._existing([doc.id])
        self._apply([(doc.id, own)])
        return "updated" if was else "inserted"

    def delete(self, id_: Any) -> bool:
        """Whether it was there; the deletion is logged in any case."""
        self.database._writable()
        check_id(id_, self.spec)
        was = bool(self._existing([id_]))
        self._apply([(id_, None)])
        return was

    def write_batch(self, ops: Sequence[tuple[str, Any]]) -> BatchReport:
        """Applies ("upsert", Document) and ("delete", id) in order, all or none; counts refer to the state before."""
        self.database._writable()
        if len(ops) > MAX_BATCH:
            raise BatchTooLarge(f"{len(ops)} operations; at most {MAX_BATCH}")
        changes: list[tuple[Any, Document | None]] = []
        for i, (op, x) in enumerate(ops):
            try:
                if op == "upsert":
                    changes.append((x.id, Document(x.id, check_document(x, self.spec), x.metadata, x.content)))
                elif op == "delete":
                    check_id(x, self.spec)
                    changes.append((x, None))
                else:
                    raise ValidationError(f"operation {op!r}: upsert or delete")
            except EngineError as e:
                raise BatchAborted(i, len(ops), e) from e
        was = self._existing(i for i, _ in changes)
        report = BatchReport()
        for id_, doc in changes:
            if doc is None:
                report.deleted += id_ in was
                report.missing_deletes += id_ not in was
            else:
                report.updated += id_ in was
                report.inserted += id_ not in was
        if changes:
            self._apply(changes)
        return report

    def upsert_many(self, docs: Iterable[Document]) -> BatchReport:
        return self.write_batch([("upsert", d) for d in docs])

    def _apply(self, changes: Sequence[tuple[Any, Document | None]]) -> None:
        first = self._last_seq + 1
        numbered = [(first + i, id_, doc) for i, (id_, doc) in enumerate(changes)]
        self._log(numbered)
        for change in numbered:
            self._put(*change)
        if self._buffer_bytes >= self.database.config.flush_threshold:
            self.flush()

    def flush(self) -> None:
        """Turns the buffer into a segment and tombstones, in one commit."""
        self.database._writable()
        if not self._buffer:
            return
        was = self._existing_on_disk(list(self._buffer))
        dead = [(i, s) for i, (s, _) in self._buffer.items() if i in was]
        puts = self._buffered() if any(d is not None for _, d in self._buffer.values()) else None
        seq, state = self._last_seq, self._state
        if puts is not None:
            self._write_segment(puts)
        if dead:
            self._write_dead(self.spark.createDataFrame(dead, T.StructType([T.StructField("id", _kind(self.spec)), T.StructField("seq", T.LongType())])))
        state["seq"] = seq
        self.database._commit()
        self._buffer, self._buffer_bytes = {}, 0
        self.files.delete(f"c_{self.name}/log")

    def _existing_on_disk(self, ids: list[Any]) -> set:
        held, self._buffer = self._buffer, {}
        try:
            return self._existing(ids)
        finally:
            self._buffer = held

    def _take_number(self) -> int:
        self._state["next"] += 1
        return self._state["next"] - 1

    def _write_segment(self, rows: DataFrame, index: ann.Index | None = None) -> int:
        """A segment of these rows, stored by the cells of the index, if there is one."""
        number, index = self._take_number(), index or self._restored()
        name = f"c_{self.name}/seg-{number}"
        self.files.delete(name)  # left by a run that ended before its commit
        rows = rows.withColumn("segment", F.lit(number).cast("long")).select(*row_schema(self.spec).names)
        if index is None:
            rows.write.parquet(self.files.url(name))
        else:
            ann.stored(rows, index, self.files.url(name))
        n, digest = self._digest(number)
        if n:
            self._state["segments"].append({"number": number, "rows": n, "digest": digest} | ({"index": index.number} if index else {}))
        else:
            self.files.delete(name)
        return n

    def _digest(self, number: int, **options: str) -> tuple[int, str]:
        """How many rows a segment has, and a checksum of them, whatever their order."""
        rows = self.spark.read.schema(row_schema(self.spec)).options(**options).parquet(self.files.url(f"c_{self.name}/seg-{number}"))
        own = F.xxhash64("id", "vector", F.to_json("metadata"), "content", "seq")
        found = rows.agg(F.count("*").alias("n"), F.sum(own.cast("decimal(38,0)")).alias("sum")).first()
        return found["n"], str(found["sum"])

    def _write_dead(self, rows: DataFrame) -> None:
        number = self._take_number()
        name = f"c_{self.name}/dead-{number}"
        self.files.delete(name)
        rows.select("id", "seq").write.parquet(self.files.url(name))
        self._state["dead"].append(number)

    def upsert_frame(self, docs: DataFrame, order: str | None = None, source: tuple[str, int] | None = None) -> BatchReport:
        """Upserts rows (id, vector, metadata VARIANT or absent, content or absent) without passing the driver.

        Several rows of an id need a column ``order``, whose largest wins. source: (name, number) of a batch that is
        applied once only.
        """
        self.database._writable()
        if source and self._state["sources"].get(source[0], -1) >= source[1]:
            return BatchReport()
        names = docs.columns
        rows = docs.select(
            F.col("id").cast(_kind(self.spec)).alias("id"),
            F.col("vector").cast("array<float>").alias("vector"),
            (F.col("metadata") if "metadata" in names else F.parse_json(F.lit("{}"))).alias("metadata"),
            (F.col("content") if "content" in names else F.lit(None)).cast("binary").alias("content"),
            (F.col(order) if order else F.lit(0)).alias("order"),
        )
        if order:
            rows = rows.groupBy("id").agg(F.max_by(F.struct("vector", "metadata", "content"), "order").alias("r")).select("id", "r.*")
        checks = rows.agg(
            F.count(F.when(F.col("id").isNull(), 1)).alias("no_id"),
            F.count(F.when(F.col("vector").isNull() | (F.size("vector") != self.spec.dimension), 1)).alias("bad_size"),
            F.count(F.when(~valid_vector(F.col("vector"), self.spec.dimension), 1)).alias("bad"),
        ).first()
        if checks["no_id"]:
            raise ValidationError(f"{checks['no_id']} rows without an id")
        if checks["bad_size"]:
            raise InvalidVectorDimension(f"{checks['bad_size']} vectors without {self.spec.dimension} components")
        if checks["bad"]:
            raise InvalidVectorData(f"{checks['bad']} vectors with components that aren't finite")
        if not order and (twice := rows.groupBy("id").count().where("count > 1").take(1)):
            raise DuplicateId(f"{twice[0]['id']!r} occurs more than once; name a column that orders its rows")
        self.flush()
        seq = self._state["seq"] + 1
        before = self._on_disk().select("id")
        held = len(self._state["segments"])
        written = self._write_segment(rows.withColumn("inv_norm", inverse_norm(F.col("vector"))).withColumn("seq", F.lit(seq).cast("long")))
        updated = 0
        if written and held:
            new = self._segment_rows([self._state["segments"][-1]["number"]]).select("id")
            self._write_dead(before.join(new, "id", "left_semi").withColumn("seq", F.lit(seq).cast("long")))
            updated = self.spark.read.parquet(self.files.url(f"c_{self.name}/dead-{self._state['dead'][-1]}")).count()
        self._state["seq"] = seq
        if source:
            self._state["sources"][source[0]] = source[1]
        self.database._commit()
        return BatchReport(inserted=written - updated, updated=updated)

    # Maintenance.

    def _marked(self) -> DataFrame:
        return marked(self._segment_rows().select("id", "seq", "segment"), self._tombstones())

    def stats(self) -> dict[str, Any]:
        self.database._check_open()
        found = collection_stats(self._marked()).first()
        return {
            "live": self.count(),
            "total_rows": found["total_rows"] + sum(d is not None for _, d in self._buffer.values()),
            "segments": len(self._state["segments"]),
            "buffered": sum(d is not None for _, d in self._buffer.values()),
            "buffer_bytes": self._buffer_bytes,
            "dead_ratio": found["dead_ratio"],
            "indexed": sum(s["rows"] for s in self._state["segments"] if s.get("index") and s["index"] == (self._state.get("index") or {}).get("number")),
            "index_stats": (self._restored() or Flat()).stats(),
            **asdict(self.spec),
        }

    def compact(self, min_dead_ratio: float = 0.3) -> dict[str, int]:
        """Rewrites the segments with at least this share of dead rows into one; 0 rewrites all."""
        self.database._writable()
        self.flush()
        entry = self._state.get("index")
        if entry and sum(s["rows"] for s in self._state["segments"]) > REFIT * entry["rows"]:
            held = len(self._state["segments"])
            before = sum(s["rows"] for s in self._state["segments"])
            self.build_index()
            return {"rewritten": held, "created": 1, "reclaimed": before - sum(s["rows"] for s in self._state["segments"])}
        ratios = {r["segment"]: r for r in segment_stats(self._marked()).collect()}  # a row for each segment
        chosen = [n for n, r in ratios.items() if r["dead_ratio"] >= min_dead_ratio]
        if not chosen:
            return {"rewritten": 0, "created": 0, "reclaimed": 0}
        state = self._state
        old_dead, rest = list(state["dead"]), [s for s in state["segments"] if s["number"] not in chosen]
        made = self._write_segment(self._on_disk(chosen))
        if old_dead and not rest:
            state["dead"] = []
        elif old_dead:
            still = self._tombstones().join(self._segment_rows([s["number"] for s in rest]).select(F.col("id").alias("here"), F.col("seq").alias("from")), (F.col("id") == F.col("here")) & (F.col("seq") > F.col("from")), "left_semi")
            self._write_dead(still)
            state["dead"] = [state["dead"][-1]]
        state["segments"] = rest + ([state["segments"][-1]] if made else [])
        self.database._commit()
        for name in [f"seg-{n}" for n in chosen] + [f"dead-{n}" for n in old_dead]:
            self.files.delete(f"c_{self.name}/{name}")
        return {"rewritten": len(chosen), "created": int(made > 0), "reclaimed": sum(ratios[n]["rows"] - ratios[n]["live"] for n in chosen)}

    def verify_into(self, report: VerifyReport) -> None:
        state, there = self._state, set(self.files.names(f"c_{self.name}"))
        wanted = {f"seg-{s['number']}" for s in state["segments"]} | {f"dead-{n}" for n in state["dead"]}
        entry = state.get("index")
        own: dict[str, Any] = {"segments": len(state["segments"]), "index": entry and entry["number"]}
        if entry and (self._restored() is None or report.level != "quick" and self.files.read_record(f"c_{self.name}/index-{entry['number']}.json") is None):
            report.warnings.append(f"{self.name}: index {entry['number']} can't be read; it is fitted anew when it is needed")
        named = {f"index-{entry['number']}.json"} if entry else set()
        report.collections[self.name] = own
        report.segments_checked += len(state["segments"])
        report.errors += [f"{self.name}: {n} is missing" for n in sorted(wanted - there)]
        report.warnings += [f"{self.name}: orphan {n}" for n in sorted(there - wanted - named - {"log"})]
        if wanted - there:
            return
        try:
            rows = self._marked()
            for r in segment_stats(rows).collect():
                if r["dead_ratio"] > 0.5:
                    report.warnings.append(f"{self.name}: segment {r['segment']} has {r['dead_ratio']:.0%} dead rows")
                recorded = next(s["rows"] for s in state["segments"] if s["number"] == r["segment"])
                if recorded != r["rows"]:
                    report.errors.append(f"{self.name}: segment {r['segment']} has {r['rows']} rows instead of {recorded}")
            own["live"] = rows.where("live").count()
            if report.level == "quick":
                return
            # A read of every page, whose checksums Parquet compares.
            verifying = "parquet.page.verify-checksum.enabled"
            full = self.spark.read.schema(row_schema(self.spec)).option(verifying, "true")
            if state["segments"]:
                every = reduce(DataFrame.unionByName, (full.parquet(self.files.url(f"c_{self.name}/seg-{s['number']}")) for s in state["segments"]))
                tests = every.agg(
                    F.count(F.when(F.col("id").isNull(), 1)).alias("no_id"),
                    F.count(F.when(~valid_vector(F.col("vector"), self.spec.dimension), 1)).alias("vector"),
                    F.count(F.when(~F.coalesce(F.schema_of_variant("metadata").startswith("OBJECT"), F.lit(False)), 1)).alias("metadata"),
                    F.sum(F.coalesce(F.octet_length("content"), F.lit(0))).alias("bytes"),
                ).first()
                report.errors += [f"{self.name}: {tests[k]} rows with {what}" for k, what in (("no_id", "no id"), ("vector", "an unusable vector"), ("metadata", "unreadable metadata")) if tests[k]]
                for s in state["segments"]:
                    if s.get("digest") and self._digest(s["number"], **{verifying: "true"})[1] != s["digest"]:
                        report.errors.append(f"{self.name}: segment {s['number']} isn't what was written")
            if report.level == "full":
                report.errors += [f"{self.name}: {r['copies']} live rows of {r['id']!r}" for r in duplicate_ids(rows).limit(20).collect()]
        except Exception as e:  # a report, whatever the damage
            report.errors.append(f"{self.name}: {str(e).splitlines()[0][:300]}")
