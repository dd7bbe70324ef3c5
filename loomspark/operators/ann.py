"""An approximate index: an inverted file of cells around centroids, with exact re-scoring and an exact fallback.

Centroids come from Lloyd's iterations on a sample of at most ``SAMPLE_PER_CELL`` rows for each of at most ``MAX_CELLS`` cells,
chosen by a hash of the id; every row is then assigned to its nearest centroid. Rows are stored by cell, as folders of a
Parquet table, so that a search reads the ``n_probe`` cells nearest to the query and nothing else, and scores their rows
exactly. If it finds fewer than k, it scans everything, so no search returns fewer rows than an exact one. Centroids can
be written down and read back; rows that come later are assigned to them without a new fit.
"""

from __future__ import annotations

import base64
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions.vectors import matrix, scores
from loomspark.operators.search import TILE, best, knn, knn_batch, stated
from loomspark.types import check_top_k

#: Bounds of the centroids (as doubles of 384 dimensions: 6 MB) and of the rows that they are fitted to.
MAX_CELLS, SAMPLE_PER_CELL = 2048, 64
ITERATIONS = 12
#: Rows that the number of visited cells is fitted to, and the share of their neighbours that it must reach.
CALIBRATION_QUERIES, TARGET = 64, 0.97


@dataclass(frozen=True)
class Index:
    """Centroids (cells, d) under a metric, how many cells a search visits, the number of its snapshot, and the rows in each cell."""

    centroids: np.ndarray
    metric: str
    n_probe: int = 8
    number: int = 0
    sizes: tuple[int, ...] = ()
    kind = "ann"
    is_exact = False

    def cells(self, rows: np.ndarray, n: int = 1) -> np.ndarray:
        """The n nearest cells of each row, nearest first; under cosine and dot, rows are compared by direction."""
        out, at_once = [], max(1, TILE // max(1, len(self.centroids)))
        for i in range(0, len(rows), at_once):
            found = scores("l2" if self.metric == "l2" else "cosine", self.centroids, rows[i : i + at_once])
            found = np.nan_to_num(found, nan=-np.inf)
            if n == 1:
                out.append(found.argmax(axis=1)[:, None].astype(np.int32))
                continue
            some = np.argpartition(-found, min(n, found.shape[1]) - 1, axis=1)[:, :n]
            order = np.argsort(-np.take_along_axis(found, some, 1), axis=1, kind="stable")
            out.append(np.take_along_axis(some, order, 1).astype(np.int32))
        return np.concatenate(out) if out else np.zeros((0, n), np.int32)

    def probed(self, query: Sequence[float], n_probe: int | None = None, min_candidates: int = 0) -> list[int]:
        """The cells that a search visits: n_probe of them, and as many more as held min_candidates rows when they were counted."""
        every = self.cells(np.asarray([query], np.float64), len(self.centroids))[0]
        n = n_probe or self.n_probe
        if min_candidates and self.sizes:
            n = max(n, int(np.searchsorted(np.cumsum(np.array(self.sizes)[every]), min_candidates)) + 1)
        return [int(c) for c in every[:n]]

    def ways(self, query: Sequence[float], n_probe: int | None = None, min_candidates: int = 0) -> list[list[int] | None]:
        """The cells that a search visits, where those aren't all, and then everything."""
        cells = self.probed(query, n_probe, min_candidates)
        return [cells, None] if len(cells) < len(self.centroids) else [None]

    def stats(self) -> dict[str, Any]:
        return {"kind": self.kind, "number": self.number, "cells": len(self.centroids), "n_probe": self.n_probe, "largest_cell": max(self.sizes, default=0)}

    def snapshot(self) -> dict[str, Any]:
        """The index as a JSON value."""
        data = base64.b64encode(np.ascontiguousarray(self.centroids, "<f8").tobytes()).decode()
        return {"metric": self.metric, "shape": list(self.centroids.shape), "n_probe": self.n_probe, "sizes": list(self.sizes), "centroids": data}

    @staticmethod
    def restored(value: dict[str, Any], number: int = 0) -> Index:
        data = np.frombuffer(base64.b64decode(value["centroids"]), "<f8").reshape(value["shape"])
        return Index(data, value["metric"], value["n_probe"], number, tuple(value["sizes"]))


def _share(id: str, salt: str) -> Column:
    """A number from 0 to 1 for each row, by a hash of its id."""
    return F.pmod(F.xxhash64(F.col(id), F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)


def fit(corpus: DataFrame, metric: str = "cosine", cells: int | None = None, id: str = "id", vector: str = "vector", seed: int = 7) -> Index:
    """Centroids of a sample; cells defaults to about the square root of the number of rows."""
    total = corpus.count()
    n = min(cells or max(1, round(total**0.5)), MAX_CELLS)
    wanted = SAMPLE_PER_CELL * n
    sampled = corpus.where(_share(id, f"fit {seed}") < min(1.0, 1.2 * wanted / max(total, 1))).select(id, vector).limit(2 * wanted).toArrow()
    if not len(sampled):
        return Index(np.zeros((0, 0)), metric)
    sampled = sampled.sort_by(id)
    sample = matrix(sampled.column(1), len(sampled.column(1)[0]))
    sample = sample[np.isfinite(sample).all(axis=1)]
    if metric != "l2":
        norm = np.sqrt((sample**2).sum(1, keepdims=True))
        sample = np.divide(sample, norm, out=np.zeros_like(sample), where=norm > 0)
    n = min(n, len(sample))
    at_once = max(1, TILE // n)  # rows compared with the centroids
    centroids = sample[np.random.default_rng(seed).choice(len(sample), n, replace=False)]
    for _ in range(ITERATIONS):
        sums, size = np.zeros_like(centroids), np.zeros(n, np.int64)
        for i in range(0, len(sample), at_once):
            part = sample[i : i + at_once]
            nearest = scores("l2", part, centroids).argmax(0)
            order = np.argsort(nearest, kind="stable")
            own, first = np.unique(nearest[order], return_index=True)
            sums[own] += np.add.reduceat(part[order], first, axis=0)
            size += np.bincount(nearest, minlength=n)
        centroids = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centroids)
    return Index(centroids, metric)


def assign(corpus: DataFrame, index: Index, vector: str = "vector") -> DataFrame:
    """corpus with a column cell. Centroids are held by every task: at most MAX_CELLS."""
    dimension, metric = index.centroids.shape[1] if len(index.centroids) else 0, index.metric

    @F.arrow_udf("int")
    def nearest(column: pa.Array) -> pa.Array:
        return pa.array(Index(index.centroids, metric).cells(matrix(column, dimension))[:, 0])

    return corpus.withColumn("cell", nearest(F.col(vector)) if dimension else F.lit(0))


def stored(corpus: DataFrame, index: Index, path: str, vector: str = "vector") -> DataFrame:
    """corpus written to path by cell, as it is read back; large cells are split among tasks."""
    assign(corpus, index, vector).hint("rebalance", "cell").write.partitionBy("cell").parquet(path)
    kept = [f for f in corpus.schema.fields if f.name != "cell"]
    return corpus.sparkSession.read.schema(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", cell int").parquet(path)


def calibrated(assigned: DataFrame, index: Index, k: int = 10, target: float = TARGET, queries: int = CALIBRATION_QUERIES, id: str = "id", vector: str = "vector") -> Index:
    """The index with as many visited cells as hold ``target`` of the true neighbours of a sample of rows.

    The sample is bounded by ``queries``; its neighbours are searched exactly among all rows.
    """
    held = dict(assigned.groupBy("cell").count().collect())  # a row for each cell
    sizes, total = tuple(held.get(c, 0) for c in range(len(index.centroids))), sum(held.values())
    sample = assigned.where(_share(id, "calibration") < min(1.0, 2.0 * queries / max(total, 1))).orderBy(F.xxhash64(F.col(id))).limit(queries)
    rows = {r["query_id"]: r["query"] for r in sample.select(F.col(id).alias("query_id"), F.col(vector).alias("query")).collect()}
    if not rows or len(index.centroids) < 2:
        return Index(index.centroids, index.metric, max(1, len(index.centroids)), index.number, sizes)
    sampled = assigned.sparkSession.createDataFrame(list(rows.items()), f"query_id {assigned.schema[id].dataType.simpleString()}, query array<double>")
    near = knn_batch(assigned, sampled, k, index.metric, id=id, vector=vector, query_vector="query").select("query_id", "id")
    found = assigned.select(F.col(id).alias("id"), "cell").join(F.broadcast(near), "id").select("query_id", "cell").collect()  # queries * k rows
    place = {q: np.argsort(index.cells(np.asarray([v], np.float64), len(index.centroids))[0]) for q, v in rows.items()}
    places = np.sort([place[r["query_id"]][r["cell"]] for r in found])
    return Index(index.centroids, index.metric, int(places[min(len(places) - 1, int(np.ceil(target * len(places))))]) + 1, index.number, sizes)


def ann_knn(assigned: DataFrame, index: Index, query: Sequence[float], k: int, n_probe: int | None = None, where: Column | None = None, min_score: float | None = None, id: str = "id", vector: str = "vector", include: Sequence[str] = (), digits: int | None = None, exact: bool = False) -> DataFrame:
    """As knn, from the n_probe nearest cells; from all where those hold fewer than k matches. At most k rows are collected.

    exact lets only rows stand that no other cell can better: those cells are searched too, for what reaches the k-th score.
    """
    check_top_k(k)
    n_probe = n_probe or index.n_probe
    if n_probe < len(index.centroids):
        near = F.col("cell").isin(index.probed(query, n_probe))
        found = knn(assigned.where(near), query, k, index.metric, where, min_score, id, vector, include, digits=digits)
        rows = found.collect()
        if len(rows) == k:
            first = assigned.sparkSession.createDataFrame(rows, found.schema)
            if not exact:
                return first
            rest = knn(assigned.where(~near), query, k, index.metric, where, rows[-1]["score"], id, vector, include, digits=digits)
            return first.unionByName(rest).orderBy(F.col("score").desc(), F.col(id).asc()).limit(k)
    return knn(assigned, query, k, index.metric, where, min_score, id, vector, include, digits=digits)


def _valid_by_cell(assigned: DataFrame, vector: str, dimension: int) -> dict[int, int]:
    """How many rows of each cell can be scored: a row for each cell is collected, of at most MAX_CELLS."""

    def count(batches):
        for batch in batches:
            cells = batch.column(0).to_numpy(zero_copy_only=False)[np.isfinite(matrix(batch.column(1), dimension)).all(axis=1)]
            own, n = np.unique(cells, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(n.astype(np.int64))], ["cell", "n"])

    return dict(assigned.select(F.col("cell").cast("int"), vector).mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n")).collect())


def ann_knn_batch(assigned: DataFrame, index: Index, queries: DataFrame, k: int, n_probe: int | None = None, where: Column | None = None, id: str = "id", vector: str = "vector", query_id: str = "query_id", query_vector: str = "vector", digits: int | None = None) -> DataFrame:
    """As knn_batch, each query against the rows of its n_probe cells; one whose cells hold fewer than k matches is searched exactly.

    A task meets the rows where they are stored, each cell with its visitors, and hands on k rows a query at most.
    """
    check_top_k(k)
    n_probe = n_probe or index.n_probe
    if where is not None:
        assigned = assigned.where(where)
    names, own = stated(queries, query_id, query_vector)
    rows = assigned.select(F.col(id).alias("id"), F.col(vector).alias("vector"), "cell")
    search = lambda at, rows, visited: best(rows, names.filter(pa.array(at)), own[at], index.metric, k, queries.schema[query_id].dataType, digits=digits, visited=visited)
    if not len(own) or n_probe >= len(index.centroids):
        return search(np.ones(len(own), bool), rows.drop("cell"), None)
    visited = index.cells(own, n_probe)
    valid = _valid_by_cell(rows, "vector", own.shape[1])
    enough = np.array([valid.get(c, 0) for c in range(len(index.centroids))], np.int32)[visited].sum(1) >= k
    if enough.all():
        return search(enough, rows, visited)
    return search(enough, rows, visited[enough]).unionByName(search(~enough, rows.drop("cell"), None))
