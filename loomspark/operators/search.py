"""Filtered top-k similarity search as DataFrame plans: one query, many queries, thresholds.

A row is filtered before it is scored; a score is always higher-is-better; ties are ordered by id. One query is a scan
with a projection that ends in TakeOrderedAndProject, so each task sends k rows at most. Many queries are scored in
blocks against Arrow batches of the corpus, a tile of bounded size at a time; each task keeps k rows for each query, and a
window over those decides. The corpus is read once for each block and never shuffled; the tasks are as many as the cluster
has room for, whatever its size.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.functions.vectors import distance_from_score, inverse_norm, literal, matrix, scored, scores
from loomspark.functions.vectors import score as score_of
from loomspark.types import METRICS, InvalidConfig, InvalidVectorDimension, check_top_k, check_vector

#: From this dimension on, one query is scored by numpy in Arrow batches instead of by expressions.
WIDE = 256
#: Vector components of a block of queries that every task holds: 32 MB as doubles. Where scores and ids kept, or cells visited, are more, those count.
BLOCK_COMPONENTS = 4 << 20
#: Scores that a task holds at a time: 8 MB as doubles.
TILE = 1 << 20
#: Tasks that share the rows of a batch search, at most: each hands on up to k rows a query, so they mustn't grow with the corpus.
TASKS, TASKS_A_CORE = 64, 4


def _check_metric(metric: str) -> str:
    if metric not in METRICS:
        raise InvalidConfig(f"metric {metric!r}: one of {METRICS}")
    return metric


def with_score(corpus: DataFrame, query: Sequence[float], metric: str = "cosine", vector: str = "vector", inverse: str | None = None, digits: int | None = None) -> DataFrame:
    """corpus with a column score (+0.0 for an exact match under l2); digits rounds it."""
    _check_metric(metric)
    v = F.col(vector)
    if len(query) >= WIDE:
        s = scored(metric, v, query)
    elif metric == "cosine" and inverse:
        s = score_of(metric, v, literal(query), F.col(inverse))
    else:
        s = score_of(metric, v, literal(query))
    return corpus.withColumn("score", (F.round(s, digits) if digits is not None else s) + F.lit(0.0))


def knn(
    corpus: DataFrame,
    query: Sequence[float],
    k: int,
    metric: str = "cosine",
    where: Column | None = None,
    min_score: float | None = None,
    id: str = "id",
    vector: str = "vector",
    include: Sequence[str] = (),
    inverse: str | None = None,
    digits: int | None = None,
) -> DataFrame:
    """The k rows of the highest score: id, score, distance and the columns included.

    where filters before scoring, so k counts matches; min_score is inclusive and in score space.
    """
    check_top_k(k)
    query = check_vector(query, len(query))
    rows = corpus if where is None else corpus.where(where)
    found = with_score(rows, query, metric, vector, inverse, digits)
    if min_score is not None:
        found = found.where(F.col("score") >= min_score)
    return found.select(id, "score", distance_from_score(metric, F.col("score")).alias("distance"), *include).orderBy(F.col("score").desc(), F.col(id).asc()).limit(k)


@dataclass(frozen=True)
class _Lists:
    """Lists of numbers by number, one after another; none beyond the last."""

    values: np.ndarray
    ends: np.ndarray

    def __getitem__(self, i: int) -> np.ndarray:
        return self.values[self.ends[i - 1] if i else 0 : self.ends[i]] if i < len(self.ends) else self.values[:0]


def _blocks(n: int, width: int) -> Iterator[slice]:
    size = max(1, BLOCK_COMPONENTS // width)
    for i in range(0, n, size):
        yield slice(i, i + size)


def _best_in_task(names: pa.Array, queries: np.ndarray, metric: str, k: int, min_score: float | None = None, digits: int | None = None, skip_self: bool = False, visitors: _Lists | None = None):
    """Top k of each query among the rows of a task, by score, then id.

    visitors has, for each cell, the queries that visit it; then a third column names a row's cell, and a query is compared
    with the rows of its cells only. At most TILE scores are held at a time.
    """
    dimension = queries.shape[1]
    own = names.to_pylist() if skip_self else None
    slack = 0.0 if digits is None else 10.0**-digits  # what rounding may add

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(queries)
        least = np.full(len(queries), -np.inf if min_score is None else min_score)  # what a row must reach
        kind = None

        def compare(ids: np.ndarray, rows: np.ndarray, asked: np.ndarray) -> None:
            found = scores(metric, rows, queries[asked])
            near = found >= (least[asked] - slack)[:, None]
            for at in np.flatnonzero(near.any(axis=1)):
                q, place = asked[at], np.flatnonzero(near[at])
                score = (np.round(found[at][place], digits) if digits is not None else found[at][place]) + 0.0
                passed = score >= least[q] if own is None else (score >= least[q]) & (ids[place] != own[q])
                score, place = score[passed], place[passed]
                if len(score) > k:  # all ties of the last place stay for the sort
                    passed = score >= np.partition(score, len(score) - k)[len(score) - k]
                    score, place = score[passed], place[passed]
                if not len(score):
                    continue
                id = ids[place]
                if kept[q] is not None:
                    score, id = np.concatenate([kept[q][0], score]), np.concatenate([kept[q][1], id])
                first = np.lexsort((id, -score))[:k]
                kept[q] = score[first], id[first]
                if len(first) == k:
                    least[q] = max(least[q], kept[q][0][-1])

        def tiled(ids: np.ndarray, rows: np.ndarray, asked: np.ndarray) -> None:
            for i in range(0, len(rows), TILE):
                n = max(1, TILE // min(len(rows), TILE))
                for j in range(0, len(asked), n):
                    compare(ids[i : i + TILE], rows[i : i + TILE], asked[j : j + n])

        every = np.arange(len(queries))
        for batch in batches:
            kind = batch.column(0).type
            ids = np.array(batch.column(0).to_pylist(), object) if not pa.types.is_integer(kind) else batch.column(0).to_numpy(zero_copy_only=False)
            rows = matrix(batch.column(1), dimension)
            if visitors is None:
                tiled(ids, rows, every)
                continue
            cells = batch.column(2).to_numpy(zero_copy_only=False)
            order = np.argsort(cells, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(cells[order])) + 1):
                if len(at) and len(asked := visitors[cells[at[0]]]):
                    tiled(ids[at], rows[at], asked)
        some = [q for q in range(len(queries)) if kept[q] is not None]
        at_once = max(1, TILE // 8 // k)
        for i in range(0, len(some), at_once):
            part = some[i : i + at_once]
            number = np.repeat(part, [len(kept[q][0]) for q in part])
            ids = np.concatenate([kept[q][1] for q in part])
            yield pa.RecordBatch.from_arrays([names.take(pa.array(number)), pa.array(ids if ids.dtype != object else ids.tolist(), kind), pa.array(np.concatenate([kept[q][0] for q in part]))], ["query_id", "id", "score"])

    return run


def stated(queries: DataFrame, query_id: str, query_vector: str) -> tuple[pa.Array, np.ndarray]:
    """A stated set of queries, which fits the driver: ids in order, and a row of doubles for each."""
    found = queries.select(query_id, query_vector).orderBy(query_id).toArrow()
    dimensions = pc.unique(pc.list_value_length(found.column(1))).to_pylist()
    if len(dimensions) > 1 or None in dimensions:
        raise InvalidVectorDimension("the queries differ in dimension")
    return found.column(0).combine_chunks(), matrix(found.column(1), dimensions[0] if dimensions else 0)


def best(rows: DataFrame, names: pa.Array, queries: np.ndarray, metric: str, k: int, query_type: T.DataType, min_score: float | None = None, digits: int | None = None, skip_self: bool = False, visited: np.ndarray | None = None) -> DataFrame:
    """query_id, id, score, distance and rank of the k best of rows (id, vector) for each query; visited has each query's cells, of the rows' column cell."""
    spark = rows.sparkSession
    shape = T.StructType([T.StructField("query_id", query_type), T.StructField("id", rows.schema["id"].dataType), T.StructField("score", T.DoubleType())])
    dealt = rows.coalesce(max(TASKS, TASKS_A_CORE * spark.sparkContext.defaultParallelism))
    parts = []
    for block in _blocks(len(queries), max(queries.shape[1], 2 * k, 0 if visited is None else visited.shape[1])):
        visitors = None
        if visited is not None:
            cells = visited[block].ravel()
            order = np.argsort(cells, kind="stable")
            visitors = _Lists((order // visited.shape[1]).astype(np.int32), np.cumsum(np.bincount(cells)))
        parts.append(dealt.mapInArrow(_best_in_task(names[block], queries[block], metric, k, min_score, digits, skip_self, visitors), shape))
    every = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], shape)
    ranked = every.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id").asc())))
    return ranked.where(F.col("rank") <= k).select("query_id", "id", "score", distance_from_score(metric, F.col("score")).alias("distance"), F.col("rank").cast("long").alias("rank"))


def knn_batch(
    corpus: DataFrame,
    queries: DataFrame,
    k: int,
    metric: str = "cosine",
    where: Column | None = None,
    min_score: float | None = None,
    id: str = "id",
    vector: str = "vector",
    query_id: str = "query_id",
    query_vector: str = "vector",
    exclude_self: bool = False,
    digits: int | None = None,
) -> DataFrame:
    """query_id, id, score, distance, rank (from 1) of the k best rows for each query.

    queries is a stated set that fits the driver; it is dealt to the tasks in blocks of BLOCK_COMPONENTS components.
    """
    check_top_k(k)
    _check_metric(metric)
    names, own = stated(queries, query_id, query_vector)
    rows = (corpus if where is None else corpus.where(where)).select(F.col(id).alias("id"), F.col(vector).alias("vector"))
    return best(rows, names, own, metric, k, queries.schema[query_id].dataType, min_score, digits, exclude_self)


def within_score(corpus: DataFrame, query: Sequence[float], least: float, metric: str = "cosine", id: str = "id", vector: str = "vector", digits: int | None = None) -> DataFrame:
    """All rows of at least this score, in no order."""
    return with_score(corpus, query, metric, vector, digits=digits).where(F.col("score") >= least).select(id, "score")


def recall(found: DataFrame, exact: DataFrame, by: Sequence[str] = ("query_id", "id")) -> DataFrame:
    """One row: how many of the exact results were found, of how many, and their ratio."""
    hit = exact.select(*by).join(found.select(*by).distinct().withColumn("hit", F.lit(1)), list(by), "left")
    return hit.agg(F.count("hit").alias("found"), F.count("*").alias("wanted")).withColumn("recall", F.col("found") / F.col("wanted"))


def normalised(corpus: DataFrame, vector: str = "vector") -> DataFrame:
    """corpus with inv_norm, which is 0 for a zero vector; the vector itself stays."""
    return corpus.withColumn("inv_norm", inverse_norm(F.col(vector)))
