"""Batch and approximate searches: whole results, in bounded tiles, at sizes where one cell holds many rows."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from loomspark.queries import ORACLE, QUERIES


def vectors(n, dimension, seed=3):
    found = np.random.default_rng(seed).normal(size=(n, dimension))
    return (found / np.linalg.norm(found, axis=1, keepdims=True)).astype(np.float32)


@pytest.fixture(scope="module")
def crowded(tmp_path_factory):
    """20,000 vectors of 4 components: each of 141 cells holds more than 100 matches."""
    d = tmp_path_factory.mktemp("crowded")
    found = vectors(20_000, 4)
    pq.write_table(pa.table({"vec_id": pa.array(range(len(found))), "embedding": pa.array(list(found), pa.list_(pa.float32())), "label": pa.array(np.arange(len(found)) % 10, pa.int32())}), d / "embeddings.parquet")
    return d


def test_fallback_is_exact_where_one_cell_holds_enough(spark, crowded):
    db = duckdb.connect()
    db.execute(f"create view embeddings as select * from '{crowded}/embeddings.parquet'")
    db.execute("create view documents as select 0 as doc_id where false")
    found = QUERIES["ann_fallback"](spark, str(crowded))
    assert sorted(map(tuple, found.select("id", "score").collect())) == sorted(db.execute(ORACLE["ann_fallback"]).fetchall())


def brute(rows, ids, queries, names, k, metric, mask=None, skip_self=False):
    """(query, id, score to six places) of the k best, scored one pair at a time in doubles."""
    rows, queries, out = rows.astype(np.float64), queries.astype(np.float64), []
    for q, (name, query) in enumerate(zip(names, queries)):
        found = 0.0 - ((rows - query) ** 2).sum(1) if metric == "l2" else rows @ query
        found = np.round(found / (np.linalg.norm(rows, axis=1) * np.linalg.norm(query)) if metric == "cosine" else found, 6) + 0.0
        at = np.flatnonzero((ids != name if skip_self else ids == ids) & (True if mask is None else mask[q]))
        out += [(int(name), int(ids[i]), float(found[i])) for i in at[np.lexsort((ids[at], -found[at]))][:k]]
    return out


def handed_on(run, batches):
    return sorted(tuple(r.values()) for b in run(iter(batches)) for r in b.to_pylist())


@pytest.mark.parametrize("metric", ["cosine", "l2", "dot"])
def test_scores_are_held_in_tiles(monkeypatch, metric):
    """A batch of rows and many queries: their scores are never held all at once, and the results are those of all pairs."""
    from loomspark.operators import search

    rows, ids = vectors(3000, 8), np.arange(3000)
    rows[1000:1400] = rows[7]  # copies: ties go by id
    names, sizes, plain = ids[::5], [], search.scores

    def scores(*arguments):
        found = plain(*arguments)
        sizes.append(found.size)
        return found

    monkeypatch.setattr(search, "scores", scores)
    monkeypatch.setattr(search, "TILE", 20_000)
    batches = [pa.RecordBatch.from_arrays([pa.array(ids[i : i + 1500]), pa.array(list(rows[i : i + 1500]), pa.list_(pa.float32()))], ["id", "vector"]) for i in (0, 1500)]
    run = search._best_in_task(pa.array(names), rows[names].astype(np.float64), metric, 5, None, 6, True)
    assert handed_on(run, batches) == sorted(brute(rows, ids, rows[names], names, 5, metric, skip_self=True))
    assert max(sizes) <= 20_000 < len(names) * 1500


def test_wide_batches_and_blocks_of_queries(spark, monkeypatch):
    """Blocks of few queries, and rows in many partitions: the same as all pairs."""
    from loomspark.operators import search

    monkeypatch.setattr(search, "BLOCK_COMPONENTS", 8 * 30)
    monkeypatch.setattr(search, "TASKS", 2)
    monkeypatch.setattr(search, "TASKS_A_CORE", 0)
    rows, ids = vectors(600, 8), np.arange(600)
    corpus = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, rows)], "id long, vector array<float>").repartition(9)
    found = search.knn_batch(corpus, corpus.where("id % 6 = 0").selectExpr("id as query_id", "vector"), 4, digits=6)
    assert found.where("rank > 4").count() == 0
    assert sorted(map(tuple, found.select("query_id", "id", "score").collect())) == sorted(brute(rows, ids, rows[::6], ids[::6], 4, "cosine"))


@pytest.mark.parametrize("metric", ["cosine", "l2", "dot"])
def test_approximate_batch_is_exact_within_its_cells(spark, metric):
    """Each query meets all rows of the cells it visits and no others; one whose cells hold too few matches meets all rows."""
    from loomspark.operators import ann

    rows, ids = vectors(1500, 6), np.arange(1500)
    index = ann.Index(vectors(20, 6, seed=5).astype(np.float64), metric, 3)
    own, visited = index.cells(rows.astype(np.float64))[:, 0], index.cells(rows[::10].astype(np.float64), 3)
    few = int(visited[0, 0])
    kept = ~np.isin(own, visited[0]) | (ids % 250 == 0)  # the first query's cells keep few rows
    corpus = ann.assign(spark.createDataFrame([(int(i), v.tolist(), bool(x)) for i, v, x in zip(ids, rows, kept)], "id long, vector array<float>, kept boolean"), index)
    queries = corpus.where("id % 10 = 0").selectExpr("id as query_id", "vector")
    found = ann.ann_knn_batch(corpus, index, queries, 5, where="kept", digits=6)
    mask = np.array([np.isin(own, v) & kept for v in visited])
    short = mask.sum(1) < 5
    assert few in visited[short] and not short.all()
    mask[short] = kept
    assert sorted(map(tuple, found.select("query_id", "id", "score").collect())) == sorted(brute(rows, ids, rows[::10], ids[::10], 5, metric, mask))


def test_approximate_batch_joins_nothing(spark):
    """Queries aren't multiplied by the rows of their cells: tasks hand on at most k rows a query."""
    found = QUERIES["ann_topk"](spark, "/root/testdata/sf0.01")
    assert "Join" not in found._jdf.queryExecution().toString()
