"""Every query of the engine against its SQL in DuckDB."""

import duckdb
import pytest

from loomspark.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("customer", "lineitem", "events", "documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, db, name):
    found = QUERIES[name](spark, SF)
    wanted = db.execute(ORACLE[name])
    columns = [c[0] for c in wanted.description]
    assert sorted(found.columns) == sorted(columns)
    assert sorted(map(tuple, found.select(*columns).collect()), key=str) == sorted(wanted.fetchall(), key=str)


def test_approximate_index_reaches_its_recall(spark):
    for sf in (SF, "/root/testdata/sf0.01"):
        assert QUERIES["ann_recall"](spark, sf).first().recall >= 0.9


def test_ann_never_returns_fewer_than_k(spark):
    assert QUERIES["ann_topk"](spark, SF).groupBy("query_id").count().where("count <> 10").count() == 0
    assert QUERIES["ann_fallback"](spark, "/root/testdata/sf0.01").count() == 100


def test_top_k_plan(spark):
    plan = QUERIES["knn_filter_eq"](spark, SF)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "EqualTo(lang,en)" in plan
