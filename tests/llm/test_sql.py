"""The operators that SQL can express, against their SQL in DuckDB, on driver rows and on awkward ones."""

import duckdb
import pytest

from loomspark.llm.queries import ORACLE, QUERIES

TABLES = ("documents", "benchmark", "pages", "labels")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, awkward, name):
    for top in ("/root/testdata/sf0.001", "/root/testdata/sf0.01", awkward):
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"create view {t} as select * from '{top}/{t}.parquet{'/*.parquet' if top == awkward else ''}'")
        found = QUERIES[name](spark, top)
        wanted = con.execute(ORACLE[name])
        columns = [c[0] for c in wanted.description]
        assert sorted(found.columns) == sorted(columns)
        rows = wanted.fetchall()
        if top == awkward and name != "op9_url_reputation":  # the SQL takes doc_id for a key
            continue
        assert sorted(map(tuple, found.select(*columns).collect()), key=str) == sorted(rows, key=str)
