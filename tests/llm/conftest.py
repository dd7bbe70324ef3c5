"""Tables for the operators' tests: driver data by path, and a small one with every awkward row."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from llm_data import SHAPE, awkward_rows, prose  # noqa: E402


@pytest.fixture(scope="session")
def awkward(spark, tmp_path_factory):
    """A folder of tables with nulls, empty and very long texts, repeated rows, and extra columns with clashing names."""
    top = str(tmp_path_factory.mktemp("awkward"))
    docs = spark.createDataFrame(awkward_rows(), SHAPE)
    extra = {c: F.lit("clash") for c in ("id", "row", "start", "kept", "hi", "q_n_words", "_text", "windows", "spans", "host", "host_rate", "hit_key", "gone_key", "_pii_id", "key", "bad_host", "sequence_id", "text_key")}
    docs.withColumns(extra).repartition(3).write.parquet(f"{top}/documents.parquet")
    bench = [(1, " ".join(prose(1, 300).split()[20:45])), (2, "one two"), (3, None), (4, ""), (5, " ".join(prose(1, 300).split()[30:41])), (5, "x" * 60_000), (None, "one")]
    spark.createDataFrame(bench, "item_id long, text string").withColumn("doc_id", F.lit("clash")).write.parquet(f"{top}/benchmark.parquet")
    pages = [(1, "http://A.example.com/en/x?y#z"), (2, "https://www.example.com/en/"), (3, None), (4, "no scheme"), (5, "ftp://x.net/es/a"), (6, "http://net/fr/"), (6, "http://net/fr/"), (None, "http://bad.org/p"), (7, "http://bad.org?q"), (8, "://"), (9, "http://notcom/"), (10, "http://h.io#f")]
    spark.createDataFrame(pages, "page_id long, url string").withColumn("host", F.lit("clash")).write.parquet(f"{top}/pages.parquet")
    labels = [(7, 0, None), (7, 1, 1), (1, 1, 0), (99, None, None), (None, 0, 1), (10, None, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("bad", F.lit("clash")).write.parquet(f"{top}/labels.parquet")
    return top


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("empty"))
    for name, shape in (("documents", SHAPE), ("benchmark", "item_id long, text string"), ("pages", "page_id long, url string, html string"), ("labels", "doc_id long, quality int, toxic int")):
        spark.createDataFrame([], shape).write.parquet(f"{top}/{name}.parquet")
    return top
