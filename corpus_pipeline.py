"""A corpus pipeline over documents: each stage takes the rows that the one before kept.

The stages reject documents that fail the quality rules, keep one document of each near-duplicate group, reject documents
that hold a passage of the benchmark, generalise personal data, and pack what is left into token sequences. The text
measures of a stage are those of its input, so a later stage judges what an earlier one has changed.

Edge cases: rows without a text fail the quality rules; of rows repeated in whole one stays; null ids and sources are kept
like any other value; a very long text goes through every stage in whole and is cut into pieces by the last; of equal
documents the one of least id stays; extra columns are carried to the last stage, whatever their names; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomspark.llm._store import written
from loomspark.llm.decontamination import decontaminate
from loomspark.llm.neardup import near_dedup
from loomspark.llm.packing import pack_documents
from loomspark.llm.pii import sanitise
from loomspark.llm.quality import quality_filter


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_filter(docs)


def minhash_neardup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_sanitisation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sanitise(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_neardup", minhash_neardup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii_sanitisation", pii_sanitisation),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


#: Near-duplicate detection by random trees and token ids can't be written in SQL.
ORACLE_SQL = None
