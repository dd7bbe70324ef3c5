"""Upserts, deletes and atomic batches as DataFrame transforms: the latest change of an id wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PUT, DELETE, COMMIT = "put", "delete", "commit"


def committed(log: DataFrame, txn: str = "txn_id", op: str = "op") -> DataFrame:
    """The puts and deletes that count: those outside a transaction, and those of a transaction with a commit record."""
    done = log.where(F.col(op) == COMMIT).select(F.col(txn).alias("done")).distinct()
    rows = log.where(F.col(op) != COMMIT)
    return rows.join(done, F.col(txn) == F.col("done"), "left").where(F.col(txn).isNull() | F.col("done").isNotNull()).drop("done")


def latest(log: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """The last change of each key. A grouped maximum with map-side combination: a hot key is one row of each task."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("last")).select(*(F.col(c) if c == key else F.col(f"last.{c}").alias(c) for c in log.columns))


def replay(log: DataFrame, key: str = "id", order: str = "seq", op: str = "op") -> DataFrame:
    """The rows alive after all changes."""
    return latest(log, key, order).where(F.col(op) == PUT)


def apply_changes(base: DataFrame, log: DataFrame, key: str = "id", order: str = "seq", op: str = "op") -> DataFrame:
    """base after the changes: replaced and deleted rows go, put rows come. Columns of base."""
    last = latest(log, key, order)
    stays = base.join(last.select(key), key, "left_anti").select(*base.columns)
    return stays.unionByName(last.where(F.col(op) == PUT).select(*base.columns))


def batch_report(base: DataFrame, ops: DataFrame, key: str = "id", op: str = "op") -> DataFrame:
    """One row: inserted, updated, deleted, missing_deletes; every operation is held against base as it was before."""
    known = base.select(F.col(key).alias("known")).distinct()
    found = ops.join(known, F.col(key) == F.col("known"), "left").select(op, F.col("known").isNotNull().alias("was"))
    count = lambda what, was: F.coalesce(F.sum(((F.col(op) == what) & (F.col("was") == was)).cast("long")), F.lit(0))
    return found.agg(count(PUT, False).alias("inserted"), count(PUT, True).alias("updated"), count(DELETE, True).alias("deleted"), count(DELETE, False).alias("missing_deletes"))
