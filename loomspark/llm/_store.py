"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.sources.files import shared_folder


def _file(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def free_name(name: str, *taken: str) -> str:
    """name, with underscores added until no column has it (whatever its case)."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def delete(spark: SparkSession, path: str) -> None:
    """Removes a table of the shared folder that nothing reads any more."""
    target, files = _file(spark, path)
    files.delete(target, True)


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df as a Parquet table in the shared folder, read back: its lineage ends there, and a lost executor costs a reread.

    The table is deleted when the application ends, if not before (see ``Tables``).
    """
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    target, files = _file(spark, path)
    files.deleteOnExit(target)
    found = spark.read.schema(df.schema).parquet(path)
    found.stored_at = path
    return found


#: A table of up to so many rows of a few numbers each (some 20 MB) may be sent to every executor.
BROADCAST_ROWS = 250_000


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of a few numbers a row, to be broadcast if it is counted to be small, and shuffled otherwise."""
    return F.broadcast(df) if df.count() <= rows else df


class Tables:
    """The intermediate tables of one run of an operator, to be deleted once nothing reads them."""

    def __init__(self):
        self.open: list[tuple[SparkSession, str]] = []

    def written(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        found = written(df, name, compression)
        self.open.append((found.sparkSession, found.stored_at))
        return found

    def grown(self, table: DataFrame, more: DataFrame) -> DataFrame:
        """A table of this run with more rows, in the same place: its plan stays one scan. What was read from it before stays as it was."""
        more.select(*table.columns).write.mode("append").parquet(table.stored_at)
        found = table.sparkSession.read.schema(table.schema).parquet(table.stored_at)
        found.stored_at = table.stored_at
        return found

    def drop(self, *frames: DataFrame) -> None:
        """Deletes these tables."""
        for frame in frames:
            self.open.remove((frame.sparkSession, frame.stored_at))
            delete(frame.sparkSession, frame.stored_at)

    def close(self, *keep: DataFrame) -> None:
        """Deletes all tables but those kept, which the result reads."""
        kept = {f.stored_at for f in keep}
        for spark, path in self.open:
            if path not in kept:
                delete(spark, path)
        self.open = []
