"""Token-ID output: ORC files of token ids in document order, and their reader (operator 10).

Documents are range-partitioned and sorted by id, encoded with a byte-level BPE file, closed with an end id, and written
as ORC: stripes with integer run-length encoding, row indexes and Bloom filters on the document id. File number, then
row, is document order; each row carries the number of ids before it in its file, so a reader needs only one total per
file to know every global position. Stripes are read in parallel and pruned by id from metadata alone.

Edge cases: a null or empty text is the end id alone; a very long text is one row; equal ids (repeated rows) are ordered by
text, and rows repeated in whole stay in one file; a null id comes
first; an empty table gives no rows; other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.llm._store import fresh_path, written
from loomspark.llm._tokens import default_tokenizer, encoded

END_ID = 2
#: Rows of one id that one task may write.
SHARED = 10_000
FILE_SCHEMA = "file int, doc_id long, before long, ids array<int>"


def _encode(tokenizer: str, end_id: int):
    def run(batches):
        from pyspark import TaskContext

        file, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows, ids, off in encoded(batch.column(1), tokenizer):
                lens = np.diff(off) + 1
                bounds = np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)
                flat = np.full(int(bounds[-1]), end_id, np.int32)
                keep = np.ones(len(flat), bool)
                keep[bounds[1:] - 1] = False
                flat[keep] = ids
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(lens), file, np.int32)), batch.column(0)[rows], pa.array(before + bounds[:-1].astype(np.int64)), pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat))], ["file", "doc_id", "before", "ids"])
                before += len(flat)

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Writes the ids of (doc_id, text) to path."""
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Where many rows share an id, they are split by how their texts begin.
    shared = ordered.groupBy("doc_id").count().where(F.col("count") > SHARED).take(1)
    ordered = ordered.repartitionByRange("doc_id", *([F.substring("text", 1, 64)] if shared else [])).sortWithinPartitions("doc_id", "text")
    (
        ordered.mapInArrow(_encode(tokenizer or default_tokenizer(), end_id), FILE_SCHEMA)
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", "1000")
        .option("compression", "zstd")
        .orc(path)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the files: file, doc_id, before (ids before it in its file), ids."""
    return spark.read.schema(FILE_SCHEMA).orc(path)


def _measure(batches):
    for batch in batches:
        lists = batch.column(3)
        off = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1] if len(lists) else np.zeros(1, np.int32)
        flat = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
        crcs = np.fromiter((zlib.crc32(flat[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)), np.int64, len(lists))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(off).astype(np.int64)), pa.array(crcs)], ["file", "doc_id", "before", "n_tokens", "ids_crc32"])


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of each row, read from the files."""
    rows = written(read_token_files(spark, path).mapInArrow(_measure, "file int, doc_id long, before long, n_tokens long, ids_crc32 long"), "token-index")
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    # One row for each file.
    earlier = totals.select("file", F.coalesce(F.sum("total").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    return rows.join(earlier, "file").select("doc_id", (F.col("before") + F.col("earlier")).alias("start"), "n_tokens", "ids_crc32")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-files")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return token_index(spark, path)
