"""Similarity functions over array columns. A score is always higher-is-better.

Arithmetic is in double precision. Expressions stay in the JVM; ``scored`` sends Arrow batches to numpy, which is faster
for wide vectors.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from loomspark.types import METRICS, InvalidConfig


def literal(vector: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(_double(a), _double(b), lambda x, y: x * y))


def squared_l2(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y)))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def inverse_norm(v: Column) -> Column:
    """1 / norm, and 0 for a zero vector."""
    n = norm(v)
    return F.when((n > 0) & (n < math.inf), 1 / n).otherwise(0.0)


def score(metric: str, v: Column, q: Column, v_inverse: Column | None = None) -> Column:
    """cosine (0 for zero vectors), negated squared distance, or inner product."""
    if metric == "cosine":
        return dot(v, q) * inverse_norm(q) * (inverse_norm(v) if v_inverse is None else v_inverse)
    if metric == "l2":
        return F.lit(0.0) - squared_l2(v, q)
    if metric == "dot":
        return dot(v, q)
    raise InvalidConfig(f"metric {metric!r}: one of {METRICS}")


def distance_from_score(metric: str, s: Column) -> Column:
    """The metric's own distance; none for the inner product."""
    if metric == "cosine":
        return 1 - s
    if metric == "l2":
        return F.sqrt(F.greatest(F.lit(0.0) - s, F.lit(0.0)))
    return F.lit(None).cast("double")


def valid_vector(v: Column, dimension: int) -> Column:
    """Finite in every component, and of the dimension."""
    return F.coalesce((F.size(v) == dimension) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)), F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray, dimension: int) -> np.ndarray:
    """A list column as rows of doubles; rows of another length or with nulls are NaN."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, dimension))
    off = column.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    lens = np.diff(off)
    if not column.null_count and (lens == dimension).all():
        return flat[off[0] : off[-1]].reshape(len(column), dimension)
    out = np.full((len(column), dimension), np.nan)
    for i in np.flatnonzero(lens == dimension):
        out[i] = flat[off[i] : off[i + 1]]
    if column.null_count:
        out[column.is_null().to_numpy(zero_copy_only=False)] = np.nan
    return out


def scores(metric: str, rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Scores of rows (n, d) by queries (m, d), as (m, n)."""
    if metric == "l2":
        return 0.0 - np.maximum((queries**2).sum(1)[:, None] - 2 * (queries @ rows.T) + (rows**2).sum(1)[None, :], 0.0)
    found = queries @ rows.T
    if metric == "cosine":
        with np.errstate(divide="ignore", invalid="ignore"):
            inverse = [np.where((n := np.sqrt((x**2).sum(1))) > 0, 1 / n, np.where(np.isnan(n), np.nan, 0.0)) for x in (queries, rows)]
        found = found * inverse[0][:, None] * inverse[1][None, :]
    return found


def scored(metric: str, v: Column, query: Sequence[float]) -> Column:
    """As score, against one query vector, by Arrow batches."""
    q = np.asarray(query, np.float64)

    @arrow_udf("double")
    def run(column: pa.Array) -> pa.Array:
        rows = matrix(column, len(q))
        if metric == "l2":
            found = 0.0 - ((rows - q) ** 2).sum(1)
        else:
            found = scores(metric, rows, q[None, :])[0]
        return pa.array(found, mask=np.isnan(found))

    return run(v)
