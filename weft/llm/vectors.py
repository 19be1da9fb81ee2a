"""Vector columns as matrices, and runs of sorted rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """(id, v) of the vectors that take part, and their number.

    Null, empty and zero vectors, those with null or non-finite components and those of null id take no
    part.  Vectors of any length do, but only those of one length are compared.
    """
    v, x = F.col(vec_col), F.col(id_col).cast("long")
    fine = F.forall("v", lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf"))) & F.exists("v", lambda y: y != 0)
    good = df.select(x.alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(F.coalesce(fine, F.lit(False)))
    return good, good.count()


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The rows of a column of equally long vectors."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def by_length(batch: pa.RecordBatch | pa.Table, column: str = "v") -> Iterator[pa.RecordBatch | pa.Table]:
    """The rows of each length of the column."""
    sizes = np.asarray(pa.compute.list_value_length(batch[column]))
    for d in np.unique(sizes):
        yield batch if (sizes == d).all() else batch.filter(pa.array(sizes == d))


def sorted_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each key, from batches sorted by it."""
    held: list[pa.Table] = []
    for b in batches:
        t = pa.table(b)
        k = np.asarray(t[key])
        cut = np.flatnonzero(k[1:] != k[:-1]) + 1
        for lo, hi in zip(np.r_[0, cut], np.r_[cut, len(k)], strict=True):
            part = t.slice(lo, hi - lo)
            if held and held[-1][key][0] != part[key][0]:
                yield pa.concat_tables(held)
                held = []
            held.append(part)
    if held:
        yield pa.concat_tables(held)


def lists(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """The rows of a matrix as a list column."""
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values.reshape(-1), kind))
