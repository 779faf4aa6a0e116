"""Vectors of an embedding table as numbers that all operators on vectors agree on."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Larger entries count as this bound: 1024 times it, and sums over any table, stay within a long.
LARGEST = float(1 << 30)


def usable(column: pa.Array) -> np.ndarray:
    """For each row, whether its vector is there and all of its entries are there and finite."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out = np.asarray(column.is_valid())
    flat = pc.list_flatten(column)
    bad = ~np.isfinite(flat.fill_null(math.nan).to_numpy(zero_copy_only=False).astype(np.float64))
    if bad.any():
        out = out.copy()
        out[pc.list_parent_indices(column).to_numpy()[bad]] = False
    return out


def lengths(column: pa.Array) -> np.ndarray:
    return pc.list_value_length(column).fill_null(-1).to_numpy(zero_copy_only=False)


def matrix(column: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the usable vectors of ``dimension`` entries in ``column``, and these vectors as doubles."""
    at = np.flatnonzero(usable(column) & (lengths(column) == dimension))
    flat = pc.list_flatten(column.take(pa.array(at))).to_numpy(zero_copy_only=False).astype(np.float64)
    return at, np.clip(flat.reshape(len(at), dimension), -LARGEST, LARGEST)


def dimension_of(vectors: DataFrame, column: str) -> int | None:
    """The number of entries that most usable vectors have, of several such the largest; None without usable vectors."""

    def sizes(batches):
        for batch in batches:
            found, n = np.unique(lengths(batch.column(0))[usable(batch.column(0))], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(n, pa.int64())], names=["lw_dimension", "lw_rows"])

    rows = vectors.select(as_doubles(column)).mapInArrow(sizes, "lw_dimension long, lw_rows long")
    best = rows.where("lw_dimension > 0").groupBy("lw_dimension").agg(F.sum("lw_rows").alias("lw_rows")).orderBy(F.desc("lw_rows"), F.desc("lw_dimension")).first()
    return best and best["lw_dimension"]


def as_doubles(column: str, name: str = "lw_vector") -> Column:
    return F.col(column).cast("array<double>").alias(name)
