"""Shared helpers of the training-data operators."""

from __future__ import annotations

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright.plans.storage import discard  # noqa: F401  the operators take it from here
from listwright.plans.storage import written as materialize  # noqa: F401

#: Words are runs of anything but ASCII white space; ``bytes.split()`` cuts at the same characters.
WORD = r"[^\x20\x09-\x0D]+"


def small_batches(spark: SparkSession, rows: int = 1000, megabytes: int = 64) -> None:
    """Arrow batches of whole texts: fewer rows and bytes a batch, so that long documents fit a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{megabytes}m")


def own_columns(df: DataFrame) -> list[Column]:
    """All columns, whatever their names."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


class Shared:
    """A value broadcast in pickled form; each task unpickles it at first use."""

    def __init__(self, spark: SparkSession, value):
        self._bytes = spark.sparkContext.broadcast(cloudpickle.dumps(value))
        self._value = None

    def __getstate__(self):
        return {"_bytes": self._bytes, "_value": None}

    @property
    def value(self):
        if self._value is None:
            self._value = cloudpickle.loads(self._bytes.value)
        return self._value


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bucket_of(key: Column, buckets: Column) -> Column:
    """Cut the order of a uniform 64-bit ``key`` into that many equal ranges: a larger key never gets a smaller bucket."""
    return F.floor((F.shiftright(key, 40) + F.lit(1 << 23)) * buckets / F.lit(1 << 24)).cast("long")


def texts(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null becomes empty."""
    return [b"" if t is None else t for t in column.cast("binary").to_pylist()]


def whole_groups(batches, least: int = 1):
    """Tables of ``least`` rows or more from batches sorted by their first column, cut between its values only."""
    held, rows = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        cut = int(keys.searchsorted(keys[-1]))
        if held and rows + cut >= least and (cut or held[-1].column(0)[-1].as_py() != keys[0]):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held, rows = [batch.slice(cut)], batch.num_rows - cut
        else:
            held.append(batch)
            rows += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)
