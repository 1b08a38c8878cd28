"""Helpers shared by the operators: tables, kept results, names that do not clash."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_PER_RANGE = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder of ``spark.checkpoint.dir`` and read from there.

    The files survive lost executors. They go when the plan that reads them does,
    where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        context.setCheckpointDir(folder)
    return df.checkpoint()


def share(spark: SparkSession, thing: object) -> Broadcast:
    """Broadcast of an object with its class as code; a task opens its value with ``pickle.loads``."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(thing))


def body(text: str | Column) -> Column:
    """The whole text, empty where it is NULL."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ranges(spark: SparkSession, rows: int, per_range: int = ROWS_PER_RANGE) -> int:
    """Partitions for a table of narrow rows: they grow with the rows."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // per_range))


def slices(batch: pa.RecordBatch, column: int, rows: int = 2000, size: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most ``rows`` rows and about ``size`` bytes of text, whole rows each."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        end = int(np.searchsorted(ends, before + size, side="right"))
        end = min(max(end, start + 1), start + rows, batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def give_back() -> None:
    """Return memory that is free in this process to the system.

    A Python worker goes from task to task and stage to stage, and the allocators keep
    what a finished piece of work has freed. Where the C library has no such call only
    Arrow's part is returned.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
