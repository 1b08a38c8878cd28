"""Small dense vectors kept as array columns, one per document or term."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Functions of this module travel to the executors as code, so that the package
# need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PARTIAL_BYTES = 8 * 1024 * 1024
SOLVED_AT_ONCE = 16_384


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def vector_sum(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda acc, v: acc + v)


def solve_rows(
    goal: np.ndarray, gram: np.ndarray, l1: float, l2: float, sweeps: int | None, tol: float
) -> np.ndarray:
    """One small non-negative least-squares problem per row.

    For a target ``t`` the row is the ``w >= 0`` that minimises
    ``w'Gw/2 - t'w + l1*sum(w) + l2*w'w/2`` by cyclic coordinate descent from zero.
    A row stops when its own largest move is at most ``tol`` of its largest entry (or
    of 1e-12), after ``sweeps`` at most where that is given. Each row is computed
    apart, so batches and partitions do not change it.
    """
    width = gram.shape[0]
    scale = np.diag(gram) + l2
    off = gram - np.diag(np.diag(gram))
    solved = np.zeros_like(goal)
    for start in range(0, len(goal), SOLVED_AT_ONCE):
        rows = np.arange(start, min(start + SOLVED_AT_ONCE, len(goal)))
        w = np.zeros((width, len(rows)))
        rest = np.ascontiguousarray((goal[rows] - l1).T)  # what the other entries leave of the target
        done = 0
        while len(rows) and (sweeps is None or done < sweeps):
            done += 1
            moved = np.zeros(len(rows))
            for j in range(width):
                if scale[j] <= 0.0:
                    continue
                new = np.maximum(0.0, rest[j] / scale[j])
                step = new - w[j]
                at = np.flatnonzero(step)
                w[j] = new
                # entry by entry: a matrix product would round by the size of the batch
                if 2 * len(at) > len(rows):
                    rest -= off[:, j, None] * step
                    moved = np.maximum(moved, np.abs(step))
                elif len(at):  # most entries are zero and stay so
                    rest[:, at] -= off[:, j, None] * step[at]
                    moved[at] = np.maximum(moved[at], np.abs(step[at]))
            on = moved > tol * np.maximum(w.max(axis=0, initial=0.0), 1e-12)
            if not on.all():
                solved[rows[~on]] = w[:, ~on].T
                rows, w, rest = rows[on], np.ascontiguousarray(w[:, on]), np.ascontiguousarray(rest[:, on])
        solved[rows] = w.T
    return solved


def nonnegative_solver(gram: np.ndarray, l1: float, l2: float, sweeps: int | None, tol: float):
    """``solve_rows`` as a column function of the targets."""
    width = gram.shape[0]

    @F.arrow_udf("array<double>")
    def solve(target: pa.Array) -> pa.Array:
        w = solve_rows(_matrix(target, width), gram, l1, l2, sweeps, tol)
        offsets = np.arange(0, len(w) * width + 1, width, dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(w.ravel()))

    return solve


def violation(gram: np.ndarray, l1: float, l2: float):
    """Column function of a solution and its target: how far it is from optimal, relative to the largest target.

    At the optimum the slope is zero where the entry is positive and not negative where
    it is zero; the result is the largest breach of that.
    """
    width = gram.shape[0]

    @F.arrow_udf("double")
    def worst(solution: pa.Array, target: pa.Array) -> pa.Array:
        w, goal = _matrix(solution, width), _matrix(target, width)
        slope = w @ gram - goal + l1 + l2 * w
        breach = np.where(w > 0.0, np.abs(slope), np.maximum(0.0, -slope)).max(axis=1, initial=0.0)
        return pa.array(breach / np.maximum(np.abs(goal).max(axis=1, initial=0.0), 1e-12))

    return worst


def _partial_moments(df: DataFrame, left: str, right: str, rows: int, columns: int) -> DataFrame:
    """One row per task: the sum of the outer products of its rows, flattened."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            part = _matrix(batch.column(0), rows).T @ _matrix(batch.column(1), columns)
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()])], names=["m"])

    return df.select(F.col(left).alias("l"), F.col(right).alias("r")).mapInArrow(partial, "m array<double>")


def cross_moments(df: DataFrame, left: str, right: str, rows: int, columns: int) -> DataFrame:
    """Sum over all rows of the outer product of two vectors, as (i, j, value).

    Each task adds up its own rows first, so only ``rows * columns`` numbers per
    task are shuffled, and the result has exactly that many rows.
    """
    sums = (
        _partial_moments(df, left, right, rows, columns)
        .select(F.posexplode("m").alias("p", "value"))
        .groupBy("p")
        .agg(F.sum("value").alias("value"))
    )
    return sums.select(
        F.floor(F.col("p") / columns).cast("int").alias("i"), (F.col("p") % columns).alias("j"), "value"
    )


def moment_matrix(df: DataFrame, left: str, right: str, rows: int, columns: int, tasks: int) -> np.ndarray:
    """``cross_moments`` as a small matrix on the driver: topics by topics, never data-sized.

    ``tasks`` bounds the tasks of ``df``. While their partial sums fit in
    ``PARTIAL_BYTES`` they are added here, otherwise by a shuffle.
    """
    if tasks * rows * columns * 8 <= PARTIAL_BYTES:
        parts = _partial_moments(df, left, right, rows, columns).collect()
        return sum((np.array(part.m) for part in parts), np.zeros(rows * columns)).reshape(rows, columns)
    out = np.zeros((rows, columns))
    for i, j, value in cross_moments(df, left, right, rows, columns).collect():
        out[i, j] = value
    return out
