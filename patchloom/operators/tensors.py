"""Numpy kernels over image and vector columns, one Arrow stage, batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values of a stack that a kernel gets at once; bounds memory whatever the images' size.
STACK_VALUES = 1 << 22
#: Arrays that are summed over tasks: tasks that are added at first, values of a slice (64 KB).
FAN_IN, SLICE_VALUES = 256, 1 << 13


def list_column(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *[r.size for r in rows]])
    flat = np.concatenate([np.asarray(r, np.float64).ravel() for r in rows]) if rows else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a float64 matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _ddl(df: DataFrame, columns: tuple[str, ...]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def stacks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, last row, images) of runs of rows that have one shape."""
    shape = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in "hwc"], 1)
    at = 0
    while at < len(shape):
        most = max(1, STACK_VALUES // max(1, int(shape[at].prod())))
        end = at + 1
        while end < len(shape) and end - at < most and (shape[end] == shape[at]).all():
            end += 1
        yield at, end, matrix(batch.column("data").slice(at, end - at)).reshape(end - at, *shape[at])
        at = end


def map_images(df: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], *keep: str) -> DataFrame:
    """kernel: (n, h, w, c) -> (n, h', w', c') applied to all images; rows without data are left out. -> (*keep, h, w, c, data)"""

    def run(batches):
        for batch in batches:
            for lo, hi, x in stacks(batch):
                y = np.asarray(kernel(x), np.float64)
                y = y.reshape(len(y), *([1] * (4 - y.ndim)), *y.shape[1:])
                sizes = [pa.array(np.full(hi - lo, s, np.int32)) for s in y.shape[1:]]
                yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(lo, hi - lo) for k in keep], *sizes, list_column(list(y))], names=[*keep, "h", "w", "c", "data"])

    rows = df.select(*keep, "h", "w", "c", "data").where(F.col("data").isNotNull())
    return rows.mapInArrow(run, f"{_ddl(df, keep) + ', ' if keep else ''}h int, w int, c int, data array<double>")


def map_vectors(df: DataFrame, vector: str, kernel: Callable[[np.ndarray], np.ndarray], *keep: str, out: str | None = None) -> DataFrame:
    """kernel: (n, d) -> (n, e) applied to a vector column. -> (*keep, vector)"""
    out = out or vector

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], list_column(list(kernel(matrix(batch.column(vector)))))], names=[*keep, out])

    rows = df.select(*keep, vector).where(F.col(vector).isNotNull())
    return rows.mapInArrow(run, f"{_ddl(df, keep) + ', ' if keep else ''}`{out}` array<double>")


def sum_partials(df: DataFrame, partial: Callable[[Iterator[pa.RecordBatch]], np.ndarray | None], values: int | None = None, fan_in: int = FAN_IN, slice_values: int = SLICE_VALUES) -> np.ndarray | None:
    """The sum over all tasks of an array each task makes of its rows.

    Arrays travel in slices, and a slice is summed fan_in tasks at a time, then over these sums: no task holds more than fan_in
    slices, or the tasks' number / fan_in of them, and the driver gets one array, whatever the number of tasks. values: the array's
    size, if known; one of a slice at most is small enough for the driver to add the last sums itself, which saves a shuffle.
    """

    def run(batches):
        from pyspark import TaskContext

        got = partial(batches)
        if got is not None:
            got, team = np.asarray(got, np.float64).ravel(), TaskContext.get().partitionId() // fan_in
            for no, at in enumerate(range(0, max(len(got), 1), slice_values)):
                yield pa.RecordBatch.from_arrays([pa.array([no], pa.int32()), pa.array([team], pa.int32()), pa.array([got[at : at + slice_values].tobytes()], pa.binary())], names=["slice", "team", "sums"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py()) for x in table.column("sums"))
        return pa.table({"slice": table.column("slice")[:1], "team": table.column("team")[:1], "sums": pa.array([total.tobytes()], pa.binary())})

    kind = "slice int, team int, sums binary"
    teams = df.mapInArrow(run, kind).groupBy("slice", "team").applyInArrow(add, kind)
    if values is not None and values <= slice_values:
        rows = teams.collect()
        return sum(np.frombuffer(r["sums"]) for r in rows) if rows else None
    rows = teams.groupBy("slice").applyInArrow(add, kind).collect()
    return np.concatenate([np.frombuffer(r["sums"]) for r in sorted(rows, key=lambda r: r["slice"])]) if rows else None
