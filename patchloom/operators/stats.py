"""Means, deviations, covariances of columns and of vectors: partial per task, then merged."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.operators.tensors import matrix, sum_partials


def column_meanstd(df: DataFrame, *columns: str) -> DataFrame:
    """(name, mean, std) of scalar columns, population deviation; one pass with partial aggregates."""
    cells = [F.struct(F.lit(c).alias("name"), F.col(f"m_{c}").alias("mean"), F.col(f"s_{c}").alias("std")) for c in columns]
    one = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns])
    return one.select(F.inline(F.array(*cells)))


def _sums(vector: str, shift: np.ndarray | None, outer: bool):
    def partial(batches):
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(vector))
            x = x if shift is None else x - shift
            second = x.T @ x if outer else (x * x).sum(0)
            here = np.concatenate(([float(len(x))], x.sum(0), second.ravel()))
            total = here if total is None else total + here
        return total

    return partial


def mean(df: DataFrame, vector: str) -> np.ndarray:
    """The mean vector; an empty table fails."""
    got = sum_partials(df.select(vector).where(F.col(vector).isNotNull()), _sums(vector, None, False))
    if got is None:
        raise ValueError("no rows")
    d = (len(got) - 1) // 2
    return got[1 : d + 1] / got[0]


def meanstd(df: DataFrame, vector: str, reg: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation of each dimension, in two passes (the second around the mean); reg: sqrt(std^2 + reg)."""
    m = mean(df, vector)
    got = sum_partials(df.select(vector).where(F.col(vector).isNotNull()), _sums(vector, m, False))
    d = len(m)
    var = np.maximum(got[d + 1 :] / got[0] - (got[1 : d + 1] / got[0]) ** 2, 0)
    return m, np.sqrt(var if reg is None else var + reg)


def meancov(df: DataFrame, vector: str) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population covariance: each task sums centred outer products, so no long form is ever made."""
    m = mean(df, vector)
    got = sum_partials(df.select(vector).where(F.col(vector).isNotNull()), _sums(vector, m, True))
    d = len(m)
    off = got[1 : d + 1] / got[0]
    return m, got[d + 1 :].reshape(d, d) / got[0] - np.outer(off, off)
