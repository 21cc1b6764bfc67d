"""Products of vectors with a model matrix that fits the driver, and guarded step sizes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.operators.tensors import map_images, map_vectors
from patchloom.operators.views import _others

#: A model beyond this many values is no matrix to send to every task.
MODEL_VALUES = 1 << 26


def checked_model(a: np.ndarray) -> np.ndarray:
    a = np.asarray(a, np.float64)
    if a.size > MODEL_VALUES:
        raise ValueError(f"a model of {a.size} values is too large to be sent to every task")
    return a


def shape_checked(df: DataFrame, vector: str, size: int) -> DataFrame:
    """df; a row whose vector has another size fails the query."""
    return df.where(F.assert_true(F.size(vector) == size, f"{vector} must have {size} values").isNull())


def gemm(df: DataFrame, vector: str, b: np.ndarray, alpha: float = 1.0, single: bool = False, *keep: str) -> DataFrame:
    """alpha * x . b for each vector; single: in float32."""
    b = checked_model(b)
    kind = np.float32 if single else np.float64
    return map_vectors(df, vector, lambda x: alpha * (x.astype(kind) @ b.astype(kind)), *(keep or [c for c in df.columns if c != vector]))


def dot(df: DataFrame, vector: str, b: np.ndarray, *keep: str) -> DataFrame:
    return gemm(df, vector, b, 1.0, False, *keep)


def dot_image(images: DataFrame, b: np.ndarray) -> DataFrame:
    """Contract the channels of every location with b."""
    b = checked_model(b)
    return map_images(images, lambda x: x @ b, *_others(images))


def collected_matrix(df: DataFrame, order: str, vector: str, most_rows: int = 65536) -> np.ndarray:
    """The vectors of a bounded table as a matrix, in the order of a column; more rows than the bound fail."""
    rows = df.select(order, vector).orderBy(order).limit(most_rows + 1).collect()
    if len(rows) > most_rows:
        raise ValueError(f"more than {most_rows} rows for a model")
    return checked_model(np.array([r[vector] for r in rows], np.float64))


def wolfe_step(x: np.ndarray, function: Callable[[np.ndarray], tuple[float, np.ndarray]], alpha: float = 1.0, eta: float = 0.0, c1: float = 0.01, c2: float = 0.9, tau: float = 0.8, most: int = 100) -> float:
    """A step along the first direction of an adaptive-gradient method that meets Armijo's and the curvature condition.

    The step only shrinks; after `most` tries the last one is given, so the search always ends."""
    f0, g0 = function(x)
    g0 = np.array(g0)
    direction = -g0 / np.sqrt(g0 * g0 + eta * eta + np.finfo(np.float64).eps)
    slope = float(direction @ g0)
    for _ in range(most):
        f, g = function(x + alpha * direction)
        if f <= f0 + c1 * alpha * slope and float(direction @ g) >= c2 * slope:
            break
        alpha *= tau
    return alpha
