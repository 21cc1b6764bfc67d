"""Losses, regularisers and solvers of linear models over distributed rows.

Every evaluation is one pass: each task sums its losses and gradients, two summing steps follow, the driver adds the
regulariser. L-BFGS, adaptive gradients and line searches run on the driver, whose state is the model's size.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.functions.kernels import EPS
from patchloom.operators.linalg import checked_model, wolfe_step
from patchloom.operators.sampling import minibatches
from patchloom.operators.tensors import matrix, sum_partials
from patchloom.shared import scratch_path

#: Folders of an epoch's minibatches.
FOLDERS = 1000

# --- losses: (Y, prediction, row weights or None) -> (sum, gradient by prediction) ---------------------------------------


def loss_l2(y, p, w=None):
    d = p - y
    scale = 1.0 if w is None else w[:, None]
    return float((scale * d * d).sum()), 2 * scale * d


def loss_hinge(y, p, w=None):
    m = np.maximum(0, 1 - y * p)
    scale = 1.0 if w is None else w[:, None]
    return float((scale * m).sum()), -scale * y * (m > 0)


def loss_squared_hinge(y, p, w=None):
    m = np.maximum(0, 1 - y * p)
    scale = 1.0 if w is None else w[:, None]
    return float((scale * m * m).sum()), -2 * scale * y * m


def loss_bnll(y, p, w=None):
    e = np.exp(np.minimum(-y * p, 100))
    scale = 1.0 if w is None else w[:, None]
    return float((scale * np.log1p(e)).sum()), -scale * y * e / (1 + e)


def loss_logistic(y, p, w=None, weighted: bool = False):
    """Multiclass, y of 0 and 1. Row weights count only with `weighted`."""
    e = np.exp(p - p.max(1, keepdims=True))
    q = e / e.sum(1, keepdims=True)
    scale = w[:, None] if weighted and w is not None else 1.0
    return float(-(scale * y * np.log(np.maximum(q, EPS))).sum()), scale * (q - y)


LOSSES: dict[str, tuple[Callable, float]] = {"l2": (loss_l2, -1.0), "hinge": (loss_hinge, -1.0), "squared_hinge": (loss_squared_hinge, -1.0), "bnll": (loss_bnll, -1.0), "logistic": (loss_logistic, 0.0)}

# --- regularisers: weights -> (value, gradient) -----------------------------------------------------------------------


def reg_l2(w, alpha=0.5):
    return float((w * w).sum()), 2 * w


def reg_l1(w, alpha=0.5):
    return float(np.abs(w).sum()), np.where(w == 0, 0.5, np.sign(w))


def reg_elastic(w, alpha=0.5):
    """(1 - alpha) l2 + alpha l1."""
    (f1, g1), (f2, g2) = reg_l1(w), reg_l2(w)
    return alpha * f1 + (1 - alpha) * f2, alpha * g1 + (1 - alpha) * g2


REGULARISERS = {"l2": reg_l2, "l1": reg_l1, "elastic": reg_elastic}


# --- parameters -------------------------------------------------------------------------------------------------------


@dataclass
class Linear:
    """prediction = x W + b."""

    w: np.ndarray
    b: np.ndarray

    def flat(self) -> np.ndarray:
        return np.concatenate((self.w.ravel(), self.b))

    @staticmethod
    def of(flat: np.ndarray, d: int, k: int) -> Linear:
        return Linear(flat[: d * k].reshape(d, k).copy(), flat[d * k :].copy())

    @staticmethod
    def flattened(params) -> np.ndarray:
        """A flat vector as it is, or the parts of a pair one after the other."""
        if isinstance(params, Linear):
            return params.flat()
        if isinstance(params, np.ndarray):
            return params
        return np.concatenate([np.ravel(p) for p in params])


def _targets(column, k: int, fill: float) -> np.ndarray:
    import pyarrow as pa

    if pa.types.is_list(column.type):
        return matrix(column)
    y = np.full((len(column), k), fill)
    y[np.arange(len(column)), column.to_numpy(zero_copy_only=False).astype(np.int64)] = 1
    return y


def loss_sums(df: DataFrame, x: str, y: str, model: Linear, loss: str, weight: str | None = None) -> tuple[float, np.ndarray, np.ndarray, float]:
    """(loss, gradient by W, gradient by b, total weight) summed over all rows. y: a class number or an array of targets."""
    w, b = checked_model(model.w), model.b
    d, k = w.shape
    function, fill = LOSSES[loss]

    def partial(batches):
        total = np.zeros(d * k + k + 2)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = matrix(batch.column(x))
            weights = None if weight is None else batch.column(weight).to_numpy(zero_copy_only=False).astype(np.float64)
            f, g = function(_targets(batch.column(y), k, fill), rows @ w + b, weights)
            total[: d * k] += (rows.T @ g).ravel()
            total[d * k : -2] += g.sum(0)
            total[-2:] += f, len(rows) if weights is None else weights.sum()
        return total

    columns = [x, y] + ([weight] if weight else [])
    got = sum_partials(df.select(*columns).where(F.col(x).isNotNull() & F.col(y).isNotNull()), partial, d * k + k + 2)
    if got is None:
        raise ValueError("no rows")
    return float(got[-2]), got[: d * k].reshape(d, k), got[d * k : -2], float(got[-1])


def objective(df: DataFrame, x: str, y: str, model: Linear, loss: str, reg: str, gamma: float, weight: str | None = None, alpha: float = 0.5) -> tuple[float, np.ndarray]:
    """Mean loss + gamma * regulariser of W (b is free), and its gradient as one flat vector."""
    f, gw, gb, n = loss_sums(df, x, y, model, loss, weight)
    fr, gr = REGULARISERS[reg](model.w, alpha)
    return f / n + gamma * fr, np.concatenate(((gw / n + gamma * gr).ravel(), gb / n))


def lbfgs(function: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, most: int = 1000, memory: int = 10, tol: float = 1e-7) -> tuple[np.ndarray, float, int]:
    """(x, value, evaluations) by limited-memory quasi-Newton steps, with a bracketing search for a weak Wolfe step."""
    f, g = function(x)
    used, pairs = 1, []
    while used < most and np.abs(g).max() > tol:
        q, stack = g.copy(), []
        for s, y, rho in reversed(pairs):
            a = rho * (s @ q)
            stack.append(a)
            q -= a * y
        if pairs:
            s, y, _ = pairs[-1]
            q *= (s @ y) / (y @ y)
        for (s, y, rho), a in zip(pairs, reversed(stack), strict=True):
            q += (a - rho * (y @ q)) * s
        p = -q
        slope = g @ p
        if slope >= 0:
            p, slope, pairs = -g, -(g @ g), []
        lo, hi, step = 0.0, np.inf, 1.0 if pairs else min(1.0, 1 / max(np.abs(g).sum(), EPS))
        best = None
        while used < most:
            fn, gn = function(x + step * p)
            used += 1
            if fn > f + 1e-4 * step * slope:
                hi = step
            elif gn @ p < 0.9 * slope:
                lo, best = step, (step, fn, gn)
            else:
                best = (step, fn, gn)
                break
            step = (lo + hi) / 2 if np.isfinite(hi) else 2 * step
            if hi - lo < 1e-12:
                break
        if best is None:
            break
        step, fn, gn = best
        s, y = step * p, gn - g
        if s @ y > 1e-12:
            pairs = (pairs + [(s, y, 1 / (s @ y))])[-memory:]
        done = abs(f - fn) <= 1e-12 * max(abs(f), abs(fn), 1.0)
        x, f, g = x + s, fn, gn
        if done:
            break
    return x, f, used


def _width(df: DataFrame, x: str) -> int:
    return int(df.where(F.col(x).isNotNull()).select(F.size(x)).first()[0])


def classes(df: DataFrame, y: str) -> int:
    """Number of columns of y: its width, or the largest class number + 1."""
    if df.schema[y].dataType.typeName() == "array":
        return _width(df, y)
    return int(df.agg(F.max(y)).first()[0]) + 1


def fit(df: DataFrame, x: str, y: str, loss: str, reg: str = "l2", gamma: float = 0.01, weight: str | None = None, most: int = 1000, alpha: float = 0.5, init=None, k: int | None = None) -> tuple[Linear, float]:
    """(model, objective): L-BFGS over all rows; df is kept in memory while it runs."""
    df = df.select(*dict.fromkeys([x, y] + ([weight] if weight else []))).persist()
    try:
        d, k = _width(df, x), k or classes(df, y)
        start = np.zeros(d * k + k) if init is None else np.array(Linear.flattened(init), np.float64)
        best, value, _ = lbfgs(lambda p: objective(df, x, y, Linear.of(p, d, k), loss, reg, gamma, weight, alpha), start, most)
        return Linear.of(best, d, k), value
    finally:
        df.unpersist()


def fit_stochastic(df: DataFrame, x: str, y: str, ids: str, loss: str, reg: str = "l2", gamma: float = 0.01, mode: str = "lbfgs", minibatch: int = 1000, num_iter: int = 10, base_lr: float | None = None, eta: float = 0.0, weight: str | None = None, alpha: float = 0.5, most: int = 20, fine_tune: int = 0, callbacks=(), init=None, seed: int = 42, k: int | None = None) -> Linear:
    """Minibatches without replacement, a new shuffle each epoch; each is used for `most` evaluations of L-BFGS or one adaptive-gradient step.

    An epoch's shuffle is written to the shared folder in up to FOLDERS folders of consecutive batches, sorted by batch, so that a batch's
    evaluations read its folder and its row groups only. base_lr None: a Wolfe search on the first batch. fine_tune: that many evaluations of L-BFGS over all rows at the end.
    """
    df = df.persist()
    batch = None
    try:
        d, k = _width(df, x), k or classes(df, y)
        n = df.count()
        per_epoch = max(n // minibatch, 1)
        size = min(minibatch, n)
        param = np.zeros(d * k + k) if init is None else np.array(Linear.flattened(init), np.float64)
        grown = np.full(len(param), eta * eta + EPS)
        each = -(-per_epoch // FOLDERS)
        for it in range(num_iter):
            if it % per_epoch == 0:
                path = scratch_path(df.sparkSession, "minibatches")
                rows = minibatches(df, size, it // per_epoch, ids, seed=seed).withColumn("folder", F.floor(F.col("batch") / each))
                rows.repartition("folder").sortWithinPartitions("folder", "batch").write.partitionBy("folder").parquet(path)
                shuffled = df.sparkSession.read.parquet(path)
            if batch is not None:
                batch.unpersist()
            batch = shuffled.where((F.col("folder") == it % per_epoch // each) & (F.col("batch") == it % per_epoch)).persist()
            value = lambda p, b=batch: objective(b, x, y, Linear.of(p, d, k), loss, reg, gamma, weight, alpha)
            if mode == "lbfgs":
                param = lbfgs(value, param, most)[0]
            elif mode == "adagrad":
                if base_lr is None:
                    base_lr = wolfe_step(param, value, eta=eta)
                g = value(param)[1]
                grown += g * g
                param = param - base_lr * g / np.sqrt(grown)
            else:
                raise ValueError(f"unknown mode {mode}")
            for call in callbacks if isinstance(callbacks, (list, tuple)) else (callbacks,):
                call(Linear.of(param, d, k))
        model = Linear.of(param, d, k)
        return fit(df, x, y, loss, reg, gamma, weight, fine_tune, alpha, model, k)[0] if fine_tune else model
    finally:
        if batch is not None:
            batch.unpersist()
        df.unpersist()


def svm_onevsall(df, x, y, gamma, **more):
    return fit(df, x, y, "hinge", "l2", gamma, **more)


def l2svm_onevsall(df, x, y, gamma, **more):
    return fit(df, x, y, "squared_hinge", "l2", gamma, **more)


def elasticnet_svm_onevsall(df, x, y, gamma, alpha=0.5, **more):
    return fit(df, x, y, "squared_hinge", "elastic", gamma, alpha=alpha, **more)


def svm_binary(df, x, y, gamma, **more):
    """y of -1 and 1: one column."""
    return fit(df.withColumn(y, F.array(F.col(y).cast("double"))), x, y, "hinge", "l2", gamma, k=1, **more)


def scored(df: DataFrame, x: str, model: Linear, *keep: str) -> DataFrame:
    """(*keep, scores, predicted): x W + b and the first of the largest scores."""
    from patchloom.functions.arrays import argmax
    from patchloom.operators.tensors import map_vectors

    out = map_vectors(df, x, lambda rows: rows @ model.w + model.b, *keep, out="scores")
    return out.withColumn("predicted", argmax(F.col("scores")))


def standardized(df: DataFrame, x: str, mean: np.ndarray, std: np.ndarray, *keep: str) -> DataFrame:
    """(x - mean) / std; a deviation of 0 divides by 0 as it stands."""
    from patchloom.operators.tensors import map_vectors

    def kernel(rows: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return (rows - mean) / std

    return map_vectors(df, x, kernel, *keep)
