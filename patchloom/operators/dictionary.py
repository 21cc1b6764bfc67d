"""Dictionary trainers: whitening, k-means, matching pursuit. One distributed aggregate for each step, small models on the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.functions import kernels as K
from patchloom.operators import stats
from patchloom.operators.linalg import checked_model
from patchloom.operators.sampling import reservoir
from patchloom.operators.tensors import _ddl, list_column, map_vectors, matrix, sum_partials

EPS = K.EPS


# --- whitening ----------------------------------------------------------------------------------------------------


def pca(df: DataFrame, vector: str, reg: float = EPS) -> tuple[np.ndarray, np.ndarray]:
    """(W, b): (x + b) W has uncorrelated dimensions of variance 1, in the order of ascending eigenvalues."""
    m, cov = stats.meancov(df, vector)
    values, vectors = np.linalg.eigh(cov)
    return vectors / (np.sqrt(np.maximum(values, 0)) + reg), -m


def zca(df: DataFrame, vector: str, reg: float = EPS) -> tuple[np.ndarray, np.ndarray]:
    """As pca, turned back to the original axes."""
    m, cov = stats.meancov(df, vector)
    values, vectors = np.linalg.eigh(cov)
    return vectors / (np.sqrt(np.maximum(values, 0)) + reg) @ vectors.T, -m


# --- assignments --------------------------------------------------------------------------------------------------


def nearest_atom(df: DataFrame, vector: str, atoms: np.ndarray, *keep: str) -> DataFrame:
    """(*keep, cluster, distance): the nearest atom by squared distance, the first of equal ones."""
    atoms = checked_model(atoms)

    def kernel(x: np.ndarray) -> np.ndarray:
        d = K.squared_distances(x, atoms)
        at = d.argmin(1)
        return np.stack([at, d[np.arange(len(d)), at]], 1)

    out = map_vectors(df, vector, kernel, *keep, out="_r")
    return out.select(*keep, F.col("_r")[0].cast("int").alias("cluster"), F.col("_r")[1].alias("distance"))


def strongest_atom(df: DataFrame, vector: str, atoms: np.ndarray, signed: bool = False, *keep: str) -> DataFrame:
    """(*keep, atom, value): the atom of the largest absolute response, the first of equal ones; value is absolute unless signed."""
    atoms = checked_model(atoms)

    def kernel(x: np.ndarray) -> np.ndarray:
        index, value = K.matching_pursuit(x, atoms, 1)
        return np.concatenate((index.astype(np.float64), value if signed else np.abs(value)), 1)

    out = map_vectors(df, vector, kernel, *keep, out="_r")
    return out.select(*keep, F.col("_r")[0].cast("int").alias("atom"), F.col("_r")[1].alias("value"))


def pursuit(df: DataFrame, vector: str, atoms: np.ndarray, steps: int, *keep: str) -> DataFrame:
    """(*keep, step, atom, value): greedy steps of signed matching pursuit."""
    import pyarrow as pa

    atoms = checked_model(atoms)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                index, value = K.matching_pursuit(matrix(batch.column(vector)), atoms, steps)
                yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], list_column(list(index)), list_column(list(value))], names=[*keep, "i", "v"])

    rows = df.select(*keep, vector).where(F.col(vector).isNotNull()).mapInArrow(run, f"{_ddl(df, keep) + ', ' if keep else ''}i array<double>, v array<double>")
    rows = rows.select(*keep, F.posexplode(F.arrays_zip("i", "v")).alias("step", "e"))
    return rows.select(*keep, "step", F.col("e.i").cast("int").alias("atom"), F.col("e.v").alias("value"))


# --- updates ------------------------------------------------------------------------------------------------------


def _restarts(df: DataFrame, vector: str, ids: str, n: int, seed: int) -> np.ndarray:
    """The n data rows that empty atoms restart from: the smallest draws, the same in every engine."""
    return np.array([r[vector] for r in reservoir(df.select(ids, vector).where(F.col(vector).isNotNull()), n, ids, seed=seed).collect()], np.float64)


def _labelled_sums(df: DataFrame, vector: str, atoms: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray, float]:
    """Per atom: sum of members (kmeans) or of |response| x member (omp, omp-signed); count; total of distances."""
    k, d = atoms.shape

    def partial(batches):
        total = np.zeros(k * d + k + 1)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(vector))
            for lo in range(0, len(x), 1000):
                part = x[lo : lo + 1000]
                if kind == "kmeans":
                    dist = K.squared_distances(part, atoms)
                    at, weight = dist.argmin(1), np.ones(len(part))
                    total[-1] += dist[np.arange(len(part)), at].sum()
                else:
                    index, value = K.matching_pursuit(part, atoms, 1)
                    at, weight = index[:, 0], value[:, 0] if kind == "omp-signed" else np.abs(value[:, 0])
                member = np.zeros((k, len(part)))
                member[at, np.arange(len(part))] = weight
                total[: k * d] += (member @ part).ravel()
                total[k * d : k * d + k] += np.bincount(at, minlength=k)
        return total

    got = sum_partials(df.select(vector).where(F.col(vector).isNotNull()), partial, k * d + k + 1)
    if got is None:
        raise ValueError("no rows")
    return got[: k * d].reshape(k, d), got[k * d : k * d + k], float(got[-1])


def _filled(df, vector, ids, new, counts, seed) -> np.ndarray:
    empty = np.flatnonzero(counts == 0)
    if len(empty):
        rows = _restarts(df, vector, ids, len(empty), seed)
        new[empty[: len(rows)]] = rows
    return new


def kmeans_step(df: DataFrame, vector: str, centers: np.ndarray, ids: str = "id", seed: int = 42) -> tuple[np.ndarray, float]:
    """(new centers, inertia of the old): one E and one M step in one pass. Empty clusters restart from a drawn row."""
    sums, counts, inertia = _labelled_sums(df, vector, checked_model(centers), "kmeans")
    return _filled(df, vector, ids, sums / np.maximum(counts, 1)[:, None], counts, seed), inertia


def omp1_step(df: DataFrame, vector: str, atoms: np.ndarray, ids: str = "id", signed: bool = False, seed: int = 42) -> np.ndarray:
    """Each atom becomes the weighted sum of its members, of length 1; an empty one restarts from a drawn row."""
    sums, counts, _ = _labelled_sums(df, vector, checked_model(atoms), "omp-signed" if signed else "omp")
    sums = _filled(df, vector, ids, sums, counts, seed)
    return sums / (np.sqrt((sums**2).sum(1, keepdims=True)) + EPS)


def ompn_step(df: DataFrame, vector: str, atoms: np.ndarray, steps: int, ids: str = "id", seed: int = 42) -> tuple[np.ndarray, float]:
    """(new atoms, squared residual of the old): least squares for the activations, (A'A + 1e-8) C = A'X, then length 1."""
    atoms = checked_model(atoms)
    k, d = atoms.shape

    def partial(batches):
        total = np.zeros(k * k + k * d + k + 1)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(vector))
            for lo in range(0, len(x), 1000):
                part = x[lo : lo + 1000]
                index, value = K.matching_pursuit(part, atoms, steps)
                act = np.zeros((len(part), k))
                for s in range(steps):  # an atom taken again keeps its last value
                    act[np.arange(len(part)), index[:, s]] = value[:, s]
                total[: k * k] += (act.T @ act).ravel()
                total[k * k : k * k + k * d] += (act.T @ part).ravel()
                total[k * k + k * d : -1] += (act != 0).sum(0)
                total[-1] += ((part - act @ atoms) ** 2).sum()
        return total

    got = sum_partials(df.select(vector).where(F.col(vector).isNotNull()), partial, k * k + k * d + k + 1)
    gram, cross, counts = got[: k * k].reshape(k, k), got[k * k : k * k + k * d].reshape(k, d), got[k * k + k * d : -1]
    new = _filled(df, vector, ids, np.linalg.solve(gram + 1e-8 * np.eye(k), cross), counts, seed)
    return new / (np.sqrt((new**2).sum(1, keepdims=True)) + EPS), float(got[-1])


# --- training loops -----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Trained:
    atoms: np.ndarray
    inertia: float
    rounds: int


def _variance(df: DataFrame, vector: str, average: bool) -> float:
    _, std = stats.meanstd(df, vector)
    return float((std**2).mean() if average else (std**2).sum())


def kmeans(df: DataFrame, vector: str, k: int, n_init: int = 1, max_iter: int = 300, tol: float = 1e-4, ids: str = "id", seed: int = 42, init: np.ndarray | None = None) -> Trained:
    """Lloyd's iterations from drawn rows (or init); stops when the squared move is below tol x the mean variance; the best of n_init
    by the inertia before the last update."""
    if k <= 0:
        raise ValueError("k must be positive")
    df = df.select(ids, vector).where(F.col(vector).isNotNull()).persist()
    try:
        limit = tol * _variance(df, vector, True)
        best = None
        for trial in range(1 if init is not None else n_init):
            centers = np.array(init, np.float64) if init is not None else _restarts(df, vector, ids, k, seed + trial)
            for rounds in range(1, max_iter + 1):  # noqa: B007
                new, inertia = kmeans_step(df, vector, centers, ids, seed + trial)
                moved = float(((new - centers) ** 2).sum())
                centers = new
                if moved < limit:
                    break
            if best is None or inertia < best.inertia:
                best = Trained(centers, inertia, rounds)
        return best
    finally:
        df.unpersist()


def normalized_kmeans(df: DataFrame, vector: str, k: int, **more) -> Trained:
    """k-means over rows of length 1."""
    rows = df.withColumn(vector, F.col(vector).cast("array<double>"))
    unit = map_vectors(rows, vector, lambda x: x / np.sqrt((x * x).sum(1, keepdims=True)), *[c for c in df.columns if c != vector])
    return kmeans(unit, vector, k, **more)


def _unit_gauss(k: int, d: int, seed: int) -> np.ndarray:
    c = np.random.default_rng(seed).standard_normal((k, d))
    return c / np.sqrt((c**2).sum(1, keepdims=True))


def _pursued(df, vector, k, max_iter, tol, ids, seed, init, step) -> Trained:
    df = df.select(ids, vector).where(F.col(vector).isNotNull()).persist()
    try:
        d = len(stats.mean(df, vector))
        limit = tol * _variance(df, vector, False)
        atoms, residual, rounds = np.array(init, np.float64) if init is not None else _unit_gauss(k, d, seed), float("nan"), 0
        for rounds in range(1, max_iter + 1):  # noqa: B007
            new, residual = step(df, atoms)
            moved = float(((new - atoms) ** 2).sum())
            atoms = new
            if moved < limit:
                break
        return Trained(atoms, residual, rounds)
    finally:
        df.unpersist()


def omp1(df: DataFrame, vector: str, k: int, max_iter: int = 100, tol: float = 1e-4, ids: str = "id", seed: int = 42, init: np.ndarray | None = None, signed: bool = False) -> Trained:
    """One active atom for each row; unit Gaussian start."""
    return _pursued(df, vector, k, max_iter, tol, ids, seed, init, lambda d, a: (omp1_step(d, vector, a, ids, signed, seed), float("nan")))


def ompn(df: DataFrame, vector: str, k: int, active: int, max_iter: int = 100, tol: float = 1e-4, ids: str = "id", seed: int = 42, init: np.ndarray | None = None) -> Trained:
    """`active` atoms for each row by greedy pursuit; inertia holds the squared residual before the last update."""
    return _pursued(df, vector, k, max_iter, tol, ids, seed, init, lambda d, a: ompn_step(d, vector, a, active, ids, seed))
