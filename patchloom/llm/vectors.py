"""Usable vectors, classes of vectors with one direction, and their int8 planes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.shared import discard, materialize, mix64, spread

#: Rows that are worked on at once.
ROWS = 2048
#: A unit vector u is step * (256 * hi + lo) with int8 planes hi and lo, up to a rounding error of e16 (e8 without lo).
MOST = 127 * 256 + 127


def usable_rows(ids: pa.Array, lists: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and float64 rows of vectors with dim finite elements that are not all equal."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    full = lists.is_valid().to_numpy(zero_copy_only=False) & (lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == dim) & ids.is_valid().to_numpy(zero_copy_only=False)
    kept = lists.filter(pa.array(full))
    x = kept.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)  # nulls become NaN
    fine = np.isfinite(x).all(1) & (x != x[:, :1]).any(1)
    return ids.filter(pa.array(full)).to_numpy(zero_copy_only=False)[fine], x[fine]


def _sliced(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Each row minus its own mean, of length 1. A row whose deviations vanish in double precision stays 0."""
    x = x / np.maximum(np.abs(x).max(1, keepdims=True), 1e-300)
    x = x - x.mean(1, keepdims=True)
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def planes(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hi, lo, step, e8, e16) of unit rows."""
    step = np.maximum(np.abs(u).max(1), 1e-300) / MOST
    q = np.rint(u / step[:, None]).astype(np.int32)
    hi = (q + 128) >> 8  # so that lo is within -128 .. 127
    norm = lambda r: np.sqrt((r * r).sum(1))
    return hi.astype(np.int8), (q - 256 * hi).astype(np.int8), step, norm(u - hi * (256 * step[:, None])), norm(u - q * step[:, None])


def compact(x: np.ndarray) -> pa.Array:
    """Rows as bytes, without loss: a byte for each value where all are whole 255ths from 0 to 1, two where all are whole thousandths, else eight."""
    out = np.empty(len(x), object)
    open_ = np.ones(len(x), bool)
    for unit, kind in ((255, np.uint8), (1000, np.int16)):
        at = np.flatnonzero(open_)
        q, most = np.rint(x[at] * unit), np.iinfo(kind)
        fits = ((q / unit == x[at]) & (q >= most.min) & (q <= most.max)).all(1)
        for i, row in zip(at[fits], q[fits].astype(kind), strict=True):
            out[i] = row.tobytes()
        open_[at[fits]] = False
    for i in np.flatnonzero(open_):
        out[i] = x[i].tobytes()
    return pa.array(out, pa.binary())


def expanded(rows: pa.Array, dim: int) -> np.ndarray:
    """The rows that compact() made bytes of."""
    rows, lengths = rows.to_pylist(), pc.binary_length(rows).to_numpy(zero_copy_only=False)
    out = np.empty((len(rows), dim))
    for size, kind, unit in ((1, np.uint8, 255), (2, np.int16, 1000), (8, np.float64, 1)):
        at = np.flatnonzero(lengths == size * dim)
        out[at] = np.frombuffer(b"".join(rows[i] for i in at), kind).reshape(-1, dim) / unit
    return out


def direction_print(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of a direction, to 10 decimals: copies of a vector on another scale agree."""
    q = np.rint(u * 1e10).astype(np.int64).view(np.uint64)
    at = mix64(np.arange(1, u.shape[1] + 1, dtype=np.uint64))
    return tuple(mix64(mix64(q + at * np.uint64(k)).sum(1, dtype=np.uint64)).view(np.int64) for k in (1, 3))


def directions(vectors: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """vectors: (vec_id, vec) -> (members, classes), both written to the shared folder.

    members: (vec_id, class_id), each id once; classes: (class_id, vec), one usable vector for each direction; class_id
    is the smallest id with it. If deliveries of an id differ, the one with the least print holds.
    """

    def scan(batches):
        for batch in _sliced(batches):
            ids, x = usable_rows(batch.column("vec_id"), batch.column("vec"), dim)
            fp1, fp2 = direction_print(unit_rows(x))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(fp1), pa.array(fp2), compact(x)], names=["vec_id", "fp1", "fp2", "code"])

    def listed(batches):
        for batch in _sliced(batches):
            vec = pa.FixedSizeListArray.from_arrays(expanded(batch.column("code"), dim).ravel(), dim).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("class_id"), vec], names=["class_id", "vec"])

    rows = materialize(spread(vectors.select("vec_id", "vec").where(F.size("vec") == dim)).mapInArrow(scan, "vec_id long, fp1 long, fp2 long, code binary"), "vec-rows")
    ids = rows.groupBy("vec_id").agg(F.min(F.struct("fp1", "fp2")).alias("fp")).select("vec_id", "fp.*")
    first = ids.groupBy("fp1", "fp2").agg(F.min("vec_id").alias("class_id"))
    members = materialize(ids.join(first, ["fp1", "fp2"]).select("vec_id", "class_id"), "vec-members")
    named = first.select(F.col("class_id").alias("vec_id"), F.col("fp1").alias("of1"), F.col("fp2").alias("of2"))
    # joined by the id alone, so that dropping repeated rows needs no further shuffle
    classes = rows.join(named, "vec_id").where("fp1 = of1 and fp2 = of2").dropDuplicates(["vec_id"]).select(F.col("vec_id").alias("class_id"), "code")
    classes = materialize(classes.mapInArrow(listed, "class_id long, vec array<double>"), "vec-classes")
    discard(rows)
    return members, classes


def similarity(pairs: DataFrame, classes: DataFrame, a: str, b: str, unit: bool = True) -> DataFrame:
    """pairs of class ids -> (a, b, sim): the cosine after subtracting each vector's mean, in double precision, to 9 decimals.

    Without unit: the product of the vectors as they are.
    """
    ready = unit_rows if unit else np.asarray

    def coded(batches):
        for batch in _sliced(batches):
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("class_id"), compact(batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)), batch.column("vec").value_lengths()], names=["class_id", "code", "dim"])

    def exact(batches):
        for batch in _sliced(batches):
            if batch.num_rows:
                dim = batch.column("dim")[0].as_py()
                u = [ready(expanded(batch.column(c), dim)) for c in ("code_a", "code_b")]
                yield pa.RecordBatch.from_arrays([batch.column(a), batch.column(b), pa.array(np.round((u[0] * u[1]).sum(1), 9))], names=[a, b, "sim"])

    codes = classes.select("class_id", "vec").mapInArrow(coded, "class_id long, code binary, dim int")
    side = lambda c, v: codes.select(F.col("class_id").alias(c), F.col("code").alias(v), "dim")
    both = pairs.join(side(a, "code_a").drop("dim"), a).join(side(b, "code_b"), b)
    return both.select(a, b, "code_a", "code_b", "dim").mapInArrow(exact, f"{a} long, {b} long, sim double")
