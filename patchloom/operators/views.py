"""Views of an image set: flips, crops, sub-windows, resizing, jitter. Images: (id, ..., h, w, c, data)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchloom.functions import kernels as K
from patchloom.functions.images import gather, window
from patchloom.operators.tensors import _ddl, list_column, map_images, stacks

def _columns() -> tuple[Column, Column, Column, Column]:
    return F.col("h"), F.col("w"), F.col("c"), F.col("data")


def _others(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ("h", "w", "c", "data")]


def _flip() -> Column:
    h, w, c, data = _columns()
    return gather(data, h * w * c, lambda i: (F.floor(i / (w * c)) * w + (w - 1 - F.floor(i / c) % w)) * c + i % c)


def mirror_set(images: DataFrame) -> DataFrame:
    """The originals and, with is_flipped, their left-right flips: one scan, one row in and two out, no union of two scans."""
    both = images.withColumn("is_flipped", F.explode(F.array(F.lit(False), F.lit(True))))
    return both.withColumn("data", F.when(F.col("is_flipped"), _flip()).otherwise(F.col("data")))


def sub_image_set(images: DataFrame, size: tuple[int, int], stride: int) -> DataFrame:
    """Every window of the size, row by row: (..., part, top, left, h, w, c, data). Images smaller than the window have none."""
    h, w, c, data = _columns()
    rows, cols = F.floor((h - size[0]) / stride) + 1, F.floor((w - size[1]) / stride) + 1
    parts = images.where((h >= size[0]) & (w >= size[1])).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), rows * cols - 1)))
    parts = parts.withColumn("top", (F.floor(F.col("part") / cols) * stride).cast("int")).withColumn("left", (F.col("part") % cols * stride).cast("int"))
    return parts.withColumn("data", window(data, w, c, F.col("top"), F.col("left"), F.lit(size[0]), F.lit(size[1]))).withColumn("h", F.lit(size[0])).withColumn("w", F.lit(size[1]))


def center_region_set(images: DataFrame, size: tuple[int, int]) -> DataFrame:
    """The centre of each image; smaller images are left out."""
    h, w, c, data = _columns()
    fit = images.where((h >= size[0]) & (w >= size[1]))
    top, left = (F.floor((h - size[0]) / 2)).cast("int"), (F.floor((w - size[1]) / 2)).cast("int")
    return fit.withColumn("data", window(data, w, c, top, left, F.lit(size[0]), F.lit(size[1]))).withColumn("h", F.lit(size[0])).withColumn("w", F.lit(size[1]))


def resize_set(images: DataFrame, target: float | tuple[int, int]) -> DataFrame:
    """Bilinear; a number scales both axes, a pair is the new height and width."""
    def kernel(x: np.ndarray) -> np.ndarray:
        h, w = (max(1, int(x.shape[1] * target)), max(1, int(x.shape[2] * target))) if isinstance(target, (int, float)) else target
        return K.resized(x, h, w)

    return map_images(images, kernel, *_others(images))


def planned_shape(h: Column, w: Column, target_size: tuple[int, int] | None = None, max_size: int | None = None, min_size: int | None = None, center_crop: int | None = None) -> Column:
    """struct(rh, rw, oh, ow): the shape after resizing and the final one. target_size before max_size before min_size;
    a negative size scales always; center_crop cuts the centre square and resizes it."""
    long_, short = F.greatest(h, w), F.least(h, w)
    if target_size is not None:
        rh, rw = F.lit(target_size[0]), F.lit(target_size[1])
    elif max_size is not None or min_size is not None:
        size, edge = (max_size, long_) if max_size is not None else (min_size, short)
        needed = F.lit(True) if size < 0 else (edge > size if max_size is not None else edge < size)
        scale = lambda e: F.when(needed, F.floor(e * abs(size) / edge)).otherwise(e)
        rh, rw = scale(h), scale(w)
    else:
        rh, rw = h, w
    oh, ow = (F.lit(center_crop), F.lit(center_crop)) if center_crop is not None else (rh, rw)
    return F.struct(rh.cast("int").alias("rh"), rw.cast("int").alias("rw"), oh.cast("int").alias("oh"), ow.cast("int").alias("ow"))


def manipulated(images: DataFrame, target_size: tuple[int, int] | None = None, max_size: int | None = None, min_size: int | None = None, center_crop: int | None = None) -> DataFrame:
    """Resizing and cropping by the same rules as planned_shape."""
    def kernel(x: np.ndarray) -> np.ndarray:
        h, w = x.shape[1:3]
        if target_size is not None:
            x = K.resized(x, *target_size)
        elif max_size is not None and (max_size < 0 or max(h, w) > max_size):
            x = K.resized(x, h * abs(max_size) // max(h, w), w * abs(max_size) // max(h, w))
        elif max_size is None and min_size is not None and (min_size < 0 or min(h, w) < min_size):
            x = K.resized(x, h * abs(min_size) // min(h, w), w * abs(min_size) // min(h, w))
        if center_crop is not None:
            h, w = x.shape[1:3]
            s = min(h, w)
            x = K.resized(x[:, (h - s) // 2 : (h - s) // 2 + s, (w - s) // 2 : (w - s) // 2 + s], center_crop, center_crop)
        return x

    return map_images(images, kernel, *_others(images))


def jitter_set(images: DataFrame, copies: int, amounts: tuple[float, float, float, float], method: str = "normal", seed: int = 42, key: str = "id") -> DataFrame:
    """`copies` jittered versions of each image (copy 1 ..) and, if copies > 0, the original (copy 0); 0 copies: one jittered version.

    amounts: translation in pixels of both axes, rotation in degrees, scaling in powers of 2: standard deviations
    (normal) or largest values (uniform). The draw depends on seed, id and copy alone, so a task that runs again repeats it.
    """
    if method not in ("normal", "uniform"):
        raise ValueError(f"unknown jitter {method}")
    wanted = F.sequence(F.lit(0), F.lit(copies)) if copies else F.array(F.lit(1))
    rows = images.withColumn("copy", F.explode(wanted))
    keep = (*_others(images), "copy")

    def run(batches):
        for batch in batches:
            ids, copy, out = batch.column(key).to_pylist(), batch.column("copy").to_pylist(), [None] * batch.num_rows
            for lo, hi, x in stacks(batch):
                for at in range(lo, hi):
                    image = x[at - lo : at - lo + 1]
                    if copy[at]:
                        rng = np.random.default_rng([seed, int(ids[at]) & (2**63 - 1), copy[at]])
                        draw = rng.standard_normal(4) if method == "normal" else rng.uniform(-1, 1, 4)
                        ty, tx, turn, scale = draw * np.asarray(amounts)
                        image = K.jittered(image, (ty, tx), math.radians(turn), scale)
                    out[at] = image
            if out:
                yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in (*keep, "h", "w", "c")], list_column(out)], names=[*keep, "h", "w", "c", "data"])

    rows = rows.select(*keep, "h", "w", "c", "data").where(F.col("data").isNotNull())
    return rows.mapInArrow(run, f"{_ddl(rows, keep)}, h int, w int, c int, data array<double>")
