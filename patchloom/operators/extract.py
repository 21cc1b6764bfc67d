"""Extractors: images to maps of local features (id, ..., h', w', d, data)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchloom.functions import kernels as K
from patchloom.operators.tensors import map_images
from patchloom.operators.views import _others, sub_image_set


def identical(images: DataFrame) -> DataFrame:
    return images


def _pair(size) -> tuple[int, int]:
    return (size, size) if isinstance(size, int) else tuple(size)


def patch_maps(images: DataFrame, psize, stride: int = 1) -> DataFrame:
    """Each image's patches as one map of h' x w' x (ph*pw*c). Images smaller than a patch are left out."""
    size = _pair(psize)
    fit = images.where((images["h"] >= size[0]) & (images["w"] >= size[1]))
    return map_images(fit, lambda x: K.patches(x, size, stride), *_others(images))


def patch_rows(images: DataFrame, psize, stride: int = 1) -> DataFrame:
    """One row for each patch, in the JVM: for sampling and SQL, not for whole sets (see plans.pipeline)."""
    return sub_image_set(images, _pair(psize), stride)


def oriented_gradients(images: DataFrame, sigma: float = 1.0, angles: int = 8, alpha: float = 9.0, twoside: bool = True) -> DataFrame:
    return map_images(images, lambda x: K.oriented_gradients(x, sigma, angles, alpha, twoside), *_others(images))


def dense_sift(images: DataFrame, psize: int, stride: int, contrast: float = 1.0, sigma: float = 1.0, most: float = 0.2) -> DataFrame:
    """128 values a location. An image smaller than a patch gives an empty map."""
    return map_images(images, lambda x: K.dense_sift(x, psize, stride, contrast, sigma, most), *_others(images))


def mosaic(patches: np.ndarray, columns: int | None = None, gap: int = 1) -> np.ndarray:
    """(n, h, w[, 3]) patches side by side, the gap filled with their mean, scaled to 0..1. Meant for a bounded few."""
    n = len(patches)
    columns = columns or int(np.ceil(np.sqrt(n)))
    rows = -(-n // columns)
    h, w = patches.shape[1] + gap, patches.shape[2] + gap
    out = np.full((rows * h - gap, columns * w - gap, *patches.shape[3:]), patches.mean())
    for p in range(n):
        r, c = p // columns * h, p % columns * w
        out[r : r + h - gap, c : c + w - gap] = patches[p]
    out -= out.min()
    return out / (out.max() + K.EPS)


def mosaic_cells(images: DataFrame, place: Column, total: int, gap: int = 1) -> DataFrame:
    """(i, j, ch, v): the cells of mosaic(), however many images there are. place: 0 .. total - 1, the images' order; all of one shape.

    Cells of the gap have the mean of all images. -> no row for an empty table.
    """
    columns = int(np.ceil(np.sqrt(max(total, 1))))
    i, per = F.col("_at"), F.col("w") * F.col("c")
    cells = images.where(F.col("data").isNotNull()).select(place.alias("_p"), "h", "w", "c", F.posexplode("data").alias("_at", "v"))
    cells = cells.select(
        (F.floor(F.col("_p") / columns) * (F.col("h") + gap) + F.floor(i / per)).cast("long").alias("i"),
        (F.col("_p") % columns * (F.col("w") + gap) + F.floor(i / F.col("c")) % F.col("w")).cast("long").alias("j"), (i % F.col("c")).cast("long").alias("ch"), "v",
    )
    told = cells.agg(F.avg("v").alias("_mean"), F.min("v").alias("_lo"), F.max("v").alias("_hi"), F.max("i").alias("_i"), F.max("ch").alias("_ch"))
    shape = images.agg(F.max("w").alias("_w"))
    whole = told.join(shape).where("_hi is not null")  # one row
    width = F.least(F.lit(columns), F.lit(total)) * (F.col("_w") + gap) - gap
    grid = whole.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("_i"))).alias("i"), width.alias("_width"), "_mean", "_lo", "_hi", "_ch")
    down = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), c.cast("long")))
    grid = grid.select("i", down(F.col("_width") - 1).alias("j"), "_mean", "_lo", "_hi", "_ch").select("i", "j", down(F.col("_ch")).alias("ch"), "_mean", "_lo", "_hi")
    v = F.coalesce("v", "_mean")
    return grid.join(cells, ["i", "j", "ch"], "left").select("i", "j", "ch", ((v - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + K.EPS)).alias("v"))


def patch_shape(size: int) -> tuple[int, ...]:
    """The square, or three-channel square, of a flat patch of so many values."""
    for channels, tail in ((1, ()), (3, (3,))):
        edge = int(round((size / channels) ** 0.5))
        if edge * edge * channels == size:
            return (edge, edge, *tail)
    raise ValueError(f"{size} values are no square patch")


def channel_mosaic(patch: np.ndarray, gap: int = 1) -> np.ndarray:
    """Each channel of an (h, w, c) patch as a grey patch of its own."""
    return mosaic(np.moveaxis(patch, -1, 0), gap=gap)
