"""Images as rows (id, h, w, c, data): data row-major, channel fastest. Geometry is index arithmetic in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gather(data: Column, n: Column, index) -> Column:
    """A new array of n elements; element i is data[index(i)]."""
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(data, index(i).cast("int")))).otherwise(F.array().cast("array<double>"))


def window(data: Column, w: Column, c: Column, top: Column, left: Column, height: Column, width: Column) -> Column:
    """The sub-window at (top, left) as a flat array."""
    def at(i):
        ch, col, row = i % c, F.floor(i / c) % width, F.floor(i / (c * width))
        return ((row + top) * w + col + left) * c + ch

    return gather(data, height * width * c, at)


def images_from_vectors(df: DataFrame, key: str, vector: str, height: int, width: int, channels: int, *keep: str) -> DataFrame:
    """Vectors of height x width x channels elements as images; others fail."""
    n = height * width * channels
    data = F.when(F.assert_true(F.size(vector) == n, f"an image of {height} x {width} x {channels} has {n} values").isNull(), F.col(vector).cast("array<double>"))
    return df.select(F.col(key).alias("id"), *keep, F.lit(height).alias("h"), F.lit(width).alias("w"), F.lit(channels).alias("c"), data.alias("data"))


def stacked_channels(df: DataFrame, key: str, vector: str, height: int, width: int, channels: int) -> DataFrame:
    """Vectors key = channels * id + k become the channels k of image id; incomplete images are left out."""
    rows = df.select(F.floor(F.col(key) / channels).cast("long").alias("id"), (F.col(key) % channels).cast("int").alias("k"), F.col(vector).cast("array<double>").alias("v"))
    all_ = rows.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("k", "v"))).alias("p")).where(F.size("p") == channels)
    data = F.transform(F.sequence(F.lit(0), F.lit(height * width * channels - 1)), lambda i: F.get(F.get(F.col("p"), (i % channels).cast("int"))["v"], F.floor(i / channels).cast("int")))
    return all_.select("id", F.lit(height).alias("h"), F.lit(width).alias("w"), F.lit(channels).alias("c"), data.alias("data"))


def long_form(df: DataFrame, *keys: str, vector: str = "data", digits: int | None = 6) -> DataFrame:
    """(keys, j, v): one row for each element; v rounded, without negative zeros."""
    out = df.select(*keys, F.posexplode(vector).alias("j", "v"))
    v = F.col("v") if digits is None else F.round("v", digits) + F.lit(0.0)
    return out.select(*keys, F.col("j").cast("long").alias("j"), v.alias("v"))
