"""Column expressions over array<double> vectors; everything stays in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 2.220446049250313e-16


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where body is a lambda over elements."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def mean(x: Column) -> Column:
    return total(x) / F.size(x)


def deviation(x: Column) -> Column:
    """Population standard deviation of a vector's elements."""
    return let(mean(x), lambda m: F.sqrt(mean(F.transform(x, lambda v: (v - m) * (v - m)))))


def mean_normalized(x: Column) -> Column:
    return let(mean(x), lambda m: F.transform(x, lambda v: v - m))


def meanvar_normalized(x: Column, reg: float = EPS) -> Column:
    return let(F.struct(mean(x).alias("m"), (deviation(x) + reg).alias("s")), lambda p: F.transform(x, lambda v: (v - p["m"]) / p["s"]))


def spatial_mean_normalized(x: Column, channels: int) -> Column:
    """Subtract each channel's mean; the channel index runs fastest."""
    of = lambda k: mean(F.filter(x, lambda v, i: i % channels == k))
    return let(F.array(*[of(k) for k in range(channels)]), lambda m: F.transform(x, lambda v, i: v - F.get(m, i % channels)))


def l2_normalized(x: Column, reg: float = EPS) -> Column:
    return let(F.sqrt(dot(x, x)) + reg, lambda s: F.transform(x, lambda v: v / s))


def l1_normalized(x: Column, reg: float = EPS) -> Column:
    """Divided by the signed sum."""
    return let(total(x) + reg, lambda s: F.transform(x, lambda v: v / s))


def clipped_exp(v: Column) -> Column:
    return F.exp(F.least(v, F.lit(100.0)))


def clipped_log(v: Column) -> Column:
    return F.log(F.greatest(v, F.lit(EPS)))


def one_of_k(label: Column, k: int, fill: float = -1.0) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.when(i == label, 1.0).otherwise(float(fill)))


def argmax(x: Column) -> Column:
    """Index of the largest element, the first of equal ones."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def argmin(x: Column) -> Column:
    return (F.array_position(x, F.array_min(x)) - 1).cast("int")


def top_indices(x: Column, k: int) -> Column:
    """Indices of the k largest elements, largest first, of equal ones the first."""
    ranked = F.sort_array(F.transform(x, lambda v, i: F.struct((-v).alias("v"), i.alias("i"))))
    return F.transform(F.slice(ranked, 1, k), lambda e: e["i"])


def rescaled(x: Column) -> Column:
    """Intensities of 0..255 become 0..1; those already within 1 stay."""
    return let(F.array_max(x) > 1, lambda big: F.transform(x, lambda v: F.when(big, v / 255.0).otherwise(v)))


def sift_normalized(x: Column, contrast: float = 1.0, most: float = 0.2) -> Column:
    """Length at least `contrast` divided out, elements cut at `most`; rows of high contrast get length 1 again."""
    def cut(length: Column) -> Column:
        y = F.transform(x, lambda v: F.least(v / F.greatest(length, F.lit(contrast)), F.lit(most)))
        return let(y, lambda z: F.when(length >= contrast, let(F.sqrt(dot(z, z)), lambda s: F.transform(z, lambda v: v / s))).otherwise(z))

    return let(F.sqrt(dot(x, x)), cut)
