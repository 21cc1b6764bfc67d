"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.shared import discard, materialize


def _mark(links: DataFrame) -> tuple:
    """Number and hash sums of the links: equal for equal sets."""
    h = lambda seed: F.sum(F.xxhash64(F.lit(seed), "u", "v").cast("decimal(38,0)"))
    return tuple(links.agg(F.count("*"), h(1), h(2)).first())


def components(links: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """links: two long columns -> (node, component), component the smallest node; nodes without a link are not given.

    Each round shortens the paths to the smallest node; every round's links are written to the shared folder. The
    number of links never grows beyond the input's, so a third of all nodes in one component is no hot spot but for
    the star of its smallest node, whose rows are spread over tasks by the other end.
    """
    at = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u != v")
    at = materialize(at.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    mark = _mark(at)
    for _ in range(most_rounds):
        both = at.union(at.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(least.select("u", F.col("m").alias("v"))).distinct()
        now = materialize(small, "cc")
        last, mark = mark, _mark(now)
        discard(at)
        at = now
        if mark == last:
            return at.select(F.col("u").alias("node"), F.col("v").alias("component")).union(at.select("v", "v").distinct())
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")
