"""Seeded samples: ordered by md5(seed-id), so they don't depend on partitions and can be checked in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from patchloom.functions.images import window


def draw_key(seed: int | str, *columns: str) -> Column:
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def reservoir(df: DataFrame, n: int, *ids: str, seed: int = 42) -> DataFrame:
    """n rows, all rows equally likely; all of them if there are fewer. ids identify a row. Plans as a bounded top-k of each task."""
    return df.withColumn("draw", draw_key(seed, *ids)).orderBy("draw", *ids).limit(n).drop("draw")


def location_sample(maps: DataFrame, n: int, ratio: float | None = None, seed: int = 42) -> DataFrame:
    """n feature vectors of maps (id, h, w, c, data) -> (id, row, col, feature). ratio: keep that share of each map's locations first."""
    h, w, c = F.col("h"), F.col("w"), F.col("c")
    cells = maps.where(h * w > 0).withColumn("cell", F.explode(F.sequence(F.lit(0), h * w - 1)))
    cells = cells.withColumn("row", F.floor(F.col("cell") / w).cast("int")).withColumn("col", (F.col("cell") % w).cast("int"))
    if ratio is not None:
        share = F.conv(F.substring(draw_key(f"{seed}-ratio", "id", "cell"), 1, 8), 16, 10).cast("double") / float(1 << 32)
        cells = cells.where(share < ratio)
    few = reservoir(cells.select("id", "cell", "row", "col"), n, "id", "cell", seed=seed)
    feature = F.slice("data", F.col("cell") * c + 1, c)
    return maps.join(F.broadcast(few) if n <= 100_000 else few, "id").select("id", "row", "col", feature.alias("feature"))


def patch_draws(images: DataFrame, n: int, psize: int, seed: int = 42, *keep: str) -> DataFrame:
    """n patches at uniformly drawn images, rows and columns, with replacement -> (draw, id, top, left, *keep, feature).

    Every place a patch fits is as likely. Images get consecutive numbers through the count of each hash bucket, not
    through one ordered task.
    """
    spark = images.sparkSession
    fit = images.where((F.col("h") >= psize) & (F.col("w") >= psize))
    numbered = numbered_rows(fit.select("id"), draw_key(seed, "id"), "id")
    total = numbered.count()
    if not total:
        return fit.select(F.lit(0).cast("long").alias("draw"), "id", F.lit(0).alias("top"), F.lit(0).alias("left"), *keep, F.col("data").alias("feature")).limit(0)
    unit = lambda what: F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(f"{seed}-{what}"), F.col("draw").cast("string"))), 1, 12), 16, 10).cast("double") / float(1 << 48)
    draws = spark.range(n).withColumnRenamed("id", "draw").select("draw", F.floor(unit("image") * total).alias("number"), unit("row").alias("ur"), unit("col").alias("uc"))
    chosen = numbered.join(F.broadcast(draws) if n <= 1_000_000 else draws, F.col("rn") == F.col("number")).select("draw", "id", "ur", "uc")
    placed = fit.join(chosen, "id").withColumn("top", F.floor(F.col("ur") * (F.col("h") - psize + 1)).cast("int")).withColumn("left", F.floor(F.col("uc") * (F.col("w") - psize + 1)).cast("int"))
    data = window(F.col("data"), F.col("w"), F.col("c"), F.col("top"), F.col("left"), F.lit(psize), F.lit(psize))
    return placed.select("draw", "id", "top", "left", *keep, data.alias("feature"))


def numbered_rows(df: DataFrame, key: Column, *ids: str) -> DataFrame:
    """df with rn = 0, 1, ... in the order of a hex key. Rows are numbered within 4096 key ranges, whose offsets come from their counts."""
    keyed = df.withColumn("_key", key).withColumn("_range", F.substring("_key", 1, 3))
    counts = keyed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.select("_range", (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_before"))  # 4096 rows at most
    rank = F.row_number().over(W.partitionBy("_range").orderBy("_key", *ids)) - 1
    return keyed.withColumn("_rank", rank).join(F.broadcast(before), "_range").withColumn("rn", F.col("_before") + F.col("_rank")).drop("_key", "_range", "_rank", "_before")


def minibatches(df: DataFrame, size: int, epoch: int, *ids: str, seed: int = 42) -> DataFrame:
    """df with batch: an epoch's shuffle cut into batches of `size` rows, the rest dropped."""
    numbered = numbered_rows(df, draw_key(f"{seed}-{epoch}", *ids), *ids).withColumn("batch", F.floor(F.col("rn") / size))
    whole = df.agg(F.floor(F.count("*") / size).alias("_whole"))
    return numbered.join(F.broadcast(whole)).where(F.col("batch") < F.col("_whole")).drop("_whole", "rn")


def post_processed(df: DataFrame, **functions: Column) -> DataFrame:
    """Columns replaced by expressions over the row; others stay as they are."""
    return df.withColumns(functions)


def segment(position: Column, total: int, parts: int) -> Column:
    """The part that row `position` of `total` falls into when they are split into contiguous, even parts."""
    if total < parts:
        raise ValueError("more parts than rows")
    return (F.floor(((position + 1) * parts - 1) / total)).cast("int")
