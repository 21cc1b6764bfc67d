"""Streams of images: the same layers and samples, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.operators.sampling import draw_key
from patchloom.plans.pipeline import ConvLayer


def processed(layer: ConvLayer, images: DataFrame) -> DataFrame:
    """(..., feature) of a stream or a table: a layer keeps no state, so no watermark is needed."""
    return layer.process(images)


def running_moments(stream: DataFrame, *columns: str) -> DataFrame:
    """One row of count, sums and squared sums of scalar columns so far; for output mode complete. Merges as sums do."""
    sums = [F.sum(F.col(c).cast("double")).alias(f"{c}_sum") for c in columns] + [F.sum(F.pow(F.col(c).cast("double"), 2)).alias(f"{c}_squares") for c in columns]
    return stream.groupBy().agg(F.count("*").alias("n"), *sums)


def sampled(stream: DataFrame, n: int, ids: str, path: str, seed: int = 42) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: keeps at `path`/<batch> the n rows with the smallest draws so far. Each id counts once, a repeated batch changes nothing."""
    spark, schema = stream.sparkSession, stream.schema

    def merge(batch: DataFrame, number: int) -> None:
        rows = batch
        if number:
            rows = batch.unionByName(spark.read.schema(schema).parquet(f"{path}/{number - 1}"))
        once = rows.where(F.col(ids).isNotNull()).dropDuplicates([ids])
        once.withColumn("_draw", draw_key(seed, ids)).orderBy("_draw", ids).limit(n).drop("_draw").write.mode("overwrite").parquet(f"{path}/{number}")

    return merge
