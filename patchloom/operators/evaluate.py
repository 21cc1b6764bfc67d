"""Measures of predictions, over all rows, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from patchloom.functions.arrays import argmax, top_indices
from patchloom.shared import materialize


def as_label(df: DataFrame, column: str) -> Column:
    return argmax(F.col(column)) if df.schema[column].dataType.typeName() == "array" else F.col(column)


def mse(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.agg(F.avg(F.pow(F.col(y) - F.col(p), 2)).alias("mse"))


def accuracy(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.agg(F.avg((as_label(df, y) == as_label(df, p)).cast("int")).alias("accuracy"))


def confusion_table(df: DataFrame, y: str, p: str, k: int) -> DataFrame:
    """(y, p, n) for all k x k cells."""
    spark = df.sparkSession
    cells = spark.range(k * k).select(F.floor(F.col("id") / k).cast("int").alias("y"), (F.col("id") % k).cast("int").alias("p"))
    counts = df.groupBy(as_label(df, y).cast("int").alias("y"), as_label(df, p).cast("int").alias("p")).agg(F.count("*").alias("n"))
    return cells.join(counts, ["y", "p"], "left").select("y", "p", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def accuracy_class_averaged(df: DataFrame, y: str, p: str) -> DataFrame:
    each = df.groupBy(as_label(df, y).alias("y")).agg(F.avg((as_label(df, y) == as_label(df, p)).cast("int")).alias("a"))
    return each.agg(F.avg("a").alias("accuracy"))


def top_k_accuracy(df: DataFrame, y: str, scores: str, k: int) -> DataFrame:
    """The share of rows whose class is among the k highest scores, of equal scores the first."""
    return df.agg(F.avg(F.array_contains(top_indices(F.col(scores), k), F.col(y).cast("int")).cast("int")).alias("accuracy"))


def average_precision(df: DataFrame, positive: str, score: str, *by: str) -> DataFrame:
    """(*by, ap): trapezoids under precision over recall, one point for each distinct score and (0, 1); null without positives.

    Running counts come in two steps: counts of score ranges, then within each range, so no task holds all scores.
    """
    points = df.groupBy(*by, score).agg(F.sum(F.col(positive).cast("long")).alias("tp"), F.count("*").alias("n"))
    ranged = points.repartitionByRange(*by, F.desc(score)).withColumn("_range", F.spark_partition_id())
    ranged = materialize(ranged, "precision")
    totals = ranged.groupBy(*by, "_range").agg(F.sum("tp").alias("rtp"), F.sum("n").alias("rn"))
    before = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    all_ = W.partitionBy(*by)
    totals = totals.select(*by, "_range", F.coalesce(F.sum("rtp").over(before), F.lit(0)).alias("btp"), F.coalesce(F.sum("rn").over(before), F.lit(0)).alias("bn"), F.sum("rtp").over(all_).alias("all"))
    run = W.partitionBy(*by, "_range").orderBy(F.desc(score)).rowsBetween(W.unboundedPreceding, 0)
    at = ranged.join(totals, [*by, "_range"])
    at = at.withColumn("ctp", F.col("btp") + F.sum("tp").over(run)).withColumn("cn", F.col("bn") + F.sum("n").over(run))
    last = F.col("ctp") - F.col("tp"), F.col("cn") - F.col("n")
    precision = F.col("ctp") / F.col("cn")
    previous = F.when(last[1] > 0, last[0] / F.when(last[1] > 0, last[1])).otherwise(1.0)
    area = F.col("tp") * (precision + previous) / 2
    return at.groupBy(*by).agg((F.sum(area) / F.nullif(F.max("all"), F.lit(0))).alias("ap"))


def average_precision_multiclass(df: DataFrame, y: str, scores: str) -> DataFrame:
    """The mean of each class's average precision against the rest."""
    rows = df.select(F.col(y).alias("_y"), F.posexplode(scores).alias("_k", "_s")).select((F.col("_y") == F.col("_k")).alias("_is"), "_k", "_s")
    return average_precision(rows, "_is", "_s", "_k").agg(F.avg("ap").alias("ap"))
