"""What every package uses: the shared folder, written intermediate tables, table loading, 64-bit mixing."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import time
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
_RUN = uuid.uuid4().hex[:12]


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share, with its scheme: spark.checkpoint.dir, or in local mode without that setting a temporary one.

    A setting without a scheme is on Hadoop's default file system, as for Spark itself; readers outside Spark have to be told.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(found)
        whole = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
        return "file://" + whole[5:] if whole.startswith("file:/") and not whole.startswith("file://") else whole
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="patchloom-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return f"file://{_OWN[0]}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new place for a table of this process. Tables stay while results may need them; clear() removes them."""
    return f"{scratch_dir(spark)}/patchloom-{_RUN}/{label}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Remove the intermediate tables of this process. DataFrames made by its operators can't be read any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(spark)}/patchloom-{_RUN}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives the loss of executors. What was shuffled for it is removed at once."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that materialize() gave and that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.scratch)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(scan: DataFrame) -> DataFrame:
    """A scan whose tasks are fewer than the cores is cut finer for the CPU-bound stage that follows; others stay as they are."""
    context = scan.sparkSession.sparkContext
    if scan.rdd.getNumPartitions() >= context.defaultParallelism:
        return scan
    return scan.repartition(context.defaultParallelism * 2)


class Timer:
    """Seconds since the start and since the last lap."""

    def __init__(self):
        self.reset()

    def reset(self) -> None:
        self._start = self._lap = time.perf_counter()

    def lap(self) -> float:
        now = time.perf_counter()
        took, self._lap = now - self._lap, now
        return took

    def total(self) -> float:
        return time.perf_counter() - self._start


def mix64(z: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    z = z.astype(np.uint64, copy=False)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))
