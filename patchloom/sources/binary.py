"""Image sets stored as fixed-size binary records, read in ranges of records so that large files split over tasks.

CIFAR-10 and -100 (binary version), MNIST (IDX) and STL-10 (binary version); images come as (id, label, ..., h, w, c, data).
"""

from __future__ import annotations

import gzip
import json
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Records of one task.
RANGE_BYTES = 32 << 20


def _open(path: str):
    from pyarrow import fs

    if path.startswith("file:/"):  # as it stands, with blanks and %, as Hadoop's paths have it
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def checked_place(spark: SparkSession, *paths: str) -> None:
    """On a cluster a path needs a scheme: without one, each executor would look at its own disk."""
    for path in paths:
        if "://" not in path and not path.startswith("file:") and not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"{path} needs a scheme, such as hdfs:// or file:// of a shared folder")


@dataclass
class _Range(InputPartition):
    path: str
    file_no: int
    first: int
    count: int


class FixedRecordReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.size, self.skip = json.loads(options["paths"]), int(options["size"]), int(options.get("skip", 0))
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))

    def _records(self, path: str, length: int) -> int:
        body = length - self.skip
        if body < 0 or body % self.size:
            raise ValueError(f"{path} is no file of records of {self.size} bytes after {self.skip}")
        return body // self.size

    def partitions(self):
        out = []
        for no, path in enumerate(self.paths):
            if path.endswith(".gz"):  # doesn't split, and only its task knows its length
                out.append(_Range(path, no, 0, -1))
                continue
            system, inside = _open(path)
            n, step = self._records(path, system.get_file_info(inside).size), max(1, self.range_bytes // self.size)
            out += [_Range(path, no, at, min(step, n - at)) for at in range(0, n, step)]
        return out or [_Range("", 0, 0, 0)]

    def read(self, part: _Range):
        if not part.count:
            return
        system, inside = _open(part.path)
        count = part.count
        if count < 0:
            with system.open_input_stream(inside, compression=None) as f:
                body = gzip.decompress(f.read())
            count, body = self._records(part.path, len(body)), body[self.skip :]
        else:
            with system.open_input_file(inside) as f:
                f.seek(self.skip + part.first * self.size)
                body = f.read(part.count * self.size)
        for at in range(0, count, 4096):
            n = min(4096, count - at)
            ends = np.arange(n + 1, dtype=np.int32) * self.size
            raw = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(bytes(body[at * self.size : (at + n) * self.size]))])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part.file_no, np.int32)), pa.array(np.arange(part.first + at, part.first + at + n)), raw], names=["file_no", "record_no", "record"])


class FixedRecordSource(DataSource):
    """options: paths (JSON list), size and skip in bytes, rangebytes."""

    @classmethod
    def name(cls) -> str:
        return "fixed_records"

    def schema(self) -> str:
        return "file_no int, record_no long, record binary"

    def reader(self, schema) -> DataSourceReader:
        return FixedRecordReader(self.options)


def fixed_records(spark: SparkSession, paths: list[str], size: int, skip: int = 0, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file_no, record_no, record): the files' records in the order of the list."""
    checked_place(spark, *paths)
    spark.dataSource.register(FixedRecordSource)
    return spark.read.format("fixed_records").options(paths=json.dumps(paths), size=str(size), skip=str(skip), rangebytes=str(range_bytes)).load()


def _numbered(rows: DataFrame) -> Column:
    """A row's id: file by file. Leaves 2^40 records for each file."""
    return F.col("file_no").cast("long") * (1 << 40) + F.col("record_no")


def _decoded(rows: DataFrame, header: int, decode, h: int, w: int, c: int, *keep: str) -> DataFrame:
    """decode: uint8 bodies (n, h*w*c) -> float64 (n, h*w*c) in row-major order, channel fastest."""
    from patchloom.operators.tensors import _ddl

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            body = np.stack([np.frombuffer(x.as_py(), np.uint8, offset=header) for x in batch.column("record")])
            x = np.ascontiguousarray(decode(body), np.float64).reshape(len(body), -1)
            sizes = [pa.array(np.full(len(body), s, np.int32)) for s in (h, w, c)]
            data = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], *sizes, data], names=[*keep, "h", "w", "c", "data"])

    rows = rows.select(*keep, "record")
    return rows.mapInArrow(run, f"{_ddl(rows, keep)}, h int, w int, c int, data array<double>")


def interleaved(body: np.ndarray, pixels: int) -> np.ndarray:
    """Planes of three channels to three values a pixel."""
    return body.reshape(len(body), 3, pixels).transpose(0, 2, 1)


def cifar(spark: SparkSession, paths: list[str], fine: bool = False, gray: bool = False, side: int = 32) -> DataFrame:
    """CIFAR-10 files (label, planes) or, with fine, CIFAR-100 files (coarse label, label, planes). gray: mean of the channels."""
    pixels, header = side * side, 2 if fine else 1
    byte = lambda i: F.conv(F.hex(F.substring("record", i, 1)), 16, 10).cast("int")
    rows = fixed_records(spark, paths, header + 3 * pixels)
    rows = rows.select(_numbered(rows).alias("id"), byte(header).alias("label"), (byte(1) if fine else F.lit(None).cast("int")).alias("coarse_label"), "record")
    decode = (lambda b: interleaved(b, pixels).mean(2)) if gray else (lambda b: interleaved(b, pixels))
    return _decoded(rows, header, decode, side, side, 1 if gray else 3, "id", "label", "coarse_label")


def idx_shape(path: str) -> tuple[int, ...]:
    """The dimensions in an IDX file's header."""
    system, inside = _open(path)
    with system.open_input_stream(inside, compression="gzip" if path.endswith(".gz") else None) as f:
        magic = f.read(4)
        return struct.unpack(f">{magic[3]}i", f.read(4 * magic[3]))


def mnist(spark: SparkSession, images: str, labels: str) -> DataFrame:
    """An IDX file of images and one of labels, joined by record number."""
    n, h, w = idx_shape(images)
    if idx_shape(labels) != (n,):
        raise ValueError("images and labels differ in number")
    pictures = fixed_records(spark, [images], h * w, 16).select(F.col("record_no").alias("id"), "record")
    named = fixed_records(spark, [labels], 1, 8).select(F.col("record_no").alias("id"), F.conv(F.hex("record"), 16, 10).cast("int").alias("label"))
    return _decoded(pictures.join(named, "id"), 0, lambda b: b, h, w, 1, "id", "label")


def stl10(spark: SparkSession, images: str, labels: str | None = None, gray: bool = False, side: int = 96) -> DataFrame:
    """Planes of columns; labels from 1 become labels from 0, without a label file they are null."""
    pixels = side * side
    rows = fixed_records(spark, [images], 3 * pixels).select(F.col("record_no").alias("id"), "record")
    if labels:
        named = fixed_records(spark, [labels], 1).select(F.col("record_no").alias("id"), (F.conv(F.hex("record"), 16, 10).cast("int") - 1).alias("label"))
        rows = rows.join(named, "id")
    else:
        rows = rows.withColumn("label", F.lit(None).cast("int"))

    def decode(b: np.ndarray) -> np.ndarray:
        x = b.reshape(len(b), 3, side, side).transpose(0, 3, 2, 1)
        return x.mean(3) if gray else x

    return _decoded(rows, 0, decode, side, side, 1 if gray else 3, "id", "label")
