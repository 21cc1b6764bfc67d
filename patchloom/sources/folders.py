"""Folders of images, list files around them, matrices in files, models in files."""

from __future__ import annotations

import io
import json
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from patchloom.operators.tensors import list_column, matrix

# The 14 classes of a published subset of the birds set, in its order, which makes the labels.
BIRD_SUBSET = (
    "151.Black_capped_Vireo",
    "152.Blue_headed_Vireo",
    "153.Philadelphia_Vireo",
    "154.Red_eyed_Vireo",
    "155.Warbling_Vireo",
    "156.White_eyed_Vireo",
    "157.Yellow_throated_Vireo",
    "036.Northern_Flicker",
    "187.American_Three_toed_Woodpecker",
    "188.Pileated_Woodpecker",
    "189.Red_bellied_Woodpecker",
    "190.Red_cockaded_Woodpecker",
    "191.Red_headed_Woodpecker",
    "192.Downy_Woodpecker",
)


# --- image folders ------------------------------------------------------------------------------------------------


def any_case(extensions: tuple[str, ...]) -> str:
    """A file pattern for the extensions in any case, so that other files are listed but never opened."""
    letter = lambda c: f"[{c.lower()}{c.upper()}]" if c.isalpha() else c
    return "*.{" + ",".join("".join(map(letter, e.lstrip("."))) for e in extensions) + "}"


def decoded_images(spark: SparkSession, path: str, extensions: tuple[str, ...] | None = None) -> DataFrame:
    """(path, h, w, c, data) of image files in RGB order; a file that can't be decoded has h of -1 and no data."""
    source = spark.read.format("image").option("dropInvalid", False)
    raw = (source.option("pathGlobFilter", any_case(extensions)) if extensions else source).load(path).select("image.*")
    rows = raw.select(F.col("origin").alias("path"), F.col("height").alias("h"), F.col("width").alias("w"), F.col("nChannels").alias("c"), "data")

    def run(batches):
        for batch in batches:
            out = []
            for h, w, c, data in zip(*(batch.column(k).to_pylist() for k in ("h", "w", "c", "data")), strict=True):
                x = np.frombuffer(data or b"", np.uint8)
                if h > 0 and c >= 3:  # the source stores blue, green, red
                    x = x.reshape(h, w, c)[:, :, [2, 1, 0, *range(3, c)]]
                out.append(x)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in ("path", "h", "w", "c")], list_column(out)], names=["path", "h", "w", "c", "data"])

    return rows.mapInArrow(run, "path string, h int, w int, c int, data array<double>")


def two_layer_images(spark: SparkSession, root: str, extensions: tuple[str, ...] = ("jpg", "jpeg", "png", "bmp")) -> DataFrame:
    """root/class/file -> (path, class_name, label, h, w, c, data). label: the rank of the class name. Extensions match in any case."""
    named = decoded_images(spark, f"{root}/*/*", extensions).withColumn("class_name", F.element_at(F.split("path", "/"), -2))
    folders = spark.read.format("binaryFile").option("pathGlobFilter", any_case(extensions)).load(f"{root}/*/*").select(F.element_at(F.split("path", "/"), -2).alias("class_name"))
    labels = folders.distinct().withColumn("label", (F.row_number().over(W.orderBy("class_name")) - 1).cast("int"))  # as many rows as classes
    return named.join(labels, "class_name").select("path", "class_name", "label", "h", "w", "c", "data")


def broken_images(spark: SparkSession, path: str) -> DataFrame:
    """One row: checked files and how many of them can't be decoded."""
    raw = spark.read.format("image").option("dropInvalid", False).load(path)
    return raw.agg(F.count("*").alias("files"), F.coalesce(F.sum((F.col("image.height") < 0).cast("long")), F.lit(0)).alias("broken"))


def png_bytes(image: np.ndarray) -> bytes:
    """An (h, w), (h, w, 1) or (h, w, 3) image of 0..255 as PNG."""
    x = np.atleast_3d(np.clip(np.rint(image), 0, 255).astype(np.uint8))
    h, w, c = x.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    lines = np.concatenate((np.zeros((h, 1), np.uint8), x.reshape(h, w * c)), 1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if c == 3 else 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def dump_images(images: DataFrame, folder: str, name: str = "id") -> None:
    """Each image as folder/<name>.png; the task that holds a row writes it, a repeated task writes the same files."""
    from patchloom.sources.binary import _open, checked_place

    checked_place(images.sparkSession, folder)

    def write(batches):
        system, inside = _open(folder)
        for batch in batches:
            for n, h, w, c, data in zip(*(batch.column(k).to_pylist() for k in (name, "h", "w", "c", "data")), strict=True):
                target = f"{inside}/{n}.png"
                system.create_dir(target.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(target) as f:
                    f.write(png_bytes(np.asarray(data).reshape(h, w, c)))
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    rows = images.select(F.col(name).cast("string").alias(name), "h", "w", "c", "data").where(F.col("data").isNotNull())
    rows.mapInArrow(write, "n long").agg(F.sum("n")).collect()


# --- list files around image folders ----------------------------------------------------------------------------------


def _lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, sep=" ", schema=schema, escape='"')


def write_list(rows: DataFrame, path: str) -> None:
    """A list file as bird_list reads it: fields with a blank or a quote are quoted, quotes doubled, backslashes left as they are."""
    rows.coalesce(1).write.csv(path, sep=" ", escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def bird_list(spark: SparkSession, root: str, is_training: bool | None = None, subset: tuple[str, ...] | None = None, files: dict[str, str] | None = None) -> DataFrame:
    """The birds set's list files joined by image id: (image_id, path, class_name, label, is_training, box_x, box_y, box_w, box_h).

    Labels start at 0; with a subset they are places in it. Boxes are 0-based; a missing one (-1) is null.
    """
    name = {"images": "images.txt", "boxes": "bounding_boxes.txt", "labels": "image_class_labels.txt", "split": "train_test_split.txt", "classes": "classes.txt"} | (files or {})
    rows = _lines(spark, f"{root}/{name['images']}", "image_id long, path string")
    rows = rows.join(_lines(spark, f"{root}/{name['labels']}", "image_id long, class_id int"), "image_id")
    rows = rows.join(_lines(spark, f"{root}/{name['split']}", "image_id long, train int"), "image_id")
    rows = rows.join(_lines(spark, f"{root}/{name['boxes']}", "image_id long, x double, y double, w double, h double"), "image_id", "left")
    rows = rows.join(_lines(spark, f"{root}/{name['classes']}", "class_id int, class_name string"), "class_id")
    out = selected_list(rows.withColumn("is_training", F.col("train") == 1).withColumn("label", F.col("class_id") - 1), is_training, subset)
    box = zero_based_box("x", "y", "w", "h")
    return out.select("image_id", "path", "class_name", "label", "is_training", *[box[c].alias(f"box_{c}") for c in "xywh"])


def zero_based_box(x: str, y: str, w: str, h: str) -> dict[str, Column]:
    """1-based boxes to 0-based ones: every field is one less; negative fields are missing."""
    return {k: F.when(F.col(c) >= 0, F.col(c) - 1) for k, c in zip("xywh", (x, y, w, h), strict=True)}


def selected_list(rows: DataFrame, is_training: bool | None, subset: tuple[str, ...] | None) -> DataFrame:
    """Rows of one split and of the subset's classes, whose place in the subset becomes the label. The list of classes is short."""
    if is_training is not None:
        rows = rows.where(F.col("is_training") == is_training)
    if subset is not None:
        places = rows.sparkSession.createDataFrame([(c, i) for i, c in enumerate(subset)], "class_name string, place int")
        rows = rows.join(F.broadcast(places), "class_name").withColumn("label", F.col("place")).drop("place")
    return rows


def crop_window(x: Column, y: Column, w: Column, h: Column, factor: float, height: Column, width: Column) -> Column:
    """struct(xmin, ymin, xmax, ymax): the box grown about its centre by the factor, rounded, cut at the image; ends excluded."""
    whole = lambda v: v.cast("int")
    cx, cy, dx, dy = x + w / 2, y + h / 2, w * factor / 2, h * factor / 2
    return F.struct(
        F.greatest(whole(cx - dx + 0.5), F.lit(0)).alias("xmin"), F.greatest(whole(cy - dy + 0.5), F.lit(0)).alias("ymin"),
        F.least(whole(cx + dx + 0.5), width - 1).alias("xmax"), F.least(whole(cy + dy + 0.5), height - 1).alias("ymax"),
    )


def shifted_parts(parts: Column, crop: Column, target: tuple[float, float] | None = None) -> Column:
    """array<struct<x,y>> of part places relative to a crop, scaled to a target size of it; (-1, -1) where missing or outside."""
    sx = target[0] / (crop["xmax"] - crop["xmin"]) if target else F.lit(1.0)
    sy = target[1] / (crop["ymax"] - crop["ymin"]) if target else F.lit(1.0)
    outside = lambda p: p["x"].isNull() | (p["x"] < 0) | (p["x"] < crop["xmin"]) | (p["x"] >= crop["xmax"]) | (p["y"] < crop["ymin"]) | (p["y"] >= crop["ymax"])
    at = lambda v, ok: F.when(ok, F.lit(-1.0)).otherwise(v)
    return F.transform(parts, lambda p: F.struct(at((p["x"] - crop["xmin"]) * sx, outside(p)).alias("x"), at((p["y"] - crop["ymin"]) * sy, outside(p)).alias("y")))


def dog_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Annotation files (XML) -> (file, xmin, ymin, xmax, ymax) of the first object, the minima 0-based."""
    rows = spark.read.option("rowTag", "annotation").option("inferSchema", False).schema("object array<struct<name: string, bndbox: struct<xmin: int, ymin: int, xmax: int, ymax: int>>>").xml(path)
    rows = rows.withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    box = F.col("object")[0]["bndbox"]
    return rows.select("file", (box["xmin"] - 1).alias("xmin"), (box["ymin"] - 1).alias("ymin"), box["xmax"].alias("xmax"), box["ymax"].alias("ymax"))


# --- matrices and models ----------------------------------------------------------------------------------------------


def from_array(spark: SparkSession, array: np.ndarray, labels: np.ndarray | None = None) -> DataFrame:
    """(id, label, [h, w, c,] data) of an array whose first axis is the rows; labels default to 0."""
    if labels is not None and len(labels) != len(array):
        raise ValueError("as many labels as rows are needed")
    columns = {"id": pa.array(np.arange(len(array))), "label": pa.array((np.zeros(len(array)) if labels is None else np.asarray(labels)).astype(np.int32))}
    shape = array.shape[1:]
    if len(shape) > 1:
        columns |= {k: pa.array(np.full(len(array), s, np.int32)) for k, s in zip("hwc", (*shape, 1)[:3], strict=True)}
    return spark.createDataFrame(pa.table(columns | {"data": list_column(list(array))}))


def dump_matrix(df: DataFrame, path: str, parts: int | None = None) -> None:
    """Parquet part files; parts=1 writes one, None as many as there are tasks."""
    (df if parts is None else df.coalesce(parts)).write.mode("overwrite").parquet(path)


def load_matrix(spark: SparkSession, path: str, numbered: bool = False) -> DataFrame:
    """The rows of all parts. numbered: with part and row, the place of a row in the matrix: part by part, row by row."""
    rows = spark.read.parquet(path)
    if not numbered:
        return rows
    part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int")
    return rows.select("*", part.alias("part"), F.col("_metadata.row_index").alias("row"))


def sample_image(spark: SparkSession, side: int = 64) -> DataFrame:
    """One test picture (id, h, w, c, data) for trying things out: a grey ramp with a checkered pattern of squares of 8."""
    at = lambda i: (F.floor(i / side) + i % side) * 255 / (4 * (side - 1)) + F.when((F.floor(F.floor(i / side) / 8) + F.floor(i % side / 8)) % 2 == 0, 127.5).otherwise(0.0)
    return spark.range(1).select("id", F.lit(side).alias("h"), F.lit(side).alias("w"), F.lit(1).alias("c"), F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), at).alias("data"))


def load_npy(spark: SparkSession, pattern: str) -> DataFrame:
    """.npy files (one, or name-?????-of-?????.npy) -> (file, row, data). Keeps the order of rows within each file."""
    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                a = np.load(io.BytesIO(content.as_py()), allow_pickle=False)
                a = a.reshape(len(a), -1)
                for at in range(0, len(a), 8192):
                    x = a[at : at + 8192]
                    yield pa.RecordBatch.from_arrays([pa.array([path.rsplit("/", 1)[-1]] * len(x)), pa.array(np.arange(at, at + len(x))), list_column(list(x))], names=["file", "row", "data"])

    return spark.read.format("binaryFile").load(pattern).select("path", "content").mapInArrow(run, "file string, row long, data array<double>")


def dump_npy(df: DataFrame, vector: str, folder: str, name: str = "part") -> None:
    """One name-?????-of-?????.npy for each task."""
    from patchloom.sources.binary import _open, checked_place

    checked_place(df.sparkSession, folder)
    total = df.rdd.getNumPartitions()

    def write(batches):
        from pyspark import TaskContext

        rows = [matrix(b.column(vector)) for b in batches if b.num_rows]
        if rows:
            system, inside = _open(folder)
            system.create_dir(inside, recursive=True)
            out = io.BytesIO()
            np.save(out, np.concatenate(rows))
            with system.open_output_stream(f"{inside}/{name}-{TaskContext.get().partitionId():05d}-of-{total:05d}.npy") as f:
                f.write(out.getvalue())
        yield pa.RecordBatch.from_arrays([pa.array([sum(map(len, rows))])], names=["n"])

    df.select(vector).mapInArrow(write, "n long").agg(F.sum("n")).collect()


def npy_to_parquet(spark: SparkSession, pattern: str, path: str) -> None:
    load_npy(spark, pattern).write.mode("overwrite").parquet(path)


def save_model(spark: SparkSession, path: str, **arrays: np.ndarray) -> None:
    """Arrays as one JSON row each: nothing that runs code when it is read."""
    rows = [(k, json.dumps(list(np.shape(a))), [float(v) for v in np.ravel(a)]) for k, a in arrays.items()]
    spark.createDataFrame(rows, "name string, shape string, data array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    return {r["name"]: np.array(r["data"], np.float64).reshape(json.loads(r["shape"])) for r in spark.read.parquet(path).collect()}
