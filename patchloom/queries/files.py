"""2.A sources and 2.B sinks, by round trips through files of the formats; 2.K and 2.Q over the listed tables."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from patchloom.functions.images import images_from_vectors, long_form
from patchloom.operators.tensors import matrix
from patchloom.queries.inputs import X, images, r6, vectors
from patchloom.shared import scratch_path, table
from patchloom.sources import binary as B
from patchloom.sources import folders as S


def _pixels(spark, sf_dir):
    """(vec_id, label, px): the vectors as grey values of 0..255."""
    px = F.transform("x", lambda v: F.floor(F.least(F.greatest((v + 0.5) * 255, F.lit(0)), F.lit(255))).cast("int"))
    return vectors(spark, sf_dir).select("vec_id", "label", px.alias("px"))


def _colors(spark, sf_dir):
    """(vec_id, label, px): three vectors each as the planes of one image, with the first one's label."""
    part = F.struct("vec_id", "label", "px")
    rows = _pixels(spark, sf_dir).groupBy(F.floor(F.col("vec_id") / 3).alias("vec_id")).agg(F.sort_array(F.collect_list(part)).alias("p")).where(F.size("p") == 3)
    return rows.select("vec_id", F.col("p")[0]["label"].alias("label"), F.flatten(F.transform("p", lambda e: e["px"])).alias("px"))


def _one_file(rows, folder: str, name: str, encode, header: bytes = b"") -> str:
    """A file that one task writes, as such formats have it, batch by batch: encode(labels, pixels) gives the bytes of a batch."""

    def write(batches):
        system, inside = B._open(folder)
        system.create_dir(inside, recursive=True)
        with system.open_output_stream(f"{inside}/{name}") as f:
            f.write(header)
            for batch in batches:
                if batch.num_rows:
                    f.write(encode(batch.column("label").to_numpy(zero_copy_only=False).astype(np.uint8), matrix(batch.column("px")).astype(np.uint8)).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([1])], names=["n"])

    rows.repartition(1).sortWithinPartitions("vec_id").mapInArrow(write, "n long").collect()
    return f"{folder}/{name}"


def _write(spark, label: str, **files: bytes) -> str:
    folder = scratch_path(spark, label)
    system, inside = B._open(folder)
    system.create_dir(inside, recursive=True)
    for name, body in files.items():
        with system.open_output_stream(f"{inside}/{name}") as f:
            f.write(body)
    return folder


def a2(spark, sf_dir):
    """An array is on the driver to begin with: here that of all vectors."""
    rows = _pixels(spark, sf_dir).orderBy("vec_id").collect()
    x = np.array([r["px"] for r in rows], np.float64).reshape(len(rows), 8, 8)
    return long_form(S.from_array(spark, x, np.array([r["label"] for r in rows])), "id", "label")


def a3(spark, sf_dir):
    few = images_from_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8, 8, 1, "label")
    few = few.withColumn("id", F.concat(F.lit("class_"), F.col("label"), F.lit("/"), F.col("id"))).withColumn("data", F.transform("data", lambda v: F.floor(F.least(F.greatest((v + 0.5) * 255, F.lit(0)), F.lit(255))).cast("double")))
    folder = scratch_path(spark, "two-layer")
    S.dump_images(few, folder)
    out = S.two_layer_images(spark, folder).withColumn("id", F.regexp_extract("path", r"(\d+)\.png$", 1).cast("long"))
    return long_form(out, "id", "class_name", "label")


def a5(spark, sf_dir):
    path = _one_file(_colors(spark, sf_dir), scratch_path(spark, "cifar"), "batch", lambda y, x: np.concatenate((y[:, None], x), 1))
    return long_form(B.cifar(spark, [path], side=8), "id", "label")


def a6(spark, sf_dir):
    rows, folder = _pixels(spark, sf_dir), scratch_path(spark, "mnist")
    n = rows.count()
    pictures = _one_file(rows, folder, "images", lambda y, x: x, struct.pack(">4i", 0x803, n, 8, 8))
    labels = _one_file(rows, folder, "labels", lambda y, x: y, struct.pack(">2i", 0x801, n))
    return long_form(B.mnist(spark, pictures, labels), "id", "label")


def a7(spark, sf_dir):
    rows, folder = _colors(spark, sf_dir), scratch_path(spark, "stl")
    pictures = _one_file(rows, folder, "images", lambda y, x: np.ascontiguousarray(x.reshape(-1, 3, 8, 8).transpose(0, 1, 3, 2)))
    labels = _one_file(rows, folder, "labels", lambda y, x: y + np.uint8(1))
    return long_form(B.stl10(spark, pictures, labels, side=8), "id", "label")


def _birds(spark, sf_dir):
    rows = table(spark, sf_dir, "cub_images").where("image_id is not null and images is not null and split is not null and label is not null and class_name is not null")
    return rows.groupBy("image_id").agg(*[F.min(c).alias(c) for c in ("images", "class_name", "label", "split", "box_x", "box_y", "box_w", "box_h")])


def a8(spark, sf_dir):
    """The list files written from the table and read back, training rows only."""
    rows, folder = _birds(spark, sf_dir), scratch_path(spark, "birds")
    put = lambda name, df: S.write_list(df, f"{folder}/{name}")
    put("images.txt", rows.select("image_id", "images"))
    put("image_class_labels.txt", rows.select("image_id", F.col("label") + 1))
    put("train_test_split.txt", rows.select("image_id", "split"))
    put("bounding_boxes.txt", rows.select("image_id", "box_x", "box_y", "box_w", "box_h"))
    put("classes.txt", rows.groupBy(F.col("label") + 1).agg(F.min("class_name")))
    return S.bird_list(spark, folder, True).select("image_id", "path", "class_name", "label", *[F.round(f"box_{c}", 6).alias(f"box_{c}") for c in "xywh"])


def a9(spark, sf_dir):
    """Parts at the box's corners and centre, relative to the box grown by 1.2 and scaled to 100 x 100, in an image of 640 x 480."""
    rows = _birds(spark, sf_dir).where("box_x > 0 and box_y > 0 and box_w > 2 and box_h > 2")
    crop = S.crop_window(F.col("box_x"), F.col("box_y"), F.col("box_w"), F.col("box_h"), 1.2, F.lit(480), F.lit(640))
    part = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    parts = F.array(part(F.col("box_x"), F.col("box_y")), part(F.col("box_x") + F.col("box_w") / 2, F.col("box_y") + F.col("box_h") / 2), part(F.lit(-2.0), F.lit(-2.0)), part(F.col("box_x") + 2000, F.col("box_y")))
    out = rows.withColumn("crop", crop).where("crop.xmax > crop.xmin and crop.ymax > crop.ymin").select("image_id", F.posexplode(S.shifted_parts(parts, F.col("crop"), (100.0, 100.0))).alias("part", "p"))
    return out.select("image_id", F.col("part").cast("long").alias("part"), F.round("p.x", 5).alias("x"), F.round("p.y", 5).alias("y"))


def a10(spark, sf_dir):
    """The subset's classes with their labels, as a reader selects them."""
    rows = spark.createDataFrame([(c, True, 0) for c in reversed(S.BIRD_SUBSET)] + [("001.Another", True, 0)], "class_name string, is_training boolean, label int")
    return S.selected_list(rows, True, S.BIRD_SUBSET).select("class_name", "label")


def k4(spark, sf_dir):
    """Three classes of the table as a subset: rows filtered and labels replaced."""
    rows = _birds(spark, sf_dir)
    few = tuple(r[0] for r in rows.select("class_name").distinct().orderBy("class_name").limit(3).collect())
    return S.selected_list(rows.withColumn("is_training", F.col("split") == 1), True, few).select("image_id", "class_name", "label")


def a11(spark, sf_dir):
    rows = table(spark, sf_dir, "dog_files").where("file_id is not null and xmin is not null and ymin is not null and xmax is not null and ymax is not null")
    rows = rows.groupBy("file_id").agg(*[F.min(c).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])
    x, y = F.col("xmin") - 1, F.col("ymin") - 1
    crop = S.crop_window(x, y, F.col("xmax") - x, F.col("ymax") - y, 1.2, F.lit(480), F.lit(640))
    return rows.select("file_id", crop.alias("crop")).select("file_id", "crop.*")


def a14(spark, sf_dir):
    path = scratch_path(spark, "matrix")
    S.dump_matrix(vectors(spark, sf_dir), path, 1)
    return long_form(S.load_matrix(spark, path), "vec_id", vector="x")


def a15(spark, sf_dir):
    path = scratch_path(spark, "npy")
    rows = vectors(spark, sf_dir).select(F.concat(F.array(F.col("vec_id").cast("double")), "x").alias("x")).repartition(3)
    S.dump_npy(rows, "x", path)
    back = S.load_npy(spark, f"{path}/*.npy")
    return long_form(back.select(F.col("data")[0].cast("long").alias("vec_id"), F.slice("data", 2, 64).alias("x")), "vec_id", vector="x")


def a15_order(spark, sf_dir):
    """Parts written by range and read back with the place of each row: part by part, row by row the ids ascend."""
    path = scratch_path(spark, "matrix")
    S.dump_matrix(vectors(spark, sf_dir).repartitionByRange(3, "vec_id").sortWithinPartitions("vec_id"), path)
    order = Window.orderBy("part", "row")
    return S.load_matrix(spark, path, True).select("vec_id", (F.row_number().over(order) - 1).cast("long").alias("place"))


def a16(spark, sf_dir):
    """An image for each row, written in tasks, and one file that is none."""
    folder = _write(spark, "verify", **{"bad.png": b"no image"})
    pixels = F.transform("data", lambda v: F.floor(F.least(F.greatest((v + 0.5) * 255, F.lit(0)), F.lit(255))).cast("double"))
    S.dump_images(images(spark, sf_dir).withColumn("data", pixels), folder)
    return S.broken_images(spark, folder)


def b2(spark, sf_dir):
    path = scratch_path(spark, "matrix")
    S.dump_matrix(vectors(spark, sf_dir).repartition(4), path)
    return S.load_matrix(spark, path).agg(F.count("*").alias("n"), F.round(F.sum(F.aggregate("x", F.lit(0.0), lambda s, v: s + v)), 6).alias("total"))


def b3(spark, sf_dir):
    path = scratch_path(spark, "model")
    S.save_model(spark, path, w=np.arange(6.0).reshape(2, 3))
    w = S.load_model(spark, path)["w"]
    return spark.createDataFrame([(i, j, float(w[i, j])) for i in range(2) for j in range(3)], "i long, j long, v double")


QUERIES = {
    "A2_array_set": a2, "A3_two_layer": a3, "A5_cifar": a5, "A6_mnist": a6, "A7_stl10": a7, "A8_bird_list": a8, "A9_bird_parts": a9, "A10_bird_subset": a10, "A11_dog_boxes": a11,
    "A14_load_matrix": a14, "A15_load_matrix_multi": a15, "A16_verify_images": a16, "B2_dump_matrix_multi": b2, "B3_save_model": b3, "K4_class_subset": k4,
    "A15_matrix_order": a15_order,
}

_PX = "floor(least(greatest((v + 0.5) * 255, 0), 255))"
_BIRDS = r"""with once as (select image_id, min(images) as images, min(class_name) as class_name, min(label) as label, min(split) as split, min(box_x) as box_x, min(box_y) as box_y, min(box_w) as box_w, min(box_h) as box_h
from cub_images where image_id is not null and images is not null and split is not null and label is not null and class_name is not null group by image_id),
birds as (select * from once)
"""
_BOX = ", ".join(f"case when box_{c} >= 0 then round(box_{c} - 1, 6) end as box_{c}" for c in "xywh")
_HALF = "trunc({} + 0.5)::integer"


def _crop(x: str, y: str, w: str, h: str) -> str:
    grown = lambda a, b, s: _HALF.format(f"({a} + {b} / 2.0 {s} {b} * 1.2 / 2)")
    return f"greatest({grown(x, w, '-')}, 0) as xmin, greatest({grown(y, h, '-')}, 0) as ymin, least({grown(x, w, '+')}, 639) as xmax, least({grown(y, h, '+')}, 479) as ymax"


ORACLES = {
    "A2_array_set": X + f"select vec_id as id, label, j, {_PX} + 0.0 as v from x",
    "A3_two_layer": X + f" select vec_id as id, 'class_' || label as class_name, (dense_rank() over (order by 'class_' || label) - 1)::integer as label, j, {_PX} + 0.0 as v from x",
    "A5_cifar": X + f"select vec_id // 3 as id, (select e.label from emb e where e.vec_id = x.vec_id // 3 * 3) as label, j * 3 + vec_id % 3 as j, {_PX} + 0.0 as v from x where vec_id // 3 in (select vec_id // 3 from emb group by 1 having count(*) = 3)",
    "A6_mnist": X + f"select vec_id as id, label, j, {_PX} + 0.0 as v from x",
    "A7_stl10": X + f"select vec_id // 3 as id, (select e.label from emb e where e.vec_id = x.vec_id // 3 * 3) as label, j * 3 + vec_id % 3 as j, {_PX} + 0.0 as v from x where vec_id // 3 in (select vec_id // 3 from emb group by 1 having count(*) = 3)",
    "A8_bird_list": _BIRDS + f", names as (select label, min(class_name) as class_name from birds group by label) select image_id, images as path, n.class_name, b.label, {_BOX} from birds b join names n using (label) where split = 1",
    "A9_bird_parts": _BIRDS + f""", crops as (select image_id, box_x, box_y, box_w, box_h, {_crop('box_x', 'box_y', 'box_w', 'box_h')} from birds where box_x > 0 and box_y > 0 and box_w > 2 and box_h > 2),
parts as (select *, 0 as part, box_x as x, box_y as y from crops union all select *, 1, box_x + box_w / 2, box_y + box_h / 2 from crops union all select *, 2, -2, -2 from crops union all select *, 3, box_x + 2000, box_y from crops),
told as (select *, x < 0 or x < xmin or x >= xmax or y < ymin or y >= ymax as gone from parts where xmax > xmin and ymax > ymin)
select image_id, part::bigint as part, case when gone then -1.0 else round((x - xmin) * (100.0::double / (xmax - xmin)), 5) end as x, case when gone then -1.0 else round((y - ymin) * (100.0::double / (ymax - ymin)), 5) end as y from told""",
    "A10_bird_subset": "select class_name, label::integer as label from (values ('151.Black_capped_Vireo', 0), ('152.Blue_headed_Vireo', 1), ('153.Philadelphia_Vireo', 2), ('154.Red_eyed_Vireo', 3), ('155.Warbling_Vireo', 4), ('156.White_eyed_Vireo', 5), ('157.Yellow_throated_Vireo', 6), ('036.Northern_Flicker', 7), ('187.American_Three_toed_Woodpecker', 8), ('188.Pileated_Woodpecker', 9), ('189.Red_bellied_Woodpecker', 10), ('190.Red_cockaded_Woodpecker', 11), ('191.Red_headed_Woodpecker', 12), ('192.Downy_Woodpecker', 13)) t(class_name, label)",
    "A11_dog_boxes": f"""with once as (select file_id, min(xmin) - 1 as x, min(ymin) - 1 as y, min(xmax) - min(xmin) + 1 as w, min(ymax) - min(ymin) + 1 as h
from dog_files where file_id is not null and xmin is not null and ymin is not null and xmax is not null and ymax is not null group by file_id)
select file_id, {_crop('x', 'y', 'w', 'h')} from once""",
    "A14_load_matrix": X + f"select vec_id, j, {r6('v')} as v from x", "A15_load_matrix_multi": X + f"select vec_id, j, {r6('v')} as v from x",
    "A15_matrix_order": "select vec_id, row_number() over (order by vec_id) - 1 as place from embeddings", "A16_verify_images": "select count(*) + 1 as files, 1::bigint as broken from embeddings",
    "B2_dump_matrix_multi": X + "select (select count(*) from emb) as n, round(sum(v), 6) as total from x",
    "B3_save_model": "select a as i, b as j, (a * 3 + b)::double as v from range(2) s(a), range(3) t(b)",
    "K4_class_subset": _BIRDS + ", few as (select class_name, row_number() over (order by class_name) - 1 as label from (select distinct class_name from birds) order by class_name limit 3) select image_id, class_name, f.label::integer as label from birds join few f using (class_name) where split = 1",
}
