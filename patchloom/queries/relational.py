"""What the blueprint lists as implicit: base data set methods, joins, ranks, set operations, predicates; and the remaining single functions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from patchloom.functions import kernels as K
from patchloom.functions.arrays import top_indices
from patchloom.functions.images import long_form
from patchloom.operators import dictionary as D
from patchloom.operators import learn as L
from patchloom.operators import sampling, tensors
from patchloom.queries.inputs import ATOMS, X, array_rows, first_vectors, images, matrix_rows, r6, vectors
from patchloom.shared import scratch_path, table
from patchloom.sources import folders as S


def a1(spark, sf_dir):
    """Size, common shape and number of labels of a set."""
    rows = images(spark, sf_dir)
    shape = rows.agg(F.count("*").alias("size_total"), *[F.when(F.min(k) == F.max(k), F.min(k)).alias(k) for k in "hwc"])
    return shape.crossJoin(vectors(spark, sf_dir).agg(F.countDistinct("label").alias("labels")))  # one row each


def _files(spark, path: str, kind: str):
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*.{kind}").load(path).agg(F.count("*").alias("files"))


def b1(spark, sf_dir):
    path = scratch_path(spark, "matrix")
    S.dump_matrix(vectors(spark, sf_dir).repartition(5), path, 1)
    return _files(spark, path, "parquet").crossJoin(S.load_matrix(spark, path).agg(F.count("*").alias("n")))


def b4(spark, sf_dir):
    path = scratch_path(spark, "dumped")
    S.dump_images(images(spark, sf_dir), path)
    return _files(spark, path, "png")


def b5(spark, sf_dir):
    path = scratch_path(spark, "npy")
    S.dump_npy(vectors(spark, sf_dir).select(F.concat(F.array(F.col("vec_id").cast("double")), "x").alias("x")).repartition(2), "x", path)
    S.npy_to_parquet(spark, f"{path}/*.npy", f"{path}-parquet")
    return S.load_matrix(spark, f"{path}-parquet").select(F.col("data")[0].cast("long").alias("vec_id"), F.round(F.col("data")[1], 6).alias("first"))


def c7(spark, sf_dir):
    """One pixel down: the spline goes through the pixels, the edge is repeated."""
    return long_form(tensors.map_images(images(spark, sf_dir), lambda x: K.jittered(x, (1, 0), 0, 0), "id"), "id")


def d5(spark, sf_dir):
    return matrix_rows(spark, np.concatenate(K.derivative_filters(1.0)))


def i14(spark, sf_dir):
    """One update with one active atom a row."""
    return matrix_rows(spark, D.ompn_step(vectors(spark, sf_dir), "x", first_vectors(spark, sf_dir, 6), 1, "vec_id")[0])


def l2(spark, sf_dir):
    """The 3 nearest of 10 atoms, nearest first."""
    atoms = first_vectors(spark, sf_dir, 10)
    near = tensors.map_vectors(vectors(spark, sf_dir), "x", lambda x: -K.squared_distances(x, atoms), "vec_id")
    return near.select("vec_id", F.posexplode(top_indices(F.col("x"), 3)).alias("rank", "atom")).select("vec_id", F.col("rank").cast("long").alias("rank"), F.col("atom").cast("long").alias("atom"))


def l4(spark, sf_dir):
    """Labels as the ranks of class names."""
    names = table(spark, sf_dir, "image_records").where("class_name is not null").select("class_name").distinct()
    return sampling.numbered_rows(names, F.hex("class_name"), "class_name").select("class_name", F.col("rn").cast("long").alias("label"))


def m1(spark, sf_dir):
    """Stacked ids of two tables, each once."""
    ids = table(spark, sf_dir, "cub_images").select(F.col("image_id").alias("id")).unionByName(table(spark, sf_dir, "dog_files").select(F.col("file_id").alias("id")))
    return ids.where("id is not null").distinct()


def o23(spark, sf_dir):
    """A pair of parts as one flat vector, and the parts of that vector flattened again."""
    w, b = np.arange(12.0).reshape(4, 3), 100 + np.arange(3.0)
    flat = L.Linear.flattened((w, b))
    return array_rows(spark, flat=flat, again=L.Linear.flattened(L.Linear.of(flat, 4, 3)), bias=np.resize(L.Linear.of(flat, 4, 3).b, 15))


def s1(spark, sf_dir):
    rows = table(spark, sf_dir, "cub_images").where("image_id is not null")
    return rows.where(F.lower("images").rlike(r"\.(jpg|png)$")).select("image_id").distinct()


def s3(spark, sf_dir):
    return table(spark, sf_dir, "cub_images").where((F.col("split") == 1) & F.col("image_id").isNotNull()).select("image_id").distinct()


def s7(spark, sf_dir):
    share = F.conv(F.substring(sampling.draw_key("9", "event_id"), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return table(spark, sf_dir, "events").where(share < 0.3).select("event_id")


QUERIES = {
    "A1_data_set": a1, "B1_dump_matrix": b1, "B4_dump_images": b4, "B5_convert": b5, "C7_jitter": c7, "D5_derivative_filters": d5, "I14_omp_n_maximize": i14, "L2_k_nearest": l2, "L4_class_ranks": l4,
    "M_union_distinct": m1, "O23_flattened": o23, "S1_suffix": s1, "S3_split": s3, "S7_keep_mask": s7,
}

ORACLES = {
    "A1_data_set": "select count(*) as size_total, 8::integer as h, 8::integer as w, 1::integer as c, count(distinct label) as labels from embeddings",
    "B1_dump_matrix": "select 1::bigint as files, count(*) as n from embeddings", "B4_dump_images": "select count(*) as files from embeddings",
    "B5_convert": "select vec_id, round(embedding[1]::double, 6) as first from embeddings",
    "C7_jitter": X + f"select a.vec_id as id, a.j, {r6('b.v')} as v from x a join x b on a.vec_id = b.vec_id and b.c = a.c and b.r = greatest(a.r - 1, 0)",
    "D5_derivative_filters": f"""with g as (select i, j, exp(-((i - 2) * (i - 2) + (j - 2) * (j - 2)) / 2.0) as v from range(5) s(i), range(5) t(j)), n as (select i, j, v / sum(v) over () as v from g),
h as (select a.i, a.j, (b.v - c.v) / (b.i - c.i) as d from n a join n b on b.j = a.j and b.i = least(a.i + 1, 4) join n c on c.j = a.j and c.i = greatest(a.i - 1, 0)),
w as (select a.i, a.j, (b.v - c.v) / (b.j - c.j) as d from n a join n b on b.i = a.i and b.j = least(a.j + 1, 4) join n c on c.i = a.i and c.j = greatest(a.j - 1, 0))
select i, j, {r6('2 * d / sum(abs(d)) over ()')} as v from h union all select i + 5, j, {r6('2 * d / sum(abs(d)) over ()')} from w""",
    "I14_omp_n_maximize": X + ATOMS.format(k=6) + f""", hit as (select vec_id, max_by(k, (abs(p), -k)) as k, max_by(p, (abs(p), -k)) as val from dots group by vec_id),
raw as (select k, j, sum(val * v) / (sum(val * val) + 1e-8) as d from hit join x using (vec_id) group by k, j)
select k as i, j, {r6('d / sqrt(sum(d * d) over (partition by k))')} as v from raw""",
    "L2_k_nearest": X + ATOMS.format(k=10) + "select vec_id, rn - 1 as rank, k as atom from (select *, row_number() over (partition by vec_id order by dist, k) as rn from dots) where rn <= 3",
    "L4_class_ranks": "select class_name, row_number() over (order by hex(class_name::blob)) - 1 as label from (select distinct class_name from image_records where class_name is not null)",
    "M_union_distinct": "select image_id as id from cub_images where image_id is not null union select file_id from dog_files where file_id is not null",
    "O23_flattened": "select j, v as flat, v as again, 100 + (j % 3)::double as bias from (select j, case when j < 12 then j else 88 + j end::double as v from range(15) t(j))",
    "S1_suffix": r"select distinct image_id from cub_images where image_id is not null and regexp_matches(lower(images), '\.(jpg|png)$')",
    "S3_split": "select distinct image_id from cub_images where split = 1 and image_id is not null",
    "S7_keep_mask": "select event_id from events where (('0x' || substr(md5('9-' || event_id), 1, 8))::bigint)::double / 4294967296 < 0.3",
}
