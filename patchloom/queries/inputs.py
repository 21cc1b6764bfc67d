"""What the queries read, in Spark and in SQL: the embeddings as 8 x 8 x 1 images, small models made of them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom.functions.images import images_from_vectors, stacked_channels
from patchloom.shared import table


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, x array<double>)"""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images_from_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8, 8, 1)


def color_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stacked_channels(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8, 8, 3)


def first_vectors(spark: SparkSession, sf_dir: str, k: int) -> np.ndarray:
    rows = vectors(spark, sf_dir).where(F.col("vec_id") < k).orderBy("vec_id").collect()
    return np.array([r["x"] for r in rows], np.float64)


def class_means(spark: SparkSession, sf_dir: str) -> np.ndarray:
    """(classes, dimensions)"""
    rows = vectors(spark, sf_dir).select("label", F.posexplode("x")).groupBy("label", "pos").agg(F.avg("col").alias("w")).collect()
    out = np.zeros((max(r["label"] for r in rows) + 1, max(r["pos"] for r in rows) + 1))
    for r in rows:
        out[r["label"], r["pos"]] = r["w"]
    return out


def array_rows(spark: SparkSession, **arrays: np.ndarray) -> DataFrame:
    """Equal-length model arrays as (j, name, ...), rounded."""
    names = list(arrays)
    n = len(arrays[names[0]])
    rows = [(j, *[round(float(arrays[c][j]), 6) + 0.0 for c in names]) for j in range(n)]
    return spark.createDataFrame(rows, "j long, " + ", ".join(f"{c} double" for c in names))


def matrix_rows(spark: SparkSession, a: np.ndarray) -> DataFrame:
    rows = [(i, j, round(float(a[i, j]), 6) + 0.0) for i in range(a.shape[0]) for j in range(a.shape[1])]
    return spark.createDataFrame(rows, "i long, j long, v double")


def truths(spark: SparkSession, **held: bool) -> DataFrame:
    return spark.createDataFrame([(k, bool(v)) for k, v in sorted(held.items())], "what string, held boolean")


def truths_sql(*names: str) -> str:
    return " union all ".join(f"select '{n}' as what, true as held" for n in sorted(names))


#: emb: one row a vector; x: one row an element; r, c: its place in the 8 x 8 image.
X = """with emb as (select vec_id, label, list_transform(embedding, lambda e: e::double) as x from embeddings),
x as (select *, j // 8 as r, j % 8 as c from (select vec_id, label, unnest(x) as v, generate_subscripts(x, 1) - 1 as j from emb))
"""
#: Images of three stacked vectors: id, r, c, ch, v.
COLOR = X + """, col as (select vec_id // 3 as id, r, c, vec_id % 3 as ch, v from x where vec_id // 3 in (select vec_id // 3 from emb group by 1 having count(*) = 3))
"""
#: The first k vectors as atoms: k, j, d.
ATOMS = ", atoms as (select vec_id as k, j, v as d from x where vec_id < {k}), dots as (select x.vec_id, k, sum(v * d) as p, sum((v - d) * (v - d)) as dist from x join atoms using (j) group by x.vec_id, k)\n"
#: Class means as weights and the scores they give: s.
SCORES = ", w as (select label as k, j, avg(v) as w from x group by label, j), scores as (select x.vec_id, x.label, w.k, sum(v * w) as s from x join w using (j) group by x.vec_id, x.label, w.k)\n"


def r6(e: str) -> str:
    return f"round({e}, 6) + 0.0"
