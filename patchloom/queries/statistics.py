"""2.E, 2.G, 2.H, scalar parts of 2.N, 2.O and 2.Q."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from patchloom.functions import arrays as A
from patchloom.functions.images import long_form
from patchloom.operators import linalg, stats
from patchloom.queries.inputs import ATOMS, COLOR, X, array_rows, color_images, first_vectors, images, matrix_rows, r6, truths, truths_sql, vectors
from patchloom.shared import table


def _normal(function, shift=0.0):
    def query(spark, sf_dir):
        rows = vectors(spark, sf_dir).withColumn("x", F.transform("x", lambda v: v + shift)) if shift else vectors(spark, sf_dir)
        return long_form(rows.select("vec_id", function(F.col("x")).alias("data")), "vec_id")

    return query


def e3(spark, sf_dir):
    return long_form(color_images(spark, sf_dir).select("id", A.spatial_mean_normalized(F.col("data"), 3).alias("data")), "id")


def h1(spark, sf_dir):
    return array_rows(spark, mean=stats.mean(vectors(spark, sf_dir), "x"))


def _meanstd(reg=None, only_std=False):
    def query(spark, sf_dir):
        m, s = stats.meanstd(vectors(spark, sf_dir), "x", reg)
        return array_rows(spark, std=s) if only_std else array_rows(spark, mean=m, std=s)

    return query


def h2_lineitem(spark, sf_dir):
    out = stats.column_meanstd(table(spark, sf_dir, "lineitem"), "l_quantity", "l_discount", "l_tax")
    return out.select("name", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def h4(spark, sf_dir):
    return matrix_rows(spark, stats.meancov(vectors(spark, sf_dir), "x")[1])


def h5(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.array("l_quantity", "l_discount", "l_tax").alias("x"))
    return matrix_rows(spark, stats.meancov(rows, "x")[1])


def h7(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(F.count("*").alias("n"))


def g1(spark, sf_dir):
    w = first_vectors(spark, sf_dir, 4)
    return long_form(linalg.gemm(vectors(spark, sf_dir), "x", w.T, 0.5, False, "vec_id"), "vec_id", vector="x")


def g2(spark, sf_dir):
    w = first_vectors(spark, sf_dir, 4)
    return long_form(linalg.dot(vectors(spark, sf_dir), "x", w.T, "vec_id"), "vec_id", vector="x")


def g3(spark, sf_dir):
    b = np.arange(1.0, 7.0).reshape(3, 2)
    return long_form(linalg.dot_image(color_images(spark, sf_dir), b), "id")


def g6(spark, sf_dir):
    return linalg.shape_checked(vectors(spark, sf_dir), "x", 64).agg(F.count("*").alias("n"))


def g7(spark, sf_dir):
    """A step from 1 towards each dimension's mean along a steep parabola: the first of 0.8^i that meets both conditions."""
    m, _ = stats.meanstd(vectors(spark, sf_dir), "x")
    steps = [linalg.wolfe_step(np.ones(1), lambda p, c=c: (float(5 * (p[0] - c) ** 2), 10 * (p - c))) for c in m]
    return array_rows(spark, step=np.array(steps))


def o1(spark, sf_dir):
    return long_form(vectors(spark, sf_dir).select("vec_id", A.one_of_k(F.col("label"), 10).alias("data")), "vec_id")


def s10(spark, sf_dir):
    grey = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda p: (F.get("data", p * 3) + F.get("data", p * 3 + 1) + F.get("data", p * 3 + 2)) / 3)
    return long_form(color_images(spark, sf_dir).select("id", grey.alias("data")), "id")


def s11(spark, sf_dir):
    rows = table(spark, sf_dir, "pipeline_patches").where("patches is not null and patch_id is not null")
    once = rows.groupBy("patch_id").agg(F.min("patches").alias("p")).where(~F.exists("p", lambda e: e.isNull() | F.isnan(e)) & (F.size("p") > 0))
    return once.select("patch_id", F.round(F.array_max(A.rescaled(F.col("p"))), 6).alias("top"))


def d8(spark, sf_dir):
    x = F.transform("x", lambda v: F.abs(v) * 2)
    return long_form(vectors(spark, sf_dir).select("vec_id", A.sift_normalized(x, 1.0, 0.2).alias("data")), "vec_id")


def d2(spark, sf_dir):
    from patchloom.operators.extract import identical

    return long_form(identical(images(spark, sf_dir)), "id")


QUERIES = {
    "D2_identical": d2, "D8_normalize_sift": d8,
    "E1_mean_normalizer": _normal(A.mean_normalized), "E2_meanvar_normalizer": _normal(lambda x: A.meanvar_normalized(x, 0.1)), "E3_spatial_mean_normalizer": e3,
    "E4_l2_normalizer": _normal(lambda x: A.l2_normalized(x, 0.5)), "E5_l1_normalizer": _normal(A.l1_normalized, 0.2),
    "G1_gemm": g1, "G2_dot": g2, "G3_dot_image": g3, "G4_exp": _normal(lambda x: F.transform(x, lambda v: A.clipped_exp(v * 10))), "G5_log": _normal(lambda x: F.transform(x, A.clipped_log)),
    "G6_check_shape": g6, "G7_wolfe_step": g7,
    "H1_mean": h1, "H2_meanstd": _meanstd(), "H2_lineitem_meanstd": h2_lineitem, "H3_std": _meanstd(only_std=True), "H4_meancov": h4, "H5_cov_lineitem": h5,
    "H6_feature_meanstd": _meanstd(0.01), "H7_size_total": h7,
    "O1_one_of_k": o1, "S10_gray": s10, "S11_rescale": s11,
}

_STATS = X + "select j, {what} from x group by j"
_LONG = "select vec_id, j, {v} as v from x"
ORACLES = {
    "D2_identical": X + f"select vec_id as id, j, {r6('v')} as v from x",
    "D8_normalize_sift": X + f""", a as (select vec_id, j, abs(v) * 2 as v from x), l as (select vec_id, sqrt(sum(v * v)) as len from a group by vec_id),
cut as (select vec_id, j, len, least(v / greatest(len, 1.0), 0.2) as z from a join l using (vec_id)), again as (select vec_id, sqrt(sum(z * z)) as s from cut group by vec_id)
select vec_id, j, {r6('case when len >= 1.0 then z / s else z end')} as v from cut join again using (vec_id)""",
    "E1_mean_normalizer": X + f", m as (select vec_id, avg(v) as m from x group by vec_id) select vec_id, j, {r6('v - m')} as v from x join m using (vec_id)",
    "E2_meanvar_normalizer": X + f", m as (select vec_id, avg(v) as m, stddev_pop(v) as s from x group by vec_id) select vec_id, j, {r6('(v - m) / (s + 0.1)')} as v from x join m using (vec_id)",
    "E3_spatial_mean_normalizer": COLOR + f", m as (select id, ch, avg(v) as m from col group by id, ch) select id, (r * 8 + c) * 3 + ch as j, {r6('v - m')} as v from col join m using (id, ch)",
    "E4_l2_normalizer": X + f", m as (select vec_id, sqrt(sum(v * v)) as s from x group by vec_id) select vec_id, j, {r6('v / (s + 0.5)')} as v from x join m using (vec_id)",
    "E5_l1_normalizer": X + f", m as (select vec_id, sum(v + 0.2) as s from x group by vec_id) select vec_id, j, {r6('(v + 0.2) / s')} as v from x join m using (vec_id)",
    "G1_gemm": X + ATOMS.format(k=4) + f"select vec_id, k as j, {r6('0.5 * p')} as v from dots",
    "G2_dot": X + ATOMS.format(k=4) + f"select vec_id, k as j, {r6('p')} as v from dots",
    "G3_dot_image": COLOR + f"select id, (r * 8 + c) * 2 + o as j, {r6('sum(v * (2 * ch + o + 1))')} as v from col, (select unnest([0, 1]) as o) group by id, r, c, o",
    "G4_exp": X + f"select vec_id, j, {r6('exp(least(v * 10, 100))')} as v from x",
    "G5_log": X + f"select vec_id, j, {r6('ln(greatest(v, 2.220446049250313e-16))')} as v from x",
    "G6_check_shape": "select count(*) as n from embeddings where len(embedding) = 64",
    "G7_wolfe_step": X + f""", m as (select j, avg(v) as m from x group by j), tried as (select j, m, i, pow(0.8::double, i) as a, -10 * (1 - m) / sqrt(100 * (1 - m) ** 2 + 2.220446049250313e-16) as d from m, range(100) t(i))
select j, {r6('max(a)')} as step from tried where 5 * (1 + a * d - m) ** 2 <= 5 * (1 - m) ** 2 + 0.01 * a * d * 10 * (1 - m) and d * 10 * (1 + a * d - m) >= 0.9 * d * 10 * (1 - m) group by j""",
    "H1_mean": _STATS.format(what=f"{r6('avg(v)')} as mean"),
    "H2_meanstd": _STATS.format(what=f"{r6('avg(v)')} as mean, {r6('stddev_pop(v)')} as std"),
    "H2_lineitem_meanstd": " union all ".join(f"select '{c}' as name, round(avg({c}), 6) as mean, round(stddev_pop({c}), 6) as std from lineitem" for c in ("l_quantity", "l_discount", "l_tax")),
    "H3_std": _STATS.format(what=f"{r6('stddev_pop(v)')} as std"),
    "H4_meancov": X + f"select a.j as i, b.j as j, {r6('covar_pop(a.v, b.v)')} as v from x a join x b using (vec_id) group by a.j, b.j",
    "H5_cov_lineitem": """with c as (select unnest([0, 1, 2]) as j, unnest([l_quantity, l_discount, l_tax]) as v, row from (select *, row_number() over () as row from lineitem))
select a.j::bigint as i, b.j::bigint as j, round(covar_pop(a.v, b.v), 6) + 0.0 as v from c a join c b using (row) group by a.j, b.j""",
    "H6_feature_meanstd": _STATS.format(what=f"{r6('avg(v)')} as mean, {r6('sqrt(var_pop(v) + 0.01)')} as std"),
    "H7_size_total": "select count(*) as n from lineitem",
    "O1_one_of_k": "select vec_id, k as j, case when k = label then 1.0::double else -1.0::double end as v from embeddings, (select unnest(range(10)) as k)",
    "S10_gray": COLOR + f"select id, r * 8 + c as j, {r6('avg(v)')} as v from col group by id, r, c",
    "S11_rescale": """with once as (select patch_id, min(patches) as p from pipeline_patches where patches is not null and patch_id is not null group by patch_id)
select patch_id, round(case when list_max(p) > 1 then list_max(p) / 255.0 else list_max(p) end, 6) as top from once
where len(p) > 0 and len(list_filter(p, lambda e: e is null or isnan(e))) = 0""",
}
