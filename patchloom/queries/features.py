"""2.I dictionaries, 2.J encoders and poolers, the fused layer."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from patchloom.functions import kernels as K
from patchloom.functions.images import long_form
from patchloom.operators import dictionary as D
from patchloom.operators import encode, linalg, stats
from patchloom.plans.pipeline import Component, ConvLayer
from patchloom.queries.inputs import ATOMS, COLOR, X, color_images, first_vectors, images, matrix_rows, r6, vectors


def _maps(spark, sf_dir):
    """Each vector as a 1 x 1 map of 64 channels."""
    return vectors(spark, sf_dir).select("vec_id", F.lit(1).alias("h"), F.lit(1).alias("w"), F.lit(64).alias("c"), F.col("x").alias("data"))


def _encode(kind, transpose=False, with_b=0, **more):
    def query(spark, sf_dir):
        atoms = first_vectors(spark, sf_dir, 4)
        b = None if not with_b else np.arange(64) / 100 if with_b == 64 else np.arange(4) / 10
        return long_form(encode.encoded(_maps(spark, sf_dir), kind, atoms.T if transpose else atoms, b, **more), "vec_id")

    return query


def _llc(spark, sf_dir):
    """Over two atoms the weights have a closed form."""
    return long_form(encode.encoded(_maps(spark, sf_dir), "llc", first_vectors(spark, sf_dir, 20), k=2), "vec_id")


def _whitened(zca):
    """The covariance that the transform was made of, rebuilt from its inverse."""

    def query(spark, sf_dir):
        w, _ = (D.zca if zca else D.pca)(vectors(spark, sf_dir), "x")
        back = np.linalg.inv(w)
        return matrix_rows(spark, (back @ back if zca else back.T @ back))

    return query


def i3(spark, sf_dir):
    got = D.kmeans(vectors(spark, sf_dir), "x", 4, max_iter=2, tol=0.0, ids="vec_id", init=first_vectors(spark, sf_dir, 4))
    return matrix_rows(spark, got.atoms)


def i4(spark, sf_dir):
    """Two rounds over unit rows."""
    return matrix_rows(spark, D.normalized_kmeans(vectors(spark, sf_dir), "x", 4, max_iter=2, tol=0.0, ids="vec_id", init=first_vectors(spark, sf_dir, 4)).atoms)


def i7(spark, sf_dir):
    """Three rounds, and the inertia before the last update."""
    got = D.kmeans(vectors(spark, sf_dir), "x", 4, max_iter=3, tol=0.0, ids="vec_id", init=first_vectors(spark, sf_dir, 4))
    return matrix_rows(spark, np.concatenate((got.atoms, np.full((1, 64), got.inertia))))


def i8(spark, sf_dir):
    return D.nearest_atom(vectors(spark, sf_dir), "x", first_vectors(spark, sf_dir, 10), "vec_id").select("vec_id", "cluster", (F.round("distance", 6) + F.lit(0.0)).alias("distance"))


def i9(spark, sf_dir):
    """With a far atom that gets no rows: it restarts from the row with the smallest draw."""
    atoms = np.concatenate((first_vectors(spark, sf_dir, 3), np.full((1, 64), 9.0)))
    return matrix_rows(spark, D.kmeans_step(vectors(spark, sf_dir), "x", atoms, "vec_id")[0])


def i10(spark, sf_dir):
    return D.strongest_atom(vectors(spark, sf_dir), "x", first_vectors(spark, sf_dir, 10), False, "vec_id").select("vec_id", "atom", (F.round("value", 6) + F.lit(0.0)).alias("value"))


def i11(spark, sf_dir):
    return matrix_rows(spark, D.omp1_step(vectors(spark, sf_dir), "x", first_vectors(spark, sf_dir, 4), "vec_id"))


def i12(spark, sf_dir):
    return matrix_rows(spark, D.omp1(vectors(spark, sf_dir), "x", 4, max_iter=2, tol=0.0, ids="vec_id", init=first_vectors(spark, sf_dir, 4)).atoms)


def i13(spark, sf_dir):
    out = D.pursuit(vectors(spark, sf_dir), "x", first_vectors(spark, sf_dir, 6), 2, "vec_id")
    return out.select("vec_id", F.col("step").cast("long").alias("step"), "atom", (F.round("value", 6) + F.lit(0.0)).alias("value"))


def i15(spark, sf_dir):
    """With one active atom a row the least squares have a closed form."""
    return matrix_rows(spark, D.ompn(vectors(spark, sf_dir), "x", 4, 1, max_iter=2, tol=0.0, ids="vec_id", init=first_vectors(spark, sf_dir, 4)).atoms)


def _pool(function, *args, color=False):
    def query(spark, sf_dir):
        return long_form(function(color_images(spark, sf_dir) if color else images(spark, sf_dir), *args), "id")

    return query


def p1_rows(spark, sf_dir):
    out = encode.spatial_pool_rows(images(spark, sf_dir), (3, 2), "max", "id")
    return out.select("id", (F.col("cell") + F.col("ch")).cast("long").alias("j"), (F.round("v", 6) + F.lit(0.0)).alias("v"))


def p8(spark, sf_dir):
    return matrix_rows(spark, K.gaussian_kernel(4, 1.5))


def p8_uniform(spark, sf_dir):
    return matrix_rows(spark, np.concatenate((K.uniform_kernel((3, 2)), K.uniform_kernel(2))))


def fused_layer() -> ConvLayer:
    """3 x 3 patches, mean and variance normalised, thresholded responses to four unit atoms, averaged over 2 x 2 cells."""
    return ConvLayer([
        Component("extract", {"kind": "patches", "size": [3, 3], "stride": 1}), Component("normalise", {"kind": "meanvar", "reg": 0.1}),
        Component("encode", {"kind": "threshold", "alpha": 0.25}, model=np.eye(4, 9)), Component("pool", {"kind": "spatial", "method": "ave", "grid": [2, 2]}),
    ])


def p9(spark, sf_dir):
    return long_form(ConvLayer.loaded(fused_layer().saved()).process(images(spark, sf_dir)), "id", vector="feature")


QUERIES = {
    "I1_pca": _whitened(False), "I2_zca": _whitened(True), "I3_kmeans_trainer": i3, "I4_normalized_kmeans": i4, "I7_kmeans": i7, "I8_e_step": i8, "I9_m_step": i9, "I10_omp1_predict": i10,
    "I11_omp1_maximize": i11, "I12_omp1": i12, "I13_omp_n_predict": i13, "I15_omp_n": i15,
    "J1_linear_bw": _encode("linear_bw", True, 64), "J2_linear_wb": _encode("linear_wb", True, 4), "J3_inner_product": _encode("inner"), "J4_vq": _encode("vq"),
    "J5_threshold": _encode("threshold", alpha=0.05), "J5_threshold_oneside": _encode("threshold", alpha=0.05, twoside=False), "J6_threshold_abs": _encode("threshold", alpha=0.05, twoside="abs"),
    "J7_relu": _encode("relu"), "J8_triangle": _encode("triangle"), "J9_llc": _llc,
    "P1_spatial_max": _pool(encode.spatial_pool, (2, 2), "max"), "P1_spatial_ave": _pool(encode.spatial_pool, (3, 3), "ave", color=True), "P1_spatial_rms": _pool(encode.spatial_pool, (2, 3), "rms"),
    "P1_spatial_rows": p1_rows,
    "P2_overcomplete_max": _pool(encode.overcomplete_pool, (2, 2), "max"), "P2_overcomplete_ave": _pool(encode.overcomplete_pool, (3, 3), "ave"),
    "P3_meta": _pool(encode.meta_pool, lambda x: K.spatial_pooled(x, (2, 2), "ave"), lambda x: K.spatial_pooled(x, (1, 1), "max")),
    "P4_pyramid": _pool(encode.pyramid_pool, 3, "max"), "P5_fixed_size": _pool(encode.fixed_size_pool, (3, 3), "ave"),
    "P6_kernel_ave": _pool(encode.kernel_pool, K.gaussian_kernel(3, 1.0), (2, 2), "ave"), "P7_kernel_max": _pool(encode.kernel_pool, K.gaussian_kernel(3, 1.0), (2, 2), "max", True),
    "P7_kernel_rms": _pool(encode.kernel_pool, K.gaussian_kernel(3, 1.0), (2, 2), "rms"), "P8_gaussian_kernel": p8, "P8_uniform_kernel": p8_uniform, "P8_uniform_pool": _pool(encode.kernel_pool, K.uniform_kernel((2, 3)), (2, 3), "ave", True), "P9_fused_layer": p9,
}

_MAX, _AVE, _RMS = "greatest(max(v), 0)", "avg(v)", "sqrt(avg(v * v))"


def _cells(gh: int, gw: int, v: str, source: str = "x", offset: int = 0) -> str:
    return f"select vec_id as id, {offset} + (r * {gh} // 8) * {gw} + c * {gw} // 8 as j, {r6(v)} as v from {source} group by vec_id, r * {gh} // 8, c * {gw} // 8"


def _rects(g: int, cell: str, v: str) -> str:
    return X + f""", cells as (select vec_id, r * {g} // 8 as a, c * {g} // 8 as b, {cell} as v from x group by vec_id, r * {g} // 8, c * {g} // 8),
spans as (select i, j from range({g}) s(i), range(1, {g + 1}) t(j) where i < j),
rects as (select row_number() over (order by p.i, p.j, q.i, q.j) - 1 as n, p.i as top, p.j as bottom, q.i as lef, q.j as righ from spans p, spans q)
select vec_id as id, n as j, {r6(v)} as v from cells join rects on a >= top and a < bottom and b >= lef and b < righ group by vec_id, n"""


def _kernel(v: str, grid: int) -> str:
    return X + f""", tiles as (select vec_id, p.i as p, q.i as q, v * exp(-((r - 2 * p.i - 1) * (r - 2 * p.i - 1) + (c - 2 * q.i - 1) * (c - 2 * q.i - 1)) / 2.0) as v
from x join range({grid}) p(i) on r between 2 * p.i and 2 * p.i + 2 join range({grid}) q(i) on c between 2 * q.i and 2 * q.i + 2)
select vec_id as id, p * {grid} + q as j, {r6(v)} as v from tiles group by vec_id, p, q"""


_P4 = ATOMS.format(k=4)
_STEP = """, near{n} as (select vec_id, min_by(k, (dist, k)) as k from (select x.vec_id, k, sum((v - d) * (v - d)) as dist from x join {atoms} using (j) group by x.vec_id, k) group by vec_id),
cent{n} as (select k, j, avg(v) as d from near{n} join x using (vec_id) group by k, j)"""
_OMP = """, hit{n} as (select vec_id, max_by(k, (abs(p), -k)) as k, max(abs(p)) as val from (select x.vec_id, k, sum(v * d) as p from x join {atoms} using (j) group by x.vec_id, k) group by vec_id),
raw{n} as (select k, j, sum(val * v) as d from hit{n} join x using (vec_id) group by k, j),
omp{n} as (select k, j, d / (sqrt(sum(d * d) over (partition by k)) + 2.220446049250313e-16) as d from raw{n})"""
#: One active atom a row: each atom is its members' sum, weighted by their signed responses, over the sum of these squared.
_LSQ = """, hit{n} as (select vec_id, max_by(k, (abs(p), -k)) as k, max_by(p, (abs(p), -k)) as val from (select x.vec_id, k, sum(v * d) as p from x join {atoms} using (j) group by x.vec_id, k) group by vec_id),
raw{n} as (select k, j, sum(val * v) / (sum(val * val) + 1e-8) as d from hit{n} join x using (vec_id) group by k, j),
omp{n} as (select k, j, d / (sqrt(sum(d * d) over (partition by k)) + 2.220446049250313e-16) as d from raw{n})"""
_COV = X + f", m as (select vec_id, j, v - avg(v) over (partition by j) as v from x) select a.j as i, b.j as j, {r6('avg(a.v * b.v)')} as v from m a join m b using (vec_id) group by a.j, b.j"
ORACLES = {
    "I1_pca": _COV, "I2_zca": _COV,
    "I4_normalized_kmeans": X.replace("list_transform(embedding, lambda e: e::double)", "list_transform(embedding, lambda e: e::double / sqrt(list_inner_product(embedding::double[], embedding::double[])))") + ", raw as (select vec_id as k, generate_subscripts(embedding, 1) - 1 as j, unnest(embedding)::double as d from embeddings), atoms as (select * from raw where k < 4)" + _STEP.format(n=1, atoms="atoms") + _STEP.format(n=2, atoms="cent1") + f"select k as i, j, {r6('d')} as v from cent2",
    "I7_kmeans": X + _P4 + _STEP.format(n=1, atoms="atoms") + _STEP.format(n=2, atoms="cent1") + _STEP.format(n=3, atoms="cent2") + f", least as (select sum(dist) as inertia from (select vec_id, min(dist) as dist from (select x.vec_id, k, sum((v - d) * (v - d)) as dist from x join cent2 using (j) group by x.vec_id, k) group by vec_id)) select k as i, j, {r6('d')} as v from cent3 union all select 4, j, {r6('inertia')} from least, range(64) t(j)",
    "I3_kmeans_trainer": X + _P4 + _STEP.format(n=1, atoms="atoms") + _STEP.format(n=2, atoms="cent1") + f"select k as i, j, {r6('d')} as v from cent2",
    "I8_e_step": X + ATOMS.format(k=10) + f"select vec_id, min_by(k, (dist, k))::integer as cluster, {r6('min(dist)')} as distance from dots group by vec_id",
    "I9_m_step": X + ATOMS.format(k=3) + _STEP.format(n=1, atoms="atoms") + f""", spare as (select vec_id from emb order by md5('42-' || vec_id), vec_id limit 1)
select k as i, j, {r6('d')} as v from cent1 union all select 3, j, {r6('v')} from x where vec_id in (select vec_id from spare)""",
    "I10_omp1_predict": X + ATOMS.format(k=10) + f"select vec_id, max_by(k, (abs(p), -k))::integer as atom, {r6('max(abs(p))')} as value from dots group by vec_id",
    "I11_omp1_maximize": X + _P4 + _OMP.format(n=1, atoms="atoms") + f"select k as i, j, {r6('d')} as v from omp1",
    "I12_omp1": X + _P4 + _OMP.format(n=1, atoms="atoms") + _OMP.format(n=2, atoms="omp1") + f"select k as i, j, {r6('d')} as v from omp2",
    "I13_omp_n_predict": X + ATOMS.format(k=6) + f""", one as (select vec_id, max_by(k, (abs(p), -k)) as k, max_by(p, (abs(p), -k)) as val from dots group by vec_id),
gram as (select a.k as k, b.k as l, sum(a.d * b.d) as g from atoms a join atoms b using (j) group by a.k, b.k),
left_ as (select vec_id, d.k, p - g * val as p from dots d join one o using (vec_id) join gram on gram.k = o.k and gram.l = d.k)
select vec_id, 0::bigint as step, k::integer as atom, {r6('val')} as value from one union all
select vec_id, 1, max_by(k, (abs(p), -k))::integer, {r6('max_by(p, (abs(p), -k))')} from left_ group by vec_id""",
    "I15_omp_n": X + _P4 + _LSQ.format(n=1, atoms="atoms") + _LSQ.format(n=2, atoms="omp1") + f"select k as i, j, {r6('d')} as v from omp2",
    "J1_linear_bw": X + _P4 + f"select x.vec_id, k as j, {r6('sum((v + x.j / 100) * d)')} as v from x join atoms using (j) group by x.vec_id, k",
    "J2_linear_wb": X + _P4 + f"select vec_id, k as j, {r6('p + k / 10')} as v from dots",
    "J3_inner_product": X + _P4 + f"select vec_id, k as j, {r6('p')} as v from dots",
    "J4_vq": X + _P4 + "select vec_id, k as j, case when k = min_by(k, (dist, k)) over (partition by vec_id) then 1.0::double else 0.0::double end as v from dots",
    "J5_threshold": X + _P4 + f"select vec_id, k + 4 * s as j, {r6('greatest(case when s = 0 then p else -p end - 0.05, 0)')} as v from dots, (select unnest([0, 1]) as s)",
    "J5_threshold_oneside": X + _P4 + f"select vec_id, k as j, {r6('greatest(p - 0.05, 0)')} as v from dots",
    "J6_threshold_abs": X + _P4 + f"select vec_id, k as j, {r6('greatest(abs(p) - 0.05, 0)')} as v from dots",
    "J7_relu": X + _P4 + f"select vec_id, k + 4 * s as j, {r6('greatest(case when s = 0 then p else -p end, 0)')} as v from dots, (select unnest([0, 1]) as s)",
    "J8_triangle": X + _P4 + f"select vec_id, k as j, {r6('greatest(avg(sqrt(dist)) over (partition by vec_id) - sqrt(dist), 0)')} as v from dots",
    "J9_llc": X + ATOMS.format(k=20) + f""", near as (select * from (select *, row_number() over (partition by vec_id order by dist, k) as rn from dots) where rn <= 2),
pair as (select p.vec_id, p.k as k1, q.k as k2, p.dist as a, q.dist as c, (p.dist + q.dist - g.between) / 2 as b from near p join near q on p.vec_id = q.vec_id and p.rn = 1 and q.rn = 2
join (select s.k as k, t.k as l, sum((s.d - t.d) * (s.d - t.d)) as between from atoms s join atoms t using (j) group by s.k, t.k) g on g.k = p.k and g.l = q.k),
told as (select *, c + 1e-4 * (a + c) - b as w1, a + 1e-4 * (a + c) - b as w2 from pair)
select vec_id, j, round(case when j = k1 then w1 / (w1 + w2) when j = k2 then w2 / (w1 + w2) else 0.0 end, 6) + 0.0 as v from told, range(20) t(j)""",
    "P1_spatial_max": X + _cells(2, 2, _MAX), "P1_spatial_rms": X + _cells(2, 3, _RMS), "P1_spatial_rows": X + _cells(3, 2, _MAX),
    "P1_spatial_ave": COLOR + f"select id, ((r * 3 // 8) * 3 + c * 3 // 8) * 3 + ch as j, {r6('avg(v)')} as v from col group by id, r * 3 // 8, c * 3 // 8, ch",
    "P2_overcomplete_max": _rects(2, _MAX, _MAX), "P2_overcomplete_ave": _rects(3, _AVE, _AVE),
    "P3_meta": X + _cells(2, 2, _AVE) + " union all " + _cells(1, 1, _MAX, offset=4),
    "P4_pyramid": X + " union all ".join(_cells(2**i, 2**i, _MAX, offset=o) for i, o in ((0, 0), (1, 1), (2, 5))),
    "P5_fixed_size": X + f"select vec_id as id, ((r - 1) // 3) * 2 + (c - 1) // 3 as j, {r6('avg(v)')} as v from x where r between 1 and 6 and c between 1 and 6 group by vec_id, (r - 1) // 3, (c - 1) // 3",
    "P6_kernel_ave": _kernel("avg(v)", 2), "P7_kernel_max": _kernel("max(v)", 3), "P7_kernel_rms": _kernel("sqrt(avg(v * v))", 2),
    "P8_uniform_kernel": "select a as i, b as j, 1.0::double as v from range(5) s(a), range(2) t(b)",
    "P8_uniform_pool": X + f"select vec_id as id, (r // 2) * 2 + (c - 1) // 3 as j, {r6('avg(v)')} as v from x where c between 1 and 6 group by vec_id, r // 2, (c - 1) // 3",
    "P8_gaussian_kernel": f"select a as i, b as j, {r6('exp(-((a - 2) * (a - 2) + (b - 2) * (b - 2)) / 4.5)')} as v from range(5) s(a), range(5) t(b)",
    "P9_fused_layer": X + f""", tiles as (select vec_id, p.i as p, q.i as q, (r - p.i) * 3 + c - q.i as e, v from x join range(6) p(i) on r between p.i and p.i + 2 join range(6) q(i) on c between q.i and q.i + 2),
norm as (select *, (v - avg(v) over w) / (stddev_pop(v) over w + 0.1) as z from tiles window w as (partition by vec_id, p, q)),
codes as (select vec_id, p // 3 as a, q // 3 as b, e + 4 * s as k, greatest(case when s = 0 then z else -z end - 0.25, 0) as v from norm, (select unnest([0, 1]) as s) where e < 4)
select vec_id as id, (a * 2 + b) * 8 + k as j, {r6('avg(v)')} as v from codes group by vec_id, a, b, k""",
}
