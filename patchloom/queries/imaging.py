"""2.C views, 2.D extractors, 2.F sampling, segments and mosaics."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchloom.functions.images import long_form
from patchloom.operators import extract, sampling, views
from patchloom.plans.pipeline import Component, ConvLayer
from patchloom.queries.inputs import X, images, r6, vectors
from patchloom.shared import table
from patchloom.sources.folders import sample_image


def c1(spark, sf_dir):
    return long_form(views.mirror_set(images(spark, sf_dir)), "id", "is_flipped")


def c2(spark, sf_dir):
    return long_form(views.resize_set(images(spark, sf_dir), (4, 4)), "id")


def c3(spark, sf_dir):
    return long_form(views.sub_image_set(images(spark, sf_dir), (5, 5), 3), "id", "part")


def c4(spark, sf_dir):
    return long_form(views.sub_image_set(images(spark, sf_dir).where("id = 7"), (5, 5), 3), "id", "part")


def c5(spark, sf_dir):
    return long_form(views.center_region_set(images(spark, sf_dir), (4, 4)), "id")


def _jitter(method, *amounts):
    def query(spark, sf_dir):
        return long_form(views.jitter_set(images(spark, sf_dir), 2, amounts, method), "id", "copy")

    return query


def c10(spark, sf_dir):
    rows = table(spark, sf_dir, "image_records").where("height > 0 and width > 0").select("image_id", "height", "width").distinct()
    shape = views.planned_shape(F.col("height"), F.col("width"), max_size=15, center_crop=12)
    small = views.planned_shape(F.col("height"), F.col("width"), min_size=-10)
    return rows.select("image_id", shape.alias("a"), small.alias("b")).select("image_id", "a.*", F.col("b.rh").alias("mh"), F.col("b.rw").alias("mw"))


def c10_pixels(spark, sf_dir):
    rows = table(spark, sf_dir, "image_records").where("height > 0 and width > 0 and size(raw_data) = height * width and not exists(raw_data, e -> e is null)")
    rows = rows.select(F.col("image_id").alias("id"), F.col("height").alias("h"), F.col("width").alias("w"), F.lit(1).alias("c"), F.col("raw_data").cast("array<double>").alias("data")).dropDuplicates(["id"])
    return views.manipulated(rows, max_size=15, center_crop=12).select("id", "h", "w", F.round(F.aggregate("data", F.lit(0.0), lambda s, v: s + v), 6).alias("total"))


def d3(spark, sf_dir):
    return long_form(extract.patch_maps(images(spark, sf_dir), 3, 2), "id")


def d4(spark, sf_dir):
    return long_form(extract.patch_rows(images(spark, sf_dir), 3, 2), "id", "part")


def d6(spark, sf_dir):
    return long_form(extract.oriented_gradients(images(spark, sf_dir)), "id")


def d7(spark, sf_dir):
    return long_form(extract.dense_sift(images(spark, sf_dir), 4, 2), "id")


def f1(spark, sf_dir):
    return sampling.reservoir(vectors(spark, sf_dir).select("vec_id", "label"), 137, "vec_id")


def f2(spark, sf_dir):
    out = sampling.location_sample(images(spark, sf_dir), 100, 0.25)
    return out.select("id", "row", "col", F.round(F.col("feature")[0], 6).alias("v"))


def f3(spark, sf_dir):
    out = sampling.patch_draws(_labelled(spark, sf_dir), 200, 3, 42, "label")
    return long_form(out, "draw", "id", "label", vector="feature")


def _labelled(spark, sf_dir):
    from patchloom.functions.images import images_from_vectors

    return images_from_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8, 8, 1, "label")


def f4(spark, sf_dir):
    layer = ConvLayer([Component("extract", {"kind": "patches", "size": [3, 3]}), Component("pool", {"kind": "spatial", "method": "max", "grid": [2, 2]})])
    return long_form(layer.sampled_output(images(spark, sf_dir), 50), "id", "row", "col", vector="feature")


def f6(spark, sf_dir):
    few = sampling.reservoir(vectors(spark, sf_dir), 50, "vec_id", seed=7)
    out = sampling.post_processed(few, x=F.transform("x", lambda v: v * v), label=F.col("label") % 2)
    return long_form(out, "vec_id", "label", vector="x")


def f7(spark, sf_dir):
    return sampling.minibatches(vectors(spark, sf_dir).select("vec_id"), 64, 1, "vec_id").select("vec_id", F.col("batch").cast("long").alias("batch"))


def f8(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id")
    return sampling.minibatches(rows, 1000, 0, "event_id").select("event_id", F.col("batch").cast("long").alias("batch"))


def r4(spark, sf_dir):
    n = table(spark, sf_dir, "embeddings").count()
    return vectors(spark, sf_dir).select("vec_id", sampling.segment(F.col("vec_id"), n, 7).alias("part"))


def r9(spark, sf_dir):
    """All vectors as patches side by side, in the order of their ids."""
    n = vectors(spark, sf_dir).count()
    out = extract.mosaic_cells(images(spark, sf_dir), F.col("id"), n)
    return out.select("i", "j", F.round("v", 6).alias("v"))


def a13(spark, sf_dir):
    return long_form(sample_image(spark, 32), "id")


def c10_cropped(spark, sf_dir):
    """Half the size, and the centre square, which is all of it."""
    return long_form(views.manipulated(images(spark, sf_dir), target_size=(4, 4), center_crop=4), "id")


QUERIES = {
    "C1_mirror_set": c1, "C2_resize_set": c2, "C3_sub_image_set": c3, "C4_sub_images_of_one": c4, "C5_center_region": c5, "C6_jitter_set": _jitter("normal", 0.0, 0.0, 0.0, 0.0), "C8_randn_jitter": _jitter("normal", 1.0, 1.0, 10.0, 0.2), "C9_rand_jitter": _jitter("uniform", 0.0, 0.0, 0.0, 0.0), "C9_rand_jitter_drawn": _jitter("uniform", 1.0, 1.0, 10.0, 0.2),
    "C10_planned_shape": c10, "C10_manipulated": c10_cropped, "C10_manipulated_sizes": c10_pixels, "A13_sample_image": a13, "D3_patches": d3, "D4_im2col_rows": d4, "D6_oriented_gradients": d6, "D7_dense_sift": d7,
    "F1_reservoir": f1, "F2_location_sample": f2, "F3_patch_draws": f3, "F4_layer_sample": f4, "F6_post_processed": f6, "F7_minibatches": f7, "F8_file_minibatches": f8,
    "R4_segments": r4, "R9_mosaic": r9,
}

_UNIT = "(('0x' || substr(md5('42-{what}-' || {id}), 1, {n}))::bigint)::double / {whole}::double"
ORACLES = {
    "C1_mirror_set": X + f"select vec_id as id, false as is_flipped, j, {r6('v')} as v from x union all select vec_id, true, r * 8 + 7 - c, {r6('v')} from x",
    "C2_resize_set": X + f"select vec_id as id, (r // 2) * 4 + c // 2 as j, {r6('avg(v)')} as v from x group by vec_id, r // 2, c // 2",
    "C3_sub_image_set": X + f"select vec_id as id, (a // 3) * 2 + b // 3 as part, (r - a) * 5 + c - b as j, {r6('v')} as v from x, (select unnest([0, 3])::bigint as a), (select unnest([0, 3])::bigint as b) where r between a and a + 4 and c between b and b + 4",
    "C5_center_region": X + f"select vec_id as id, (r - 2) * 4 + c - 2 as j, {r6('v')} as v from x where r between 2 and 5 and c between 2 and 5",
    "C10_planned_shape": """with s as (select distinct image_id, height as h, width as w from image_records where height > 0 and width > 0)
select image_id, case when greatest(h, w) > 15 then h * 15 // greatest(h, w) else h end as rh, case when greatest(h, w) > 15 then w * 15 // greatest(h, w) else w end as rw,
12 as oh, 12 as ow, h * 10 // least(h, w) as mh, w * 10 // least(h, w) as mw from s""",
    "D3_patches": X + f"select vec_id as id, ((a // 2) * 3 + b // 2) * 9 + (r - a) * 3 + c - b as j, {r6('v')} as v from x, (select unnest([0, 2, 4])::bigint as a), (select unnest([0, 2, 4])::bigint as b) where r between a and a + 2 and c between b and b + 2",
    "D4_im2col_rows": X + f"select vec_id as id, (a // 2) * 3 + b // 2 as part, (r - a) * 3 + c - b as j, {r6('v')} as v from x, (select unnest([0, 2, 4])::bigint as a), (select unnest([0, 2, 4])::bigint as b) where r between a and a + 2 and c between b and b + 2",
    "F1_reservoir": "select vec_id, label from embeddings order by md5('42-' || vec_id), vec_id limit 137",
    "F2_location_sample": X + f"""select vec_id as id, r::integer as row, c::integer as col, {r6('v')} as v from x
where {_UNIT.format(what='ratio', id="vec_id || '-' || j", n=8, whole=1 << 32)} < 0.25 order by md5('42-' || vec_id || '-' || j) limit 100""",
    "F3_patch_draws": X + f""", numbered as (select vec_id, label, row_number() over (order by md5('42-' || vec_id), vec_id) - 1 as rn from emb),
draws as (select i as draw, floor({_UNIT.format(what='image', id='i', n=12, whole=1 << 48)} * (select count(*) from emb)) as number,
floor({_UNIT.format(what='row', id='i', n=12, whole=1 << 48)} * 6) as a, floor({_UNIT.format(what='col', id='i', n=12, whole=1 << 48)} * 6) as b from range(200) t(i))
select draw, vec_id as id, x.label, ((r - a) * 3 + c - b)::bigint as j, {r6('v')} as v from draws join numbered on rn = number join x using (vec_id) where r between a and a + 2 and c between b and b + 2""",
    "F6_post_processed": X + f", few as (select vec_id from emb order by md5('7-' || vec_id), vec_id limit 50) select vec_id, label % 2 as label, j, {r6('v * v')} as v from x where vec_id in (select vec_id from few)",
    "F7_minibatches": "select vec_id, (row_number() over (order by md5('42-1-' || vec_id), vec_id) - 1) // 64 as batch from embeddings qualify batch < (select count(*) // 64 from embeddings)",
    "F8_file_minibatches": "select event_id, (row_number() over (order by md5('42-0-' || event_id), event_id) - 1) // 1000 as batch from events qualify batch < (select count(*) // 1000 from events)",
    "R4_segments": "with n as (select count(*) as n from embeddings) select vec_id, i::integer as part from embeddings, n, range(7) t(i) where vec_id >= n * i // 7 and vec_id < n * (i + 1) // 7",
    "R9_mosaic": X + """, n as (select count(*) as n, ceil(sqrt(count(*)))::bigint as cols from emb), cells as (select (vec_id // cols) * 9 + r as i, (vec_id % cols) * 9 + c as j, v from x, n),
grid as (select a.i, b.j from (select unnest(range((select max(i) + 1 from cells))) as i) a, (select unnest(range((select max(j) + 1 from cells))) as j) b), filled as (select i, j, coalesce(v, (select avg(v) from x)) as v from grid left join cells using (i, j)),
ends as (select min(v) as lo, max(v) as hi from filled) select i, j, round((v - lo) / (hi - lo + 2.220446049250313e-16), 6) as v from filled, ends""",
    "A13_sample_image": f"select 0::bigint as id, r * 32 + c as j, {r6('(r + c) * 255 / 124.0::double + case when (r // 8 + c // 8) % 2 = 0 then 127.5 else 0 end')} as v from range(32) a(r), range(32) b(c)",
}
ORACLES["C10_manipulated"] = ORACLES["C2_resize_set"]
ORACLES["C6_jitter_set"] = ORACLES["C9_rand_jitter"] = X + f"select vec_id as id, t.copy::integer as copy, j, {r6('v')} as v from x, range(3) t(copy)"
ORACLES["C4_sub_images_of_one"] = ORACLES["C3_sub_image_set"] + " and vec_id = 7"
#: o: the oriented gradient of each place and angle; filters as in D5, true convolution, edges repeated.
_GRADIENTS = X + """, g as (select i, j, exp(-((i - 2) * (i - 2) + (j - 2) * (j - 2)) / 2.0) as v from range(5) s(i), range(5) t(j)), n as (select i, j, v / sum(v) over () as v from g),
fh as (select i, j, 2 * d / sum(abs(d)) over () as d from (select a.i, a.j, (b.v - c.v) / (b.i - c.i) as d from n a join n b on b.j = a.j and b.i = least(a.i + 1, 4) join n c on c.j = a.j and c.i = greatest(a.i - 1, 0))),
fw as (select i, j, 2 * d / sum(abs(d)) over () as d from (select a.i, a.j, (b.v - c.v) / (b.j - c.j) as d from n a join n b on b.i = a.i and b.j = least(a.j + 1, 4) join n c on c.i = a.i and c.j = greatest(a.j - 1, 0))),
places as (select r, c, i, j, least(greatest(r - (i - 2), 0), 7) as sr, least(greatest(c - (j - 2), 0), 7) as sc, fh.d as h, fw.d as w from range(8) p(r), range(8) q(c), fh join fw using (i, j)),
grad as (select vec_id, p.r, p.c, sum(v * h) as dh, sum(v * w) as dw from places p join x on x.r = sr and x.c = sc group by vec_id, p.r, p.c),
o as (select vec_id, r, c, a, sqrt(dh * dh + dw * dw) * greatest(pow(cos(atan2(dh, dw) - a * pi() / 4), 9), 0) as v from grad, range(8) t(a))
"""
ORACLES["D6_oriented_gradients"] = _GRADIENTS + f"select vec_id as id, (r * 8 + c) * 8 + a as j, {r6('v')} as v from o"
# with 4 x 4 patches a cell is a pixel
ORACLES["D7_dense_sift"] = _GRADIENTS + f""", feats as (select vec_id, p.i as p, q.i as q, ((r - 2 * p.i) * 4 + c - 2 * q.i) * 8 + a as e, v from o join range(3) p(i) on r between 2 * p.i and 2 * p.i + 3 join range(3) q(i) on c between 2 * q.i and 2 * q.i + 3),
cut as (select *, least(v / greatest(len, 1.0), 0.2) as z from (select *, sqrt(sum(v * v) over (partition by vec_id, p, q)) as len from feats))
select vec_id as id, (p * 3 + q) * 128 + e as j, {r6('case when len >= 1.0 then z / sqrt(sum(z * z) over (partition by vec_id, p, q)) else z end')} as v from cut"""
ORACLES["F4_layer_sample"] = X + f""", few as (select vec_id, cell from emb, range(4) t(cell) order by md5('42-' || vec_id || '-' || cell), vec_id, cell limit 50),
tiles as (select f.vec_id, cell, (r - p) * 3 + c - q as j, v from few f, range(6) a(p), range(6) b(q), x where x.vec_id = f.vec_id and p // 3 = cell // 2 and q // 3 = cell % 2 and r between p and p + 2 and c between q and q + 2)
select vec_id as id, (cell // 2)::integer as row, (cell % 2)::integer as col, j, {r6('greatest(max(v), 0)')} as v from tiles group by vec_id, cell, j"""
