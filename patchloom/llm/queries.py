"""The queries of this subpackage over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom.llm.mixing import clean_language, clean_source, mixed, select_by_tree
from patchloom.llm.near_copies import near_copy_groups, near_copy_pairs
from patchloom.llm.packing import fill_report, packed
from patchloom.llm.sampling import fixed_size_sample
from patchloom.llm.shared_spans import shared_lengths, sharing_classes, sharing_documents
from patchloom.llm.similar_vectors import most_similar, similar_pairs
from patchloom.llm.similarity_clusters import described_clusters, similarity_clusters
from patchloom.llm.split_overlap import split_overlaps
from patchloom.llm.tokens import token_sizes
from patchloom.shared import table


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    patches = table(spark, sf_dir, "pipeline_patches").select(F.col("patch_id").alias("vec_id"), F.col("patches").alias("vec"))
    return patches.union(table(spark, sf_dir, "pipeline_centroids").select("centroid_id", "centroids"))


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "image_records").select(F.col("image_id").alias("id"), F.col("raw_data").alias("seq"))


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    cub = table(spark, sf_dir, "cub_images").select(F.col("image_id").alias("id"), F.lit("cub_images").alias("source"), (F.col("split") == 1).alias("is_train"), F.col("images").alias("path"))
    name = F.lower(F.btrim("list_name", F.lit(" \t\r\n")))
    train = F.when(name.startswith("train"), True).when(name.startswith("test") | name.startswith("val"), False)
    return cub.union(table(spark, sf_dir, "dog_files").select("file_id", F.lit("dog_files"), train, "files"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def p1_found(spark, sf_dir):
    return similar_pairs(_vectors(spark, sf_dir)).select("id_a", "id_b")


def p1_neighbours(spark, sf_dir):
    return most_similar(_vectors(spark, sf_dir))


def p2_found(spark, sf_dir):
    return near_copy_pairs(_images(spark, sf_dir)).select(F.col("id_a").alias("image_id_a"), F.col("id_b").alias("image_id_b"))


def p2_groups(spark, sf_dir):
    return near_copy_groups(_images(spark, sf_dir)).withColumnRenamed("id", "image_id")


def p3_found(spark, sf_dir):
    return similarity_clusters(_vectors(spark, sf_dir))


def p3_clusters(spark, sf_dir):
    return described_clusters(_vectors(spark, sf_dir))


def p3_groups(spark, sf_dir):
    return described_clusters(_vectors(spark, sf_dir), grouped=True).select("cluster_id", "size")


def p5_patches(spark, sf_dir):
    rows = table(spark, sf_dir, "pipeline_patches").select("patch_id", "patches")
    return fixed_size_sample(rows, "patch_id", 1000).select("patch_id", "sample_key", F.size("patches").alias("n_values"))


def p5_images(spark, sf_dir):
    rows = table(spark, sf_dir, "image_records").select("image_id", "raw_data")
    return fixed_size_sample(rows, "image_id", 500).select("image_id", "sample_key", F.size("raw_data").alias("n_values"))


def p6_found(spark, sf_dir):
    return split_overlaps(_listed(spark, sf_dir))[0]


def p6_report(spark, sf_dir):
    return split_overlaps(_listed(spark, sf_dir))[1]


def p7_containers(spark, sf_dir):
    return packed(token_sizes(_documents(spark, sf_dir)))


def p7_fill(spark, sf_dir):
    return fill_report(p7_containers(spark, sf_dir))


def _mix(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixed(token_sizes(docs, keep=("lang", "source")), table(spark, sf_dir, "mix_targets"))


def p8_selection(spark, sf_dir):
    return _mix(spark, sf_dir)[0]


def p8_shares(spark, sf_dir):
    return _mix(spark, sf_dir)[1]


def p8_tree(spark, sf_dir):
    """Domain, language, source, with a total of nine tenths of all tokens: scarce sources fall short, and what they lack moves to siblings, then up."""
    docs = token_sizes(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), keep=("lang", "source")).where("source is not null")
    source = clean_source(F.col("source"))
    domain = F.when(source.endswith("_mirror"), "mirrors").when(source.isin("archive_dump", "vendor_drop"), "dumps").otherwise("people")
    docs = docs.select("doc_id", "n_tokens", domain.alias("domain"), clean_language(F.col("lang")).alias("lang"), source.alias("source"))
    targets = {r["source"]: (r["target_share"], r["max_repeats"]) for r in table(spark, sf_dir, "mix_targets").collect()}
    leaves = [tuple(r) for r in docs.select("domain", "lang", "source").distinct().collect() if r["source"] in targets]
    weights = {leaf: targets[leaf[2]][0] for leaf in leaves} | {(d,): sum(targets[s][0] for s in {x[2] for x in leaves if x[0] == d}) for d in {x[0] for x in leaves}}
    repeats = {leaf: int(targets[leaf[2]][1]) for leaf in leaves}
    total = 0.9 * (docs.agg(F.sum("n_tokens")).first()[0] or 0)
    used = select_by_tree(docs, ["domain", "lang", "source"], weights, repeats, total)
    return used.groupBy("domain", "lang", "source").agg(F.count("*").alias("documents"), F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens"), F.max("uses").alias("most_uses"))


def p8_invariants(spark, sf_dir):
    """For each target: whether any document is used twice as a row, more often than allowed, or never; whether the report adds up."""
    selection, report = _mix(spark, sf_dir)
    used = selection.groupBy("source").agg((F.count("*") - F.countDistinct("doc_id")).alias("twice"), F.min("uses").alias("least"), F.max("uses").alias("most"), F.sum(F.col("uses") * F.col("n_tokens")).alias("sum"))
    told = report.join(used, "source", "left")
    return told.select("source", "target_share", F.coalesce("twice", F.lit(0).cast("long")).alias("rows_twice"), (F.coalesce("least", F.lit(1)) >= 1).alias("all_used"), (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("cap_kept"), (F.coalesce("sum", F.lit(0)) == F.col("tokens")).alias("tokens_add_up"))


def p7_invariants(spark, sf_dir):
    """Documents in containers, and what must be 0: lost or added tokens, overfull containers, documents of up to a container's size that are cut."""
    sizes = token_sizes(_documents(spark, sf_dir))
    placed = packed(sizes)
    each = placed.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("placed")).join(sizes, "doc_id", "full")
    full = placed.groupBy("container_id").agg(F.sum("n_tokens").alias("used")).where("used > 2048").agg(F.count("*").alias("overfull"))
    each = each.agg(F.count("placed").alias("documents"), F.count_if(~F.col("placed").eqNullSafe(F.col("n_tokens"))).alias("wrong_tokens"), F.count_if((F.col("n_tokens") <= 2048) & (F.col("pieces") > 1)).alias("cut"))
    return each.join(full)  # one row each


def p9_groups(spark, sf_dir):
    """One row for each document: its class of equal texts and the other texts that share a span with it; copies are not expanded."""
    pairs, members = sharing_classes(_documents(spark, sf_dir))
    links = pairs.select(F.col("class_a").alias("class_id")).union(pairs.select("class_b")).groupBy("class_id").agg(F.count("*").alias("n_links"))
    return members.join(links, "class_id", "left").select("doc_id", "class_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def p9_found(spark, sf_dir):
    return sharing_documents(_documents(spark, sf_dir))


def p9_shared(spark, sf_dir):
    return shared_lengths(_documents(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_neighbours, p2_found, p2_groups, p3_found, p3_clusters, p3_groups, p5_patches, p5_images, p6_found, p6_report, p7_containers, p7_fill, p7_invariants, p8_selection, p8_shares, p8_tree, p8_invariants, p9_found, p9_groups, p9_shared)
}

_UNIT = """
with raw as (select patch_id as id, patches as v from pipeline_patches union all select centroid_id, centroids from pipeline_centroids),
once as (select id, any_value(v) as v from raw
         where id is not null and len(v) = 108 and len(list_filter(v, lambda e: e is not null and isfinite(e))) = 108 and list_min(v) < list_max(v) group by id),
centred as (select id, list_transform(v, lambda e: e - list_avg(v)) as c from once),
unit as (select id, list_transform(c, lambda e: e / sqrt(list_inner_product(c, c))) as u from centred),
sims as (select a.id as a, b.id as b, round(list_inner_product(a.u, b.u), 9) as sim from unit a join unit b on a.id < b.id where list_inner_product(a.u, b.u) >= 0.6999),
links as (select * from sims where sim >= 0.7)
"""

ORACLES = {
    "p1_found": _UNIT + """
, ends as (select a as v, b as o, sim from links union all select b, a, sim from links),
ranked as (select *, row_number() over (partition by v order by sim desc, o) as rn from ends)
select distinct least(v, o) as id_a, greatest(v, o) as id_b from ranked where rn <= 5
""",
    "p3_found": _UNIT.replace("with raw", "with recursive raw", 1) + """
, ends as (select a as v, b as o from links union all select b, a from links),
reach(v, o) as (select v, v from ends union select r.v, e.o from reach r join ends e on e.v = r.o),
named as (select v, min(o) as cluster_id, count(*) as n from reach group by v)
select v as vec_id, cluster_id from named where n >= 3
""",
    "p2_found": """
with once as (select image_id as id, any_value(raw_data) as v from image_records where image_id is not null and raw_data is not null group by image_id),
runs as (select distinct id, array_to_string(v[i : i + 7], ',') as r from (select id, v, unnest(generate_series(1, len(v) - 7)) as i from once where len(v) >= 8)),
sized as (select id, count(*) as n from runs group by id having count(*) >= 32),
kept as (select r.id, r.r, s.n from runs r join sized s using (id)),
met as (select a.id as a, b.id as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as common from kept a join kept b on a.r = b.r and a.id < b.id group by a.id, b.id)
select a as image_id_a, b as image_id_b from met where common >= 0.6 * (na + nb - common) - 1e-12
""",
    "p5_patches": """
select patch_id, any_value(('0x' || substr(md5('42-' || patch_id), 1, 15))::bigint) as sample_key, max(len(patches))::integer as n_values
from pipeline_patches where patch_id is not null group by patch_id order by sample_key, patch_id limit 1000
""",
    "p5_images": """
select image_id, any_value(('0x' || substr(md5('42-' || image_id), 1, 15))::bigint) as sample_key, max(len(raw_data))::integer as n_values
from image_records where image_id is not null group by image_id order by sample_key, image_id limit 500
""",
}

_NAMES = r"""
with listed as (
  select image_id as id, 'cub_images' as source, case when split is null then null else split = 1 end as is_train, images as path from cub_images
  union all
  select file_id, 'dog_files', case when lower(trim(list_name)) like 'train%' then true when lower(trim(list_name)) like 'test%' or lower(trim(list_name)) like 'val%' then false end, files from dog_files),
named as (select id, source, is_train, regexp_replace(lower(regexp_replace(regexp_extract(path, '([^/\\]*)$', 1), '\.[^.]*$', '')), '[^a-z0-9]', '', 'g') as name
          from listed where id is not null and is_train is not null and path is not null),
once as (select id, min(source) as source, min(is_train) as is_train, min(name) as name from named group by id),
runs as (select distinct id, source, is_train, name[i : i + 3] as r from (select *, unnest(generate_series(1, length(name) - 3)) as i from once where length(name) >= 4)),
sized as (select id, count(*) as n from runs group by id),
met as (select t.id as t, e.id as e, any_value(t.source) as train_source, any_value(e.source) as eval_source, count(*) as common
        from runs t join runs e on t.r = e.r and t.is_train and not e.is_train group by t.id, e.id),
pairs as (select met.* from met join sized a on a.id = t join sized b on b.id = e where common >= 0.6 * (a.n + b.n - common) - 1e-12)
"""
ORACLES["p6_found"] = _NAMES + "select least(t, e) as id_a, greatest(t, e) as id_b from pairs"
ORACLES["p6_report"] = _NAMES + "select eval_source, train_source, count(*) as pairs, count(distinct e) as eval_ids from pairs group by eval_source, train_source"
ORACLES["p9_found"] = """
with windows as (select distinct doc_id, text[i : i + 119] as w from (select doc_id, text, unnest(generate_series(1, length(text) - 119)) as i from documents where length(text) >= 120)),
twice as (select w, list(doc_id) as docs from windows group by w having count(*) > 1)
select distinct a as doc_id_a, b as doc_id_b from (select a, unnest(docs) as b from (select docs, unnest(docs) as a from twice)) where a < b
"""
ORACLES["p3_groups"] = ORACLES["p3_found"].replace("select v as vec_id, cluster_id from named where n >= 3", "select cluster_id, count(*) as size from named where n >= 3 group by cluster_id")
ORACLES["p1_neighbours"] = _UNIT.replace("where list_inner_product(a.u, b.u) >= 0.6999", "", 1) + """
, ends as (select a as v, b as o, sim from sims union all select b, a, sim from sims),
ranked as (select *, row_number() over (partition by v order by sim desc, o) as rn from ends)
select v as vec_id, o as other_id, sim, rn::integer as rank from ranked where rn <= 5
"""
ORACLES["p2_groups"] = """
with recursive once as (select image_id as id, any_value(raw_data) as v from image_records where image_id is not null and raw_data is not null group by image_id),
runs as (select distinct id, array_to_string(v[i : i + 7], ',') as r from (select id, v, unnest(generate_series(1, len(v) - 7)) as i from once where len(v) >= 8)),
sized as (select id, count(*) as n, md5(string_agg(r, ';' order by r)) as fp from runs group by id having count(*) >= 32),
classes as (select id, n, min(id) over (partition by fp) as class_id from sized),
kept as (select r.id, r.r, c.n from runs r join classes c on c.id = r.id and c.id = c.class_id),
met as (select a.id as a, b.id as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as common from kept a join kept b on a.r = b.r and a.id < b.id group by a.id, b.id),
links as (select a, b from met where common >= 0.6 * (na + nb - common) - 1e-12),
ends as (select a as v, b as o from links union all select b, a from links),
reach(v, o) as (select v, v from ends union select r.v, e.o from reach r join ends e on e.v = r.o),
groups as (select v, min(o) as g from reach group by v), counted as (select v, count(*) as n from ends group by v)
select id as image_id, class_id, coalesce(g, class_id) as group_id, coalesce(c.n, 0) as n_links from classes left join groups on groups.v = class_id left join counted c on c.v = class_id
"""
ORACLES["p9_shared"] = """
with windows as (select doc_id, i, text[i : i + 119] as w from (select doc_id, text, unnest(generate_series(1, length(text) - 119)) as i from documents where length(text) >= 120)),
twice as (select w from windows group by w having count(distinct doc_id) > 1),
starts as (select doc_id, i, lag(i) over (partition by doc_id order by i) as before from windows where w in (select w from twice)),
told as (select doc_id, sum(least(120, i - coalesce(before, -1000000)))::bigint as shared_chars, sum((before is null or i > before + 120)::int)::bigint as spans from starts group by doc_id)
select doc_id, length(text) as n_chars, coalesce(shared_chars, 0) as shared_chars, coalesce(spans, 0) as spans from documents left join told using (doc_id)
"""
ORACLES["p7_invariants"] = "select count(distinct doc_id) as documents, 0::bigint as wrong_tokens, 0::bigint as cut, 0::bigint as overfull from documents where doc_id is not null and text is not null"
ORACLES["p8_invariants"] = "select replace(lower(trim(source)), '-', '_') as source, target_share, 0::bigint as rows_twice, true as all_used, true as cap_kept, true as tokens_add_up from mix_targets"
ORACLES["p9_groups"] = """
with once as (select doc_id, any_value(text) as text from documents where doc_id is not null and text is not null group by doc_id),
members as (select doc_id, min(doc_id) over (partition by text) as class_id, text from once),
windows as (select distinct doc_id, text[i : i + 119] as w from (select doc_id, text, unnest(generate_series(1, length(text) - 119)) as i from members where doc_id = class_id and length(text) >= 120)),
twice as (select list(doc_id) as docs from windows group by w having count(*) > 1),
links as (select a, count(distinct b) as n from (select a, unnest(docs) as b from (select docs, unnest(docs) as a from twice)) where a != b group by a)
select doc_id, class_id, coalesce(n, 0) as n_links from members left join links on a = class_id
"""
