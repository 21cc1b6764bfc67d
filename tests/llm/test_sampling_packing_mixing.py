from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchloom.llm.mixing import Node, clean_language, clean_source, exact_total, mixed, select_by_tree, spend, tree_of
from patchloom.llm.packing import Windows, fill_report, packed
from patchloom.llm.sampling import fixed_size_sample, sample_keys
from patchloom.llm.tokens import encoder, token_sizes


# --- sampling -----------------------------------------------------------------------------------------------------


def records(spark, ids):
    return spark.createDataFrame([(i, f"v{i}", 0, "k") for i in ids], "rec long, value string, id int, sample_key string")


def test_sample_is_of_fixed_size_and_counts_ids_once(spark, parts):
    ids = [i for i in range(500) for _ in range(1 + (i % 5) * (i % 3))] + [None] * 40
    out = fixed_size_sample(records(spark, ids).repartition(parts), "rec", 50).collect()
    assert len(out) == 50 == len({r["rec"] for r in out})
    assert {r["rec"] for r in out} == {r["id"] for r in sample_keys(records(spark, range(500)), "rec", 50, 42).collect()}
    assert all(r["value"] == f"v{r['rec']}" for r in out)


def test_every_id_is_equally_likely(spark):
    """Over many seeds each of 40 ids is drawn about equally often, though some are delivered ten times."""
    ids = spark.createDataFrame([(i,) for i in range(40) for _ in range(10 if i < 5 else 1)], "rec long").coalesce(2).persist()
    seen = Counter(r["id"] for seed in range(60) for r in sample_keys(ids, "rec", 10, seed).collect())
    often = np.array([seen[i] for i in range(40)])
    assert often.sum() == 600 and often[:5].mean() < 22 and ((often - 15) ** 2 / (15 * 0.75)).sum() < 75  # chi square, 39 degrees


def test_small_and_empty_samples(spark):
    assert fixed_size_sample(records(spark, [3, 3, 4]), "rec", 10).count() == 2
    assert fixed_size_sample(records(spark, []), "rec", 10).count() == 0
    assert fixed_size_sample(records(spark, [1, 2]), "rec", 0).count() == 0
    with pytest.raises(ValueError):
        sample_keys(records(spark, []), "rec", -1, 0)


def test_samples_of_pieces_merge(spark):
    whole = {r["id"] for r in sample_keys(records(spark, range(1000)), "rec", 30, 1).collect()}
    pieces = [sample_keys(records(spark, range(at, at + 250)), "rec", 30, 1) for at in range(0, 1000, 250)]
    all_ = pieces[0]
    for p in pieces[1:]:
        all_ = all_.union(p)
    assert {r["id"] for r in all_.orderBy("sample_key").limit(30).collect()} == whole


# --- packing ------------------------------------------------------------------------------------------------------


def items(spark, sizes):
    return spark.createDataFrame([(i, n, "x", 5) for i, n in enumerate(sizes)], "doc_id long, n_tokens long, container string, used int")


@pytest.mark.parametrize("windows", [1, 4, 64])
def test_containers_hold_every_item_once(spark, parts, windows):
    rng = np.random.default_rng(windows)
    sizes = [int(x) for x in rng.lognormal(4, 1, 800)] + [0, 0, 100, 200, 1000, 100 * 7 + 1] + [None]
    out = packed(items(spark, sizes).repartition(parts), 100, windows).collect()
    by_doc, used = {}, Counter()
    for r in out:
        by_doc.setdefault(r["doc_id"], []).append((r["piece_no"], r["start_token"], r["n_tokens"]))
        used[r["container_id"]] += r["n_tokens"]
    assert max(used.values()) <= 100
    assert by_doc.keys() == {i for i, n in enumerate(sizes) if n is not None}
    for i, pieces in by_doc.items():
        pieces.sort()
        assert [p[0] for p in pieces] == list(range(len(pieces))) and sum(p[2] for p in pieces) == sizes[i]
        assert all(p[1] == 100 * p[0] for p in pieces) and (sizes[i] > 100 or len(pieces) == 1)


def test_little_space_is_unused(spark):
    rng = np.random.default_rng(9)
    out = packed(items(spark, [int(x) for x in rng.integers(1, 1200, 5000)]), 2048)
    r = fill_report(out).first()
    assert r["fill"] > 0.97 and r["containers"] <= r["least_containers"] * 1.03 and r["fullest"] <= 2048


def test_merging_goes_over_many_tasks(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    try:
        one = fill_report(packed(items(spark, [30] * 300), 100, 4, merged=2)).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert one["tokens"] == 9000 and one["containers"] <= 110


def test_packing_nothing(spark):
    assert packed(items(spark, []), 10).count() == 0
    assert fill_report(packed(items(spark, []), 10)).first()["containers"] == 0
    with pytest.raises(ValueError):
        packed(items(spark, []), 0)


def test_windows_are_bounded_and_best_fit():
    w = Windows(10, 2)
    assert [w.place(6), w.place(7), w.place(3), w.place(4)] == [0, 1, 1, 0]
    assert w.open == [] and w.place(9) == 2
    w.place(8), w.place(8)
    assert len(w.open) == 2


# --- mixing -------------------------------------------------------------------------------------------------------


def sizes_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, n_tokens long, lang string, source string, order string, rest int")


def targets_of(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def test_shares_are_reached(spark, parts):
    rng = np.random.default_rng(1)
    rows = [(i, int(rng.integers(1, 60)), ["en", "EN", "en-x", None, "de"][i % 5], ["big", " BIG", "small-one", "other", None][i % 5 if i % 7 else 2]) for i in range(6000)]
    selection, report = mixed(sizes_of(spark, rows).repartition(parts), targets_of(spark, [("big", 0.5, 1), ("small_one", 0.5, 3)]))
    got = {r["source"]: r for r in report.collect()}
    assert all(abs(r["actual_share"] - 0.5) < 0.01 and r["most_uses"] <= r["max_repeats"] for r in got.values())
    chosen = {r["doc_id"]: r for r in selection.collect()}
    assert len(chosen) == selection.count() and {r["source"] for r in chosen.values()} == {"big", "small_one"}
    assert sum(r["n_tokens"] * r["uses"] for r in chosen.values()) == sum(r["tokens"] for r in got.values())
    uses = [r["uses"] for r in chosen.values() if r["source"] == "small_one"]
    assert max(uses) - min(uses) <= 1  # whole epochs before the next one


def test_a_total_beyond_a_source_is_shared_by_the_others(spark):
    rows = [(i, 10, "en", "a" if i < 10 else "b") for i in range(1000)]
    _, report = mixed(sizes_of(spark, rows), targets_of(spark, [("a", 0.5, 2), ("b", 0.4, 1), ("c", 0.1, 5)]), total=3000)
    got = {r["source"]: r["tokens"] for r in report.collect()}
    assert got["a"] == 200 and abs(got["b"] - 2800) <= 10 and got["c"] == 0


def test_shortages_go_to_siblings_before_ancestors():
    poor, rich = Node("poor", 1, size=10), Node("rich", 1, size=1000)
    a, b = Node("a", 1, [poor, rich]), Node("b", 1, [Node("x", 1, size=1000)])
    root = Node("all", 1, [a, b])
    spend(root, 400)
    assert (poor.budget, rich.budget, b.budget) == (10, 190, 200)
    spend(root, 2010)
    assert (poor.budget, rich.budget, b.budget) == (10, 1000, 1000)
    assert exact_total(root) == 2000


def test_a_tree_of_three_levels(spark, parts):
    """Weights on domains and, in one of them, on languages; the rest by tokens; one source may repeat."""
    rows = [(i, 10, ["code", "mail"][i % 2], ["en", "de"][i // 2 % 2], ["a", "b", "c"][i % 3]) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, n_tokens long, domain string, language string, src string").repartition(parts)
    weights = {("code",): 3.0, ("mail",): 1.0, ("mail", "de"): 1.0, ("mail", "en"): 4.0}
    out = select_by_tree(docs, ["domain", "language", "src"], weights, {("code",): 2}, total=16000).collect()
    got = Counter()
    for r in out:
        got[(r["domain"], r["language"])] += r["n_tokens"] * r["uses"]
    assert abs(got[("code", "en")] - 6000) <= 20 and abs(got[("code", "de")] - 6000) <= 20
    assert abs(got[("mail", "en")] - 3200) <= 20 and abs(got[("mail", "de")] - 800) <= 20
    assert {r["uses"] for r in out if r["domain"] == "mail"} == {1}


def test_children_without_a_weight_beside_weighted_ones_take_no_part():
    root = tree_of([(("a", "x"), 10), (("b", "x"), 10)], {("a",): 1.0}, {})
    spend(root, 100)
    assert {path: n.budget for path, n in root.leaves()} == {("all", "a", "x"): 10, ("all", "b", "x"): 0}


def test_mixing_nothing(spark):
    selection, report = mixed(sizes_of(spark, []), targets_of(spark, [("a", 1.0, 1)]))
    assert selection.count() == 0 and [r["tokens"] for r in report.collect()] == [0]
    selection, report = mixed(sizes_of(spark, [(1, None, "en", "a"), (None, 4, "en", "a"), (2, 5, None, None)]), targets_of(spark, []))
    assert selection.count() == 0 and report.count() == 0


def test_spellings(spark):
    rows = spark.createDataFrame([(" Forge-Mirror ", "EN"), ("x", "en-x"), (None, None), ("", "  ")], "s string, l string")
    assert [tuple(r) for r in rows.select(clean_source(F.col("s")), clean_language(F.col("l"))).collect()] == [("forge_mirror", "en"), ("x", "en"), (None, "und"), ("", "und")]


# --- tokens -------------------------------------------------------------------------------------------------------


def test_token_sizes(spark):
    texts = ["", "hello world", "<|endoftext|>", "漢字 😀\n\n", "a b" * 30_000, None]
    docs = spark.createDataFrame([(i, t, "en", 1) for i, t in enumerate(texts)] + [(1, "hello world", "en", 1), (None, "x", "en", 1)], "doc_id long, text string, lang string, n_tokens int")
    tokenizer = encoder("/opt/tokenizers/byte_bpe_50k.tiktoken")
    got = {r["doc_id"]: r["n_tokens"] for r in token_sizes(docs, keep=("lang",)).collect()}
    assert got == {i: len(tokenizer.encode_ordinary(t)) for i, t in enumerate(texts) if t is not None}
    for t in texts[:-1]:
        assert tokenizer.decode(tokenizer.encode_ordinary(t)) == t


def test_sources_without_tokens_leave_the_mix_to_the_others(spark):
    rows = [(i, 10, "en", "a") for i in range(60)] + [(100 + i, 10, "en", "b") for i in range(30)] + [(200, 0, "en", "empty")]
    _, report = mixed(sizes_of(spark, rows), targets_of(spark, [("a", 0.4, 1), ("b", 0.2, 1), ("empty", 0.2, 1), ("absent", 0.2, 1)]))
    have = {r["source"]: (r["tokens"], round(r["actual_share"], 6)) for r in report.collect()}
    assert have == {"a": (600, 0.666667), "b": (300, 0.333333), "empty": (0, 0.0), "absent": (0, 0.0)}
