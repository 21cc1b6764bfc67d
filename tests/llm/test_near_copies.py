import itertools

import numpy as np
import pytest

from patchloom.llm.components import components
from patchloom.llm.near_copies import near_copy_groups, near_copy_pairs, pack, run_set, unpack

SCHEMA = "id long, seq array<int>, run int, packed string, n double"


def frame(spark, rows):
    return spark.createDataFrame([(i, s, 1, "x", 2.0) for i, s in rows], SCHEMA)


def made(seed=0, most=256):
    rng = np.random.default_rng(seed)
    rows, border = [], rng.integers(0, most, 40).tolist()
    for base in range(12):
        s = rng.integers(0, most, 150).tolist()
        rows.append((base * 100, s))
        for e in range(4):
            t = list(s)
            for _ in range(e + 1):
                t[rng.integers(0, len(t))] = int(rng.integers(0, most))
            rows.append((base * 100 + e + 1, t))
        rows.append((base * 100 + 10, s[:60] + rng.integers(0, most, 5).tolist() + s[60:]))
        rows.append((base * 100 + 11, s[75:] + s[:75]))
        rows.append((base * 100 + 12, border + rng.integers(0, most, 60).tolist() + border))
        rows.append((base * 100 + 13, list(s)))
    odd = [None, [], [5] * 300, list(range(20)), list(range(39)), list(range(38)), [None, None] + list(range(60)), [None, None] + list(range(60))]
    rows += [(5000 + i, s) for i, s in enumerate(odd)] + [(None, rows[0][1]), rows[0], rows[0], (0, None)]
    return rows


def brute(rows, t=0.6, run=8, least=32):
    sets = {}
    for i, s in rows:
        if i is not None and s is not None:
            r = {tuple(s[k : k + run]) for k in range(len(s) - run + 1)}
            if len(r) >= least:
                sets[i] = r
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-12}, set(sets)


@pytest.mark.parametrize("most", [4, 256, 100_000])
def test_pairs_equal_brute_force(spark, most):
    rows = made(1, most)
    assert {tuple(r) for r in near_copy_pairs(frame(spark, rows)).collect()} == brute(rows)[0]


@pytest.mark.parametrize(("threshold", "matches"), [(0.3, 1), (0.8, 8), (0.95, 20)])
def test_thresholds(spark, threshold, matches):
    rows = made(2)
    assert {tuple(r) for r in near_copy_pairs(frame(spark, rows), threshold, matches=matches).collect()} == brute(rows, threshold)[0]


def test_a_tiny_sketch_only_costs_time(spark):
    rows = made(3)
    assert {tuple(r) for r in near_copy_pairs(frame(spark, rows), bits=14).collect()} == brute(rows)[0]


def test_groups(spark, parts):
    rows = made(4)
    pairs, ids = brute(rows)
    out = {r["id"]: r for r in near_copy_groups(frame(spark, rows).repartition(parts)).collect()}
    assert out.keys() == ids
    name = {i: i for i in ids}
    for _ in range(50):
        for a, b in pairs:
            name[a] = name[b] = min(name[a], name[b])
    assert {i: r["group_id"] for i, r in out.items()} == name


def test_hot_group_of_copies_is_compared_once(spark):
    s = np.random.default_rng(5).integers(0, 256, 100).tolist()
    rows = [(i, s) for i in range(300)] + [(1000 + i, np.random.default_rng(500 + i).integers(0, 256, 100).tolist()) for i in range(50)]
    out = near_copy_groups(frame(spark, rows)).collect()
    assert {r["class_id"] for r in out if r["id"] < 300} == {0} and all(r["n_links"] == 0 for r in out)
    assert near_copy_pairs(frame(spark, rows)).count() == 300 * 299 // 2


def test_deliveries_that_differ_make_no_pair_with_themselves(spark):
    s = np.random.default_rng(9).integers(0, 256, 100).tolist()
    out = near_copy_pairs(frame(spark, [(1, s), (1, s[:-1]), (1, [7] * 50), (2, s)])).collect()
    assert [tuple(r) for r in out] == [(1, 2)]


def test_empty(spark):
    assert near_copy_pairs(frame(spark, [])).count() == 0
    assert near_copy_groups(frame(spark, [(1, None), (2, [])])).count() == 0


def test_too_many_matches_are_refused(spark):
    with pytest.raises(ValueError):
        near_copy_pairs(frame(spark, []), matches=21)


def test_runs_meet_whatever_stands_beside_them():
    a, b = np.arange(50), np.concatenate((np.arange(50), [70_000]))
    assert np.isin(run_set(a, 8), run_set(b, 8)).all()
    for v in (a, b, np.array([-5, 3]), np.zeros(0, np.int64)):
        assert (unpack(pack(v.astype(np.int64))) == v).all()


def test_components_of_a_long_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(100)] + [(1000 + i, 999) for i in range(200)] + [(7, 7), (None, 3), (3, 2)]
    out = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "x long, y long"), "x", "y").collect()}
    assert out == {i: 0 for i in range(101)} | {999: 999} | {1000 + i: 999 for i in range(200)}
    assert components(spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0
