import itertools
import os
import random
import re

from pyspark.sql import functions as F

from patchloom.llm import split_overlap
from patchloom.llm.split_overlap import file_name, split_overlaps
from patchloom.shared import materialize, scratch_path

SCHEMA = "id long, source string, is_train boolean, path string, name int, bucket string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)


def made(seed=0, n=120):
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice("abcdefghij0123456789") for _ in range(k))
    rows = []
    for i in range(n):
        stem = f"Hot_Class_{word(14)}" if i % 3 else word(20)
        for e in range(3):
            s = list(stem)
            for _ in range(e):
                s[rng.randrange(len(s))] = rng.choice("xyz")
            rows.append((i * 10 + e, rng.choice(["a", "b"]), rng.random() < 0.5, f"dir{i}/{'' if e else './'}{''.join(s)}.jpg"))
    rows += [(9000, "a", True, None), (9001, "a", None, "x/abcdefgh.jpg"), (None, "a", True, "x/abcdefgh.jpg"), (9002, "a", True, ""), (9003, "b", False, "abc.png"), (9004, "b", True, "abc.png")]
    rows += [(9005, "b", True, "Some Long-Name.tar.gz"), (9006, None, False, "q\\some_long_name.tar.bz2"), (9007, "a", False, "x/" + "ab" * 30000), rows[0], rows[0]]
    return rows


def name(p):
    last = re.split(r"[/\\]", p)[-1]
    return re.sub("[^a-z0-9]", "", (last.rsplit(".", 1)[0] if "." in last else last).lower())


def brute(rows, t=0.6):
    kept = {}
    for i, src, train, p in rows:
        if i is not None and train is not None and p is not None:
            n = name(p)
            kept[i] = (src, train, {n[k : k + 4] for k in range(len(n) - 3)})
    out = {}
    for a, b in itertools.combinations(sorted(kept), 2):
        x, y = kept[a], kept[b]
        if x[1] != y[1] and x[2] and y[2] and len(x[2] & y[2]) >= t * len(x[2] | y[2]):
            out[(a, b)] = (y[0], x[0]) if x[1] else (x[0], y[0])
    return out


def test_pairs_and_report(spark, parts):
    rows = made()
    want = brute(rows)
    pairs, report = split_overlaps(frame(spark, rows).repartition(parts))
    assert {tuple(r) for r in pairs.collect()} == set(want)
    counted = {(r["eval_source"], r["train_source"]): r["pairs"] for r in report.collect()}
    assert counted == {k: list(want.values()).count(k) for k in set(want.values())}


def test_hot_name(spark):
    """A third of all rows has one name; it is compared once."""
    rows = [(i, "a", i % 2 == 0, "x/same_name_here.jpg") for i in range(200)] + [(1000 + i, "b", True, f"y/other{i * 7919}.jpg") for i in range(400)]
    pairs, report = split_overlaps(frame(spark, rows))
    assert pairs.count() == 100 * 100
    assert [(r["eval_source"], r["train_source"], r["pairs"], r["eval_ids"]) for r in report.collect() if r["eval_source"] == "a" and r["train_source"] == "a"] == [("a", "a", 10000, 100)]


def test_empty(spark):
    pairs, report = split_overlaps(frame(spark, []))
    assert pairs.count() == 0 and report.count() == 0


def test_names(spark):
    paths = ["a/b/C_d-1.x.JPG", "x\\y/Zz.png ", "noext", ".hidden", "trail/", "a/b\\c.d\n", "ümlaut_É9.jpg", ""]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in paths], "p string").select(file_name(F.col("p"))).collect()]
    assert got == [name(p) for p in paths]


def alike(n=60):
    """Names of two classes that have half of their shingles in common, few of them nearer."""
    rng = random.Random(5)
    word = lambda k: "".join(rng.choice("abcdef0123456789") for _ in range(k))
    rows = [(i, "a", i % 2 == 0, f"x/{'longbilledmarshcurlew' if i % 3 else 'northernflickerofwoods'}{word(20)}.jpg") for i in range(n)]
    return rows + [(n + i, "b", i % 2 == 1, f"{p[:-5]}z.jpg") for i, _, _, p in rows[::5]]


def test_bands_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(split_overlap, "ROUND_ROWS", 1)
    rows = made() + [(20_000 + r[0], *r[1:]) for r in alike()]
    assert {tuple(r) for r in split_overlaps(frame(spark, rows))[0].collect()} == set(brute(rows))


def test_names_of_a_class_do_not_become_rows(spark, monkeypatch):
    """They share bands, but what is shuffled for names grows with the pairs found, not with the square of a class."""
    sizes, rows = [], alike(1200)
    monkeypatch.setattr(split_overlap, "materialize", lambda df, label: sizes.append((label, out := materialize(df, label), out.count())) or out)
    assert {tuple(r) for r in split_overlaps(frame(spark, rows))[0].collect()} == set(brute(rows))
    met, found = (sum(n for name, _, n in sizes if name == label) for label in ("overlap-met", "overlap-names"))
    assert found <= met < 1200 * 1200 // 100


def test_tables_that_are_done_are_removed(spark):
    rows = made(3)
    folder = scratch_path(spark, "x").removeprefix("file://").rsplit("/", 1)[0]
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    assert split_overlaps(frame(spark, rows))[0].count() == len(brute(rows))
    assert {n.rsplit("-", 1)[0] for n in set(os.listdir(folder)) - before} == {"overlap-numbered", "overlap-names"}


def test_bands_are_never_broadcast(spark, monkeypatch):
    """Spark takes a side for as large as the names, of which it has up to BANDS rows each; the driver can't hold that."""
    plans, rows = [], made(3)
    monkeypatch.setattr(split_overlap, "materialize", lambda df, label: plans.append((label, df._jdf.queryExecution().executedPlan().toString())) or materialize(df, label))
    assert {tuple(r) for r in split_overlaps(frame(spark, rows))[0].collect()} == set(brute(rows))
    met = [plan for label, plan in plans if label == "overlap-met"]
    assert met and not any("Broadcast" in plan for plan in met)
