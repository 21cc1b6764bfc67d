import itertools
import random

import numpy as np
import pytest

from patchloom.llm import shared_spans
from patchloom.llm.shared_spans import _Hasher, anchors, shared_lengths, sharing_documents, winnow

SCHEMA = "doc_id long, text string, text_id int, anchor string, pos double"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], SCHEMA)


def made(seed=0, n=40):
    rng = random.Random(seed)
    letters = "abcdefghij \n\t😀é漢"
    text = lambda k: "".join(rng.choice(letters) for _ in range(k))
    rows = []
    for i in range(n):
        rows.append((i, text(rng.choice([0, 50, 119, 120, 121, 300, 900]))))
    for i in range(n):
        a = rng.choice(rows)[1]
        k = rng.choice([100, 119, 120, 121, 200])
        at = rng.randrange(max(1, len(a) - k + 1))
        rows.append((100 + i, text(rng.randrange(80)) + a[at : at + k] + text(rng.randrange(80))))
    rows += [(300, "ab" * 400), (301, "ba" * 300), (302, "a" * 500), (303, "a" * 119), (304, rows[5][1]), (305, rows[5][1]), (306, None), (None, "a" * 500), (307, ""), rows[45], rows[45]]
    return rows


def windows(rows, span):
    return {i: {t[k : k + span] for k in range(len(t) - span + 1)} for i, t in rows if i is not None and t is not None}


def brute(rows, span=120):
    w = windows(rows, span)
    return {(a, b) for a, b in itertools.combinations(sorted(w), 2) if w[a] & w[b]}


@pytest.mark.parametrize(("span", "k"), [(120, 64), (120, 120), (40, 1), (30, 16)])
def test_pairs_equal_brute_force(spark, span, k):
    rows = made(1)
    assert {tuple(r) for r in sharing_documents(frame(spark, rows), span, k).collect()} == brute(rows, span)


@pytest.mark.parametrize("hot", [0, 1, 3])
def test_hot_anchors_give_the_same_pairs(spark, hot):
    rows = made(7)
    assert {tuple(r) for r in sharing_documents(frame(spark, rows), hot=hot).collect()} == brute(rows)


def test_a_shared_line_below_the_span_makes_no_pairs(spark):
    """All texts have 100 characters in common, some have 120: only those pair, and the others never meet."""
    rng = random.Random(8)
    text = lambda k: "".join(rng.choice("abcdefgh") for _ in range(k))
    line = text(120)
    rows = [(i, text(150) + line[:100] + text(150)) for i in range(80)] + [(1000 + i, text(140) + line + text(90)) for i in range(6)]
    assert {tuple(r) for r in sharing_documents(frame(spark, rows), hot=20).collect()} == brute(rows)
    assert len(brute(rows)) == 15


def test_partitions_do_not_matter(spark, parts):
    rows = made(2)
    assert {tuple(r) for r in sharing_documents(frame(spark, rows).repartition(parts)).collect()} == brute(rows)


def test_lengths(spark, parts):
    rows = made(3)
    span = 120
    w, texts = windows(rows, span), {i: t for i, t in rows if i is not None and t is not None}
    want = {}
    for i, t in texts.items():
        others = set().union(*(w[j] for j in w if j != i))
        covered = [False] * len(t)
        for k in range(len(t) - span + 1):
            if t[k : k + span] in others:
                covered[k : k + span] = [True] * span
        want[i] = (len(t), sum(covered))
    got = {r["doc_id"]: (r["n_chars"], r["shared_chars"]) for r in shared_lengths(frame(spark, rows).repartition(parts)).collect()}
    assert got == want


class SuffixAutomaton:
    """Of one text; matching() gives, for each place of another text, the length of the longest match that ends there."""

    def __init__(self, text):
        self.next, self.link, self.length = [{}], [-1], [0]
        last = 0
        for c in text:
            now, p = len(self.next), last
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = now
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                if self.length[p] + 1 == self.length[q]:
                    self.link[now] = q
                else:
                    copy = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.length.append(self.length[p] + 1)
                    self.link.append(self.link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = copy
                        p = self.link[p]
                    self.link[q] = self.link[now] = copy
            last = now

    def matching(self, text):
        out, at, n = [], 0, 0
        for c in text:
            while at and c not in self.next[at]:
                at = self.link[at]
                n = self.length[at]
            if c in self.next[at]:
                at, n = self.next[at][c], n + 1
            out.append(n)
        return out


def test_lengths_equal_matching_statistics_of_suffix_automata(spark):
    """Each text against an automaton of all others, joined by characters that stand nowhere else."""
    rows = [(i, t) for i, t in {i: t for i, t in made(11, 25) if i is not None and t is not None}.items() if len(t) < 350]
    want = {}
    for i, t in rows:
        others = SuffixAutomaton("".join(chr(0x20000 + j) + u for j, (k, u) in enumerate(rows) if k != i))
        covered = [False] * len(t)
        for end, n in enumerate(others.matching(t), 1):
            if n >= 120:
                covered[end - n : end] = [True] * n
        want[i] = sum(covered)
    assert {r["doc_id"]: r["shared_chars"] for r in shared_lengths(frame(spark, rows)).collect()} == want


@pytest.mark.parametrize("chunk", [1, 50, 1 << 20])
def test_chunks_do_not_matter(spark, monkeypatch, chunk):
    """What a chunk of anchors or windows knows to be shared, and what only meets later, give the same rows."""
    monkeypatch.setattr(shared_spans, "CHUNK", chunk)
    rows = made(12)
    assert {tuple(r) for r in sharing_documents(frame(spark, rows).repartition(2)).collect()} == brute(rows)
    assert {tuple(r) for r in sharing_documents(frame(spark, rows).repartition(2), hot=0).collect()} == brute(rows)


def test_classes_are_not_expanded(spark):
    rng = random.Random(13)
    t = "".join(rng.choice("abcdef") for _ in range(300))
    pairs, members = shared_spans.sharing_classes(frame(spark, [(i, t) for i in range(5)] + [(9, t[20:200])]))
    assert {tuple(r) for r in pairs.collect()} == {(0, 9)}
    assert {(r["doc_id"], r["class_id"]) for r in members.collect()} == {(i, 0) for i in range(5)} | {(9, 9)}


def test_long_texts_are_read_whole(spark, monkeypatch):
    """Pieces overlap by a span, so a match across their border is found."""
    monkeypatch.setattr(shared_spans, "PIECE", 1 << 10)
    rng = random.Random(4)
    long_ = "".join(rng.choice("abcdefghijklmnop") for _ in range(5000))
    rows = [(1, long_), (2, "x" * 30 + long_[960:1085]), (3, long_[4875:]), (4, "y" * 130 + long_[:125]), (5, long_[2000:2119])]
    assert {tuple(r) for r in sharing_documents(frame(spark, rows)).collect()} == brute(rows)


def test_hot_text(spark):
    rng = random.Random(5)
    t = "".join(rng.choice("abcdef") for _ in range(400))
    rows = [(i, t) for i in range(60)] + [(100 + i, "".join(rng.choice("abcdef") for _ in range(400))) for i in range(60)]
    assert sharing_documents(frame(spark, rows)).count() == 60 * 59 // 2
    assert {r["shared_chars"] for r in shared_lengths(frame(spark, rows)).collect() if r["doc_id"] < 60} == {400}


def test_deliveries_that_differ(spark):
    rng = random.Random(9)
    t = "".join(rng.choice("abcdef") for _ in range(300))
    rows = [(1, t), (1, t[:200]), (2, t), (3, t[:150])]
    assert {tuple(r) for r in sharing_documents(frame(spark, rows)).collect()} == {(1, 2), (1, 3), (2, 3)}
    assert sorted(r["doc_id"] for r in shared_lengths(frame(spark, rows)).collect()) == [1, 2, 3]


def test_empty(spark):
    assert sharing_documents(frame(spark, [])).count() == 0
    assert shared_lengths(frame(spark, [])).count() == 0
    assert sharing_documents(frame(spark, [(1, None), (2, ""), (3, "short")])).count() == 0


def test_winnow_guarantee():
    rng = np.random.default_rng(6)
    grams = rng.integers(0, 2**63, 500, dtype=np.uint64)
    at = winnow(grams, 57)
    assert all(((at >= i) & (at < i + 57)).any() for i in range(500 - 56))
    h = _Hasher()
    a, b = anchors(h, "q" * 10 + "abcdefgh" * 40, 120, 64), anchors(h, "abcdefgh" * 40, 120, 64)
    assert set(b[0].tolist()) & set(a[0].tolist())
