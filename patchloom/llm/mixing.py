"""Sources mixed to target weights, small ones repeated up to a cap.

Hierarchical budgets: the total goes down a tree by weights; what a child can't use goes to its siblings first, and only
what a whole subtree can't use goes to the subtree's siblings. Each leaf gives whole seeded epochs and, of the last one,
the prefix that fills its budget.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from patchloom.shared import materialize

#: A leaf's epoch order is cut into this many slices; only one slice of a leaf is ever ordered row by row.
SLICES = 4096
#: A tree is made on the driver and its budgets are broadcast, so it has so many leaves at most: some 10 MB.
MOST_LEAVES = 100_000


@dataclass
class Node:
    """weight: share among siblings; a leaf has size (tokens of one epoch) and repeats."""

    name: str
    weight: float
    children: list[Node] = field(default_factory=list)
    size: int = 0
    repeats: int = 1
    budget: float = 0.0

    def capacity(self) -> float:
        return sum(c.capacity() for c in self.children) if self.children else float(self.size * self.repeats)

    def leaves(self, path: tuple[str, ...] = ()):
        here = (*path, self.name)
        if self.children:
            for c in self.children:
                yield from c.leaves(here)
        else:
            yield here, self


def exact_total(node: Node) -> float:
    """The largest total at which every child of the root that has any capacity gets exactly its weight among these."""
    open_ = [c for c in node.children if c.weight > 0 and c.capacity() > 0]
    whole = sum(c.weight for c in open_)
    return min((c.capacity() * whole / c.weight for c in open_), default=0.0)


def spend(node: Node, total: float) -> None:
    """Sets budgets from node down, total at most the node's capacity."""
    node.budget = min(total, node.capacity())
    if not node.children:
        return
    left, open_ = node.budget, [c for c in node.children if c.weight > 0 and c.capacity() > 0]
    given = {id(c): 0.0 for c in node.children}
    while open_ and left > 1e-9:
        whole = sum(c.weight for c in open_)
        short = [c for c in open_ if left * c.weight / whole >= c.capacity()]
        for c in short or open_:
            given[id(c)] = c.capacity() if short else left * c.weight / whole
        if not short:
            break
        left -= sum(c.capacity() for c in short)
        open_ = [c for c in open_ if all(c is not s for s in short)]
    for c in node.children:
        spend(c, given[id(c)])


def clean_source(name: Column) -> Column:
    return F.translate(F.lower(F.trim(name)), "-", "_")


def clean_language(name: Column) -> Column:
    """Lower-cased, without a region or a private suffix; null and blank become und."""
    base = F.substring_index(F.lower(F.trim(F.coalesce(name, F.lit("und")))), "-", 1)
    return F.when(base == "", "und").otherwise(base)


Path = tuple[str, ...]


def tree_of(stats: list[tuple[Path, int]], weights: dict[Path, float], repeats: dict[Path, int]) -> Node:
    """The tree over the leaves' paths and sizes. A node without a weight weighs as much as its tokens; children of a node that has
    weighted children need one to take part. A leaf's repeats are those of the longest prefix of its path that has some, else 1."""
    root, at = Node("all", 1.0), {}
    at[()] = root
    for path in sorted(set(weights) | {p for p, _ in stats}):
        for depth in range(1, len(path) + 1):
            if path[:depth] not in at:
                at[path[:depth]] = Node(path[depth - 1], 0.0)
                at[path[: depth - 1]].children.append(at[path[:depth]])
    tokens: dict[Path, int] = {}
    for path, size in stats:
        at[path].size = size
        at[path].repeats = next((repeats[path[:d]] for d in range(len(path), -1, -1) if path[:d] in repeats), 1)
        for depth in range(len(path) + 1):
            tokens[path[:depth]] = tokens.get(path[:depth], 0) + size
    weighted = {p[:-1] for p in weights}
    for path, node in at.items():
        if path:
            node.weight = float(weights.get(path, 0.0)) if path[:-1] in weighted else float(tokens.get(path, 0))
    return root


def select_by_tree(docs: DataFrame, levels: list[str], weights: dict[Path, float], repeats: dict[Path, int], total: float | None = None, seed: int = 42) -> DataFrame:
    """docs: (doc_id, n_tokens, *levels), one row for each doc_id, no nulls -> (doc_id, *levels, n_tokens, uses).

    levels: the columns of the tree from the root down, such as domain, language, source. The tree has a node for each
    combination of their values that there is: more than MOST_LEAVES of them are refused.
    """
    found = docs.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens")).limit(MOST_LEAVES + 1).collect()
    if len(found) > MOST_LEAVES:
        raise ValueError(f"a mix has at most {MOST_LEAVES} leaves: levels must not grow with the documents")
    stats = [(tuple(r[c] for c in levels), int(r["tokens"])) for r in found]
    root = tree_of(stats, weights, repeats)
    spend(root, exact_total(root) if total is None else float(total))
    rows = [(*path[1:], int(n.budget + 1e-6) // n.size, int(n.budget + 1e-6) % n.size) for path, n in root.leaves() if len(path) == len(levels) + 1 and n.size]
    names = [f"level_{i}" for i in range(len(levels))]
    budgets = docs.sparkSession.createDataFrame(rows, ", ".join(f"{c} string" for c in names) + ", epochs long, rest long")
    leaves = docs.select("doc_id", "n_tokens", *[F.col(c).alias(n) for c, n in zip(levels, names, strict=True)])

    at = leaves.join(F.broadcast(budgets), names)
    order = F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("epochs").cast("string"), F.col("doc_id").cast("string"))), 1, 15), 16, 10).cast("long")
    at = at.withColumn("order", order).withColumn("slice", F.shiftright("order", 48))
    sums = at.groupBy(*names, "slice").agg(F.sum("n_tokens").alias("slice_tokens"))
    leaf = W.partitionBy(*names).orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    upto = sums.withColumn("before", F.coalesce(F.sum("slice_tokens").over(leaf), F.lit(0)))  # SLICES rows a leaf at most
    at = at.join(upto, [*names, "slice"])
    inside, over = F.col("before") < F.col("rest"), F.col("before") + F.col("slice_tokens") > F.col("rest")
    plain = at.where(~(inside & over)).withColumn("more", F.when(over, 0).otherwise(1))
    cut = at.where(inside & over)  # one slice of a leaf
    running = F.sum("n_tokens").over(W.partitionBy(*names).orderBy("order", "doc_id").rowsBetween(W.unboundedPreceding, 0))
    # the document that the budget ends in is taken if more than half of it is within
    cut = cut.withColumn("more", (F.col("before") + running - F.col("n_tokens") / 2 <= F.col("rest")).cast("int"))
    taken = plain.unionByName(cut).withColumn("uses", (F.col("epochs") + F.col("more")).cast("int")).where("uses > 0")
    return materialize(taken.select("doc_id", *[F.col(n).alias(c) for c, n in zip(levels, names, strict=True)], "n_tokens", "uses"), "mix-selection")


def mixed(sizes: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """sizes: (doc_id, n_tokens, lang, source), one row for each doc_id; targets: (source, target_share, max_repeats).

    -> (selection, report). selection: (doc_id, source, lang, n_tokens, uses), uses 1 .. max_repeats. report: a row for
    each target: (source, target_share, actual_share, tokens, available_tokens, documents, most_uses, max_repeats).
    total: tokens to reach; None takes the most at which every source can hold its share exactly; sources
    without any tokens are left out of that and get a share of 0. A source that is too
    small for its share at a given total gives all it may, and the rest is shared among the others by their weights.
    Within a source, languages are weighted by their tokens. Documents are never cut, so a leaf misses its budget by
    at most half a document. Sources without a target, null sources and null sizes are no part of the mix.
    """
    docs = sizes.where("doc_id is not null and n_tokens is not null").select("doc_id", "n_tokens", clean_language(F.col("lang")).alias("lang"), clean_source(F.col("source")).alias("source"))
    wanted = targets.where("source is not null and target_share is not null").groupBy(clean_source(F.col("source")).alias("source")).agg(F.sum("target_share").alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    docs = materialize(docs.join(wanted.select("source"), "source", "left_semi"), "mix-docs")
    shares = wanted.collect()
    selection = select_by_tree(docs, ["source", "lang"], {(t["source"],): t["target_share"] for t in shares}, {(t["source"],): int(t["max_repeats"]) for t in shares}, total, seed)

    used = selection.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens"), F.count("*").alias("documents"), F.max("uses").alias("most_uses"))
    there = docs.groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"))
    all_ = used.agg(F.sum("tokens").alias("whole"))
    report = wanted.join(used, "source", "left").join(there, "source", "left").join(F.broadcast(all_)).select(
        "source", "target_share", (F.coalesce("tokens", F.lit(0)) / F.greatest(F.coalesce("whole", F.lit(1)), F.lit(1))).alias("actual_share"),
        F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"), F.coalesce("available_tokens", F.lit(0)).cast("long").alias("available_tokens"),
        F.coalesce("documents", F.lit(0)).cast("long").alias("documents"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"), "max_repeats",
    )
    return selection, report
