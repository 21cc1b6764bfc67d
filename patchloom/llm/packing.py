"""Items of varying length into containers of fixed capacity, with little unused space.

Bounded-space online best fit: a task keeps a fixed number of windows open, places each item into the fullest window it
fits, and emits the fullest window when none fits. What stays open at the end is merged group by group.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.shared import materialize

WINDOWS, MERGED = 64, 64


class Windows:
    """Best fit into at most `most` open windows. place() gives the window of an item; closed ones never come back."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most, self.made = capacity, most, 0
        self.open: list[tuple[int, int]] = []  # (free, window), fullest first

    def place(self, size: int) -> int:
        at = bisect_left(self.open, (size, -1))
        if at < len(self.open):
            free, window = self.open.pop(at)
        else:
            if len(self.open) >= self.most:
                self.open.pop(0)
            free, window = self.capacity, self.made
            self.made += 1
        if free > size:
            insort(self.open, (free - size, window))
        return window


def _merge(pdf: pd.DataFrame, capacity: int, windows: int) -> pd.DataFrame:
    """Open windows of several tasks as items, largest first; the emptiest `windows` results go on."""
    pdf = pdf.sort_values(["used", "container"], ascending=[False, True])
    fit = Windows(capacity, len(pdf) + 1)
    at = np.array([fit.place(int(u)) for u in pdf["used"]], np.int64)
    name = pdf["container"].groupby(at).transform("min")
    used = pdf["used"].groupby(at).transform("sum")
    order = pd.Series(used.to_numpy(), index=name.to_numpy()).groupby(level=0).first().sort_values()
    return pd.DataFrame({"container": pdf["container"], "into": name, "used": used, "going_on": name.isin(order.index[:windows])})


def packed(items: DataFrame, capacity: int = 2048, windows: int = WINDOWS, merged: int = MERGED) -> DataFrame:
    """items: (doc_id long, n_tokens long), one row for each doc_id -> (container_id, doc_id, piece_no, start_token, n_tokens).

    An item beyond the capacity is cut into full pieces and a rest; others are never cut. Empty items take part with 0
    tokens; rows with a null are left out; an empty table gives no containers. A task's order is by hash of the id, so a
    task that runs again makes the same windows.
    """
    if capacity < 1 or windows < 1:
        raise ValueError("capacity and windows must be positive")

    names = ["container", "doc_id", "piece_no", "start_token", "n_tokens"]

    def place(batches):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        fit = Windows(capacity, windows)
        full = 1 << 39  # whole pieces are containers of their own
        for pdf in batches:
            rows = []
            for doc, n in zip(pdf["doc_id"].tolist(), pdf["n_tokens"].tolist(), strict=True):
                pieces, rest = divmod(n, capacity)
                for p in range(pieces):
                    rows.append((base + full, doc, p, p * capacity, capacity))
                    full += 1
                if rest or not pieces:
                    rows.append((base + fit.place(rest), doc, pieces, pieces * capacity, rest))
            yield pd.DataFrame(rows, columns=names)
        rows = [(base + window, 0, -1, 0, capacity - free) for free, window in fit.open]  # what is still open
        yield pd.DataFrame(rows, columns=names)

    tasks = max(items.sparkSession.sparkContext.defaultParallelism, int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = items.select("doc_id", "n_tokens").where("doc_id is not null and n_tokens is not null").repartition(tasks, "doc_id").sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")
    placed = materialize(rows.mapInPandas(place, "container long, doc_id long, piece_no int, start_token long, n_tokens long"), "packed")
    left = placed.where("piece_no = -1").select("container", F.col("n_tokens").alias("used"), F.shiftright("container", 40).alias("team"))
    placed = placed.where("piece_no >= 0")
    moves = None
    while True:
        teams = left.agg(F.max("team")).first()[0]
        if teams is None:
            break
        left = left.withColumn("team", F.floor(F.col("team") / merged).cast("long"))
        made = left.groupBy("team").applyInPandas(lambda team, pdf: _merge(pdf, capacity, windows).assign(team=team[0]), "container long, into long, used long, going_on boolean, team long")
        made = materialize(made, "packed-merge")
        step = made.select("container", "into")
        moves = step if moves is None else moves.join(step.select(F.col("container").alias("into"), F.col("into").alias("next")), "into", "left").select("container", F.coalesce("next", "into").alias("into"))
        if teams < merged:
            break
        left = made.where("going_on").select(F.col("into").alias("container"), "used", "team").distinct()
    if moves is not None:
        placed = placed.join(moves, "container", "left").withColumn("container", F.coalesce("into", "container"))
    return placed.select(F.col("container").alias("container_id"), "doc_id", "piece_no", "start_token", "n_tokens")


def fill_report(containers: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: items, containers, the least number of containers any packing needs, tokens, unused tokens, fill."""
    used = containers.groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("items"))
    return used.agg(
        F.coalesce(F.sum("items"), F.lit(0)).cast("long").alias("items"), F.count("*").alias("containers"),
        F.coalesce(F.ceil(F.sum("used") / capacity), F.lit(0)).cast("long").alias("least_containers"),
        F.coalesce(F.sum("used"), F.lit(0)).cast("long").alias("tokens"),
        F.coalesce(F.sum(capacity - F.col("used")), F.lit(0)).cast("long").alias("unused_tokens"),
        F.coalesce(F.max("used"), F.lit(0)).cast("long").alias("fullest"),
    ).withColumn("fill", F.col("tokens") / F.greatest(F.col("containers") * capacity, F.lit(1)))
