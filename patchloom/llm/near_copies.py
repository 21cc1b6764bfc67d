"""Near-duplicate number sequences (pixels, bytes, tokens) that differ by small edits.

An inverted index from runs of consecutive values to records, asked only for each record's rarest runs; the runs two
records share there are tallied, pairs below the number that similar records must share are dropped, and the exact
similarity of the whole run sets decides. Equal run sets are compared once.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.llm.components import components
from patchloom.shared import materialize, mix64, spread

RUN, LEAST_RUNS, THRESHOLD = 8, 32, 0.6
#: A guaranteed minimum of matches within the indexed runs.
MATCHES = 8
#: The count sketch that orders runs by rarity has a cell for every fourth run of all records, but 2^16 at least and 2^24 at most.
LEAST_BITS, MOST_BITS = 16, 24


def pack(values: np.ndarray) -> bytes:
    """A sequence in as few bytes as its range allows."""
    small = len(values) == 0 or (values.min() >= 0 and values.max() <= 255)
    return (b"1" + values.astype(np.uint8).tobytes()) if small else (b"8" + values.astype("<i8").tobytes())


def unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, np.uint8, offset=1).astype(np.int64) if packed[:1] == b"1" else np.frombuffer(packed, "<i8", offset=1)


def run_set(values: np.ndarray, run: int) -> np.ndarray:
    """The distinct runs as sorted 64-bit numbers: exact where run values of 0..255 fit into 8 bytes, else a hash."""
    n = len(values) - run + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    v, out = values.astype(np.uint64), np.zeros(n, np.uint64)
    exact = run <= 8 and values.min() >= 0 and values.max() <= 255
    for k in range(run):
        out = (out << np.uint64(8)) | v[k : k + n] if exact else mix64(out + v[k : k + n] + np.uint64(1))
    # both forms of a run must meet: a run of small values in a record that has others is packed as well
    if not exact and run <= 8:
        fits = np.convolve(((values < 0) | (values > 255)).astype(np.int64), np.ones(run, np.int64), "valid") == 0
        packed = np.zeros(n, np.uint64)
        for k in range(run):
            packed = (packed << np.uint64(8)) | (v[k : k + n] & np.uint64(255))
        out = np.where(fits, packed, out)
    return np.unique(mix64(out))


def _values(cell) -> np.ndarray:
    """Null elements become a value of their own."""
    a = np.asarray(cell)
    if a.dtype == object or a.dtype.kind == "f":
        a = np.array([-(2**40) if x is None or x != x else int(x) for x in a.tolist()], np.int64)
    return a.astype(np.int64)


def _prepared(records: DataFrame, run: int, least_runs: int) -> DataFrame:
    """(id, fp1, fp2, n, packed) of records with enough runs; fp: 128 bits of the run set."""

    def scan(batches):
        for pdf in batches:
            out = []
            for i, cell in zip(pdf["id"].tolist(), pdf["seq"], strict=True):
                values = _values(cell)
                runs = run_set(values, run)
                if len(runs) >= least_runs:
                    with np.errstate(over="ignore"):
                        fp = [int(x.sum(dtype=np.uint64).view(np.int64)) for x in (mix64(runs), mix64(runs ^ np.uint64(0x5851F42D4C957F2D)))]
                    out.append((i, *fp, len(runs), pack(values)))
            yield pd.DataFrame(out, columns=["id", "fp1", "fp2", "n", "packed"])

    rows = records.where("id is not null and seq is not null").select("id", "seq")
    return spread(rows).mapInPandas(scan, "id long, fp1 long, fp2 long, n int, packed binary")


def _sketch(records: DataFrame, run: int, bits: int) -> np.ndarray:
    """How many records have a run of each cell, summed over all records, as 8 times the logarithm to base 2 of it; 0 for one or none.

    A byte a cell is what the driver broadcasts, whatever the counts.
    """

    def count(batches):
        cells = np.zeros(1 << bits, np.int32)
        for pdf in batches:
            for packed in pdf["packed"]:
                at = (run_set(unpack(packed), run) >> np.uint64(64 - bits)).astype(np.int64)
                np.add.at(cells, at, 1)
        step = 1 << 14
        for lo in range(0, len(cells), step):
            yield pd.DataFrame({"part": [lo], "cells": [zlib.compress(cells[lo : lo + step].astype("<i8").tobytes(), 1)]})

    def add(pdf):
        total = sum(np.frombuffer(zlib.decompress(x), "<i8") for x in pdf["cells"])
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "cells": [zlib.compress(total.tobytes(), 1)]})

    parts = records.select("packed").mapInPandas(count, "part int, cells binary")
    halfway = parts.groupBy("part", (F.spark_partition_id() % 64).alias("some")).applyInPandas(add, "part int, cells binary")
    rows = halfway.groupBy("part").applyInPandas(add, "part int, cells binary").collect()
    out = np.zeros(1 << bits, np.uint8)
    for r in rows:
        counts = np.frombuffer(zlib.decompress(r["cells"]), "<i8")
        out[r["part"] : r["part"] + (1 << 14)] = 8 * np.log2(counts.clip(1, 1 << 31))
    return out


def similar_run_sets(records: DataFrame, threshold: float, run: int, matches: int, bits: int | None) -> DataFrame:
    """records: (id, n, packed), each run set once -> (id_a, id_b) with id_a < id_b and a similarity of at least threshold."""
    spark = records.sparkSession
    if bits is None:
        runs = records.agg(F.sum("n")).first()[0] or 0
        bits = min(MOST_BITS, max(LEAST_BITS, int(runs // 4).bit_length()))
    rare = spark.sparkContext.broadcast(_sketch(records, run, bits))

    def index(batches):
        counts = rare.value
        for pdf in batches:
            runs_, ids, sizes = [], [], []
            for i, packed in zip(pdf["id"].tolist(), pdf["packed"], strict=True):
                runs = run_set(unpack(packed), run)
                seen = counts[(runs >> np.uint64(64 - bits)).astype(np.int64)]
                order = np.lexsort((runs, seen))[: len(runs) - int(np.ceil(threshold * len(runs) - 1e-9)) + matches]
                order = order[seen[order] > 0]  # a run counted once stands nowhere else
                runs_.append(runs[order].view(np.int64))
                ids.append(np.full(len(order), i, np.int64))
                sizes.append(np.full(len(order), len(runs), np.int32))
            if runs_:
                yield pd.DataFrame({"run": np.concatenate(runs_), "id": np.concatenate(ids), "n": np.concatenate(sizes)})

    # both sides are one shuffle, and a join of its own making may be split where a run is in many records
    postings = records.select("id", "packed").mapInPandas(index, "run long, id long, n int")
    a, b = (postings.select("run", F.col("id").alias(f"id_{s}"), F.col("n").alias(f"n_{s}")) for s in "ab")
    tally = a.join(b, "run").where(f"id_a < id_b and least(n_a, n_b) >= {threshold} * greatest(n_a, n_b) - 1e-9").groupBy("id_a", "id_b").agg(F.count("*").alias("shared"))
    candidates = tally.where(F.col("shared") >= matches).select("id_a", "id_b")

    def verify(batches):
        for pdf in batches:
            made: dict[int, np.ndarray] = {}  # each record of a batch is unpacked once

            def runs_of(i, packed, made=made):
                if i not in made:
                    made[i] = run_set(unpack(packed), run)
                return made[i]

            keep = np.zeros(len(pdf), bool)
            for at, (i, j, a_, b_) in enumerate(zip(pdf["id_a"].tolist(), pdf["id_b"].tolist(), pdf["packed_a"], pdf["packed_b"], strict=True)):
                x, y = runs_of(i, a_), runs_of(j, b_)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[at] = both >= threshold * (len(x) + len(y) - both) - 1e-12
            yield pdf.loc[keep, ["id_a", "id_b"]]

    side = lambda s: records.select(F.col("id").alias(f"id_{s}"), F.col("packed").alias(f"packed_{s}"))
    return candidates.join(side("a"), "id_a").join(side("b"), "id_b").mapInPandas(verify, "id_a long, id_b long")


def _classes(records: DataFrame, run: int, least_runs: int, threshold: float, matches: int, bits: int | None) -> tuple[DataFrame, DataFrame]:
    """(members: id, class_id), (pairs of class ids)."""
    if matches > np.ceil(threshold * least_runs):
        raise ValueError("matches must not exceed what two records of least_runs runs share")
    base = materialize(_prepared(records, run, least_runs), "copies-base")
    ids = base.groupBy("id").agg(F.min(F.struct("fp1", "fp2")).alias("fp")).select("id", "fp.*")
    first = ids.groupBy("fp1", "fp2").agg(F.min("id").alias("class_id"))
    members = materialize(ids.join(first, ["fp1", "fp2"]).select("id", "class_id"), "copies-members")
    once = base.join(first.select(F.col("class_id").alias("id"), "fp1", "fp2"), ["id", "fp1", "fp2"]).dropDuplicates(["id"]).select("id", "n", "packed")
    once = materialize(once, "copies-once")
    return members, materialize(similar_run_sets(once, threshold, run, matches, bits), "copies-pairs")


def near_copy_pairs(records: DataFrame, threshold: float = THRESHOLD, run: int = RUN, least_runs: int = LEAST_RUNS, matches: int = MATCHES, bits: int | None = None) -> DataFrame:
    """records: (id long, seq array<int>) -> (id_a, id_b), the smaller id first: records whose distinct runs are alike.

    Alike: the common runs are at least `threshold` of the runs of either. Repeated rows count once (if deliveries of an id
    differ, the one with the least print of its runs); null ids and null sequences are left out; a null element is a value of its own; sequences with under least_runs distinct runs (empty
    and constant ones among them) are in no pair; other columns don't matter; an empty table gives no pairs.
    """
    members, pairs = _classes(records, run, least_runs, threshold, matches, bits)
    a, b = (members.select(F.col("id").alias(f"of_{s}"), F.col("class_id").alias(f"id_{s}")) for s in "ab")
    across = pairs.join(a, "id_a").join(b, "id_b").select(F.least("of_a", "of_b").alias("id_a"), F.greatest("of_a", "of_b").alias("id_b"))
    copies = a.join(b.withColumnRenamed("id_b", "id_a"), "id_a").where("of_a < of_b").select(F.col("of_a").alias("id_a"), F.col("of_b").alias("id_b"))
    return across.union(copies)


def near_copy_groups(records: DataFrame, threshold: float = THRESHOLD, run: int = RUN, least_runs: int = LEAST_RUNS, matches: int = MATCHES, bits: int | None = None) -> DataFrame:
    """records as near_copy_pairs -> (id, class_id, group_id, n_links), a row for each record with enough runs.

    class_id: the smallest id with the same runs; group_id: the smallest id that is linked directly or through others;
    n_links: the other classes that are alike. Copies are not expanded into pairs.
    """
    members, pairs = _classes(records, run, least_runs, threshold, matches, bits)
    found = components(pairs, "id_a", "id_b").withColumnRenamed("node", "class_id")
    links = pairs.select(F.col("id_a").alias("class_id")).union(pairs.select("id_b")).groupBy("class_id").agg(F.count("*").alias("n_links"))
    per_class = members.select("class_id").distinct().join(found, "class_id", "left").join(links, "class_id", "left")
    per_class = per_class.select("class_id", F.coalesce("component", "class_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return members.join(per_class, "class_id").select("id", "class_id", "group_id", "n_links")
