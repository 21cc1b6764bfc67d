"""Records of an evaluation split that also stand, exactly or almost, in a training split.

Minwise hashes of character shingles, cut into bands; only a training and an evaluation name that share a whole
band meet; a sketch of their shingles drops most that can't reach the threshold where they meet; the exact Jaccard
similarity decides; confirmed pairs are counted per split and source.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchloom.shared import discard, materialize, mix64

#: 64 bands of 4 rows: two names with a similarity of 0.60 meet with a probability of 1 - (1 - 0.6^4)^64 = 0.9999.
BANDS, ROWS = 64, 4
#: Names are hashed in lots of about so many characters.
CHARACTERS = 1 << 18
#: Rows of name and band that are shuffled at once; the bands of more names are met in rounds of LEAST_BANDS at least.
ROUND_ROWS, LEAST_BANDS = 30_000_000, 2
#: Words of 64 bits of a name's sketch.
WORDS = 4


def file_name(path: Column) -> Column:
    """The part after the last / or \\, without its last . and what follows, lower-cased, only a-z and 0-9 kept."""
    last = F.substring_index(F.translate(path, "\\", "/"), "/", -1)
    return F.regexp_replace(F.lower(F.regexp_replace(last, r"\.[^.]*\z", "")), "[^a-z0-9]", "")


def shingles(name: Column, n: int) -> Column:
    """The distinct sequences of n consecutive characters; none for a shorter or a null name."""
    return F.when(F.length(name) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(name) - (n - 1)), lambda i: F.substring(name, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def _grams(names: pa.Array | pd.Series, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, name by name, and where each name's begin."""
    names = names if isinstance(names, pa.Array) else pa.array(names, pa.string())
    lengths = pc.utf8_length(names).to_numpy(zero_copy_only=False).astype(np.int64)
    text = b"".join(names.cast(pa.binary()).to_pylist())
    codes = (np.frombuffer(text, np.uint8) if len(text) == lengths.sum() else np.frombuffer(text.decode().encode("utf-32-le"), np.uint32)).astype(np.uint64)
    grams = np.zeros(len(codes) - n + 1, np.uint64)
    for k in range(n):
        grams = mix64(grams + codes[k : len(codes) - n + 1 + k] + np.uint64(1))
    ends = np.cumsum(lengths)
    inside = np.ones(len(grams), bool)
    for k in range(1, n):  # a shingle that reaches into the next name is none
        inside[np.minimum(ends - k, len(grams) - 1)[ends - k < len(grams)]] = False
    return grams[inside], np.cumsum(np.r_[0, lengths - n + 1])[:-1]


def minhash_bands(names: pa.Array | pd.Series, n: int, bands: int, rows: int, seed: int = 7, some: range | None = None, hashed: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """One row for each name, one 64-bit bucket for each of some bands (all). Every name must have n characters at least."""
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 2**63, bands * rows, dtype=np.uint64) | np.uint64(1)
    b = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)
    grams, first = hashed or _grams(names, n)
    some = range(bands) if some is None else some
    out = np.empty((len(names), len(some)), np.uint64)
    for at, band in enumerate(some):
        key = np.full(len(names), band + 1, np.uint64)
        for r in range(band * rows, (band + 1) * rows):
            key = mix64(key ^ np.minimum.reduceat((grams * a[r] + b[r]) >> np.uint64(16), first))
        out[:, at] = key
    return out.view(np.int64)


def _sketch(grams: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """WORDS numbers for each name, with a bit for each shingle."""
    at, bit = (grams >> np.uint64(56)) % np.uint64(WORDS), np.uint64(1) << (grams >> np.uint64(58))
    return [np.bitwise_or.reduceat(np.where(at == w, bit, np.uint64(0)), first).view(np.int64) for w in range(WORDS)]


def _may_reach(threshold: float) -> Column:
    """False only where the sketches rule a pair out: a bit that one name alone has stands for a shingle the other lacks, and a name has as many shingles as bits at least."""
    bits = lambda s: sum((F.bit_count(f"{s}{w}") for w in range(WORDS)), F.lit(0))
    lacks = lambda s, o: sum((F.bit_count(F.col(f"{s}{w}").bitwiseAND(F.bitwise_not(f"{o}{w}"))) for w in range(WORDS)), F.lit(0))
    common = F.least(F.col("t_n") - lacks("t", "e"), F.col("e_n") - lacks("e", "t"))
    return common * F.lit(1 + threshold) >= F.lit(threshold) * (bits("t") + bits("e")) - 1e-9


def overlapping_names(names: DataFrame, threshold: float = 0.6, n: int = 4, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """names: (name_no long, name string, in_train boolean, in_eval boolean), both unique -> (train_no, eval_no), each pair once.

    A pair is given if the share of common shingles among all shingles of both reaches the threshold. Null names and
    names of under n characters have no shingles and are in no pair. A name of both splits pairs with itself.
    Buckets are shuffled with the numbers and sketches of names, some bands at a time; names of one bucket whose sketches can't
    reach the threshold are dropped there, so that names with a common part don't become rows; the names themselves join only
    the distinct candidates.
    """

    def banded(some):
        def run(batches):
            for whole in batches:
                size = max(1, CHARACTERS * whole.num_rows // max(1, whole.column("name").nbytes))
                for at in range(0, whole.num_rows, size):
                    part = whole.slice(at, size)
                    hashed, every = _grams(part.column("name"), n), np.repeat(np.arange(part.num_rows), len(some))
                    keys = minhash_bands(part.column("name"), n, bands, rows, some=some, hashed=hashed)
                    counts = np.diff(np.r_[hashed[1], len(hashed[0])]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), part.column("name_no").take(pa.array(every)), *[pa.array(x[every]) for x in (counts, *_sketch(*hashed))]], names=["bucket", "name_no", "n", *words])

        return run

    usable = names.select("name_no", "name", "in_train", "in_eval").where(F.length("name") >= n)
    at_once = min(bands, max(LEAST_BANDS, ROUND_ROWS // max(1, names.count())))
    met, words = [], [f"s{w}" for w in range(WORDS)]
    for lo in range(0, bands, at_once):
        keyed = lambda c: usable.where(c).select("name_no", "name").mapInArrow(banded(range(lo, min(lo + at_once, bands))), f"bucket long, name_no long, n int, {' long, '.join(words)} long")  # noqa: B023, E731
        side = lambda s, c: keyed(c).select("bucket", F.col("name_no").alias(f"{c[3:]}_no"), F.col("n").alias(f"{s}_n"), *[F.col(w).alias(f"{s}{w[1:]}") for w in words])  # noqa: B023, E731
        # Spark sizes a side by the names it is made of, not by their bands, and might broadcast it
        near = side("t", "in_train").hint("merge").join(side("e", "in_eval").hint("merge"), "bucket").where(_may_reach(threshold))
        met.append(materialize(near.select("train_no", "eval_no").distinct(), "overlap-met"))
    named = lambda s: usable.select(F.col("name_no").alias(f"{s}_no"), F.col("name").alias(f"name_{s}"))
    both = F.size(F.array_intersect("a", "b"))
    candidates = met[0] if len(met) == 1 else reduce(DataFrame.union, met).distinct()
    found = (
        candidates.join(named("train"), "train_no").join(named("eval"), "eval_no")
        .withColumn("a", shingles(F.col("name_train"), n)).withColumn("b", shingles(F.col("name_eval"), n))
        .where(both >= F.lit(threshold) * (F.size("a") + F.size("b") - both) - 1e-12)
        .select("train_no", "eval_no")
    )
    found = materialize(found, "overlap-names")
    discard(*met)
    return found


def split_overlaps(records: DataFrame, threshold: float = 0.6, n: int = 4, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """records: (id long, source string, is_train boolean, path string) -> (pairs, report).

    pairs: (id_a, id_b), the smaller id first. report: (eval_source, train_source, pairs, eval_ids), counted without
    writing the pairs out. Rows count once by id; if deliveries of an id differ, the least value of each column holds.
    Rows with a null id, split or path are left out, an empty table gives empty results, other columns don't matter.
    Equal names, however many rows have them, are compared once and expanded at the end.
    """
    rows_ = records.select("id", "source", "is_train", file_name(F.col("path")).alias("name"))
    rows_ = rows_.where("id is not null and is_train is not null and name is not null")
    rows_ = rows_.groupBy("id").agg(*[F.min(c).alias(c) for c in ("source", "is_train", "name")])
    rows_ = materialize(rows_, "overlap-rows")
    names = rows_.groupBy("name").agg(F.min("id").alias("name_no"), F.max("is_train").alias("in_train"), (~F.min("is_train")).alias("in_eval"))
    names = materialize(names, "overlap-name-numbers")
    named = rows_
    rows_ = materialize(named.join(names.select("name", "name_no"), "name").drop("name"), "overlap-numbered")
    discard(named)
    found = overlapping_names(names, threshold, n, bands, rows)
    discard(names)
    train = rows_.where("is_train").select(F.col("name_no").alias("train_no"), F.col("id").alias("id_t"), F.col("source").alias("train_source"))
    evals = rows_.where("not is_train").select(F.col("name_no").alias("eval_no"), F.col("id").alias("id_e"), F.col("source").alias("eval_source"))
    pairs = found.join(train, "train_no").join(evals, "eval_no").select(F.least("id_t", "id_e").alias("id_a"), F.greatest("id_t", "id_e").alias("id_b"))
    n_train = train.groupBy("train_no", "train_source").agg(F.count("*").alias("nt"))
    n_evals = evals.groupBy("eval_no", "eval_source").agg(F.count("*").alias("ne"))
    per_name = found.join(n_train, "train_no").groupBy("eval_no", "train_source").agg(F.sum("nt").alias("nt"))
    report = (
        per_name.join(n_evals, "eval_no").groupBy("eval_source", "train_source")
        .agg(F.sum(F.col("nt") * F.col("ne")).alias("pairs"), F.sum("ne").alias("eval_ids"))
    )
    return pairs, report
