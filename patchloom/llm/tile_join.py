"""Block matrix join: every vector against all vectors, block by block.

The classes are packed into blocks; a group of blocks stays in a task while all blocks stream past it. An int8 product
tile (int8 values, multiplied in float32, where BLAS is) gives every similarity with a bound on its error; where only
similarities from a floor on count, vectors near a common centre are ruled out against what is far from it by the angles
alone, and a tile of half of the directions and the lengths of the rest gives a limit for the others. Only pairs that can't be ruled out are recomputed from both planes, and each row keeps a heap of its best. No pair leaves
the task but those a heap still holds, or a spanning forest of the links, so what is shuffled grows with the rows.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from patchloom.llm.components import components
from patchloom.llm.vectors import planes, unit_rows
from patchloom.shared import discard, materialize

BLOCK, GROUP = 2048, 32768
#: Rows of a product tile: what is compared is still in the cache.
STRIP = 1024
#: float32 arithmetic over a few hundred elements of unit vectors.
FLOAT_ERROR = 4e-6
#: The same for limits by leading directions, and what is added to the square of a rest's length.
LEAD_ERROR, REST = 5e-5, 2e-5
#: Centres that a task looks for, among so many of its rows, each with so many of them near it at least. They only decide what is
#: compared: a vector within NEAR (a cosine) of a centre is in its cell, all others are in none.
CENTRES, LOOKED_AT, MEMBERS, NEAR = 128, 4096, 8, 0.8
#: What an angle may miss by float32 arithmetic, in radians.
ANGLE_ERROR = 3e-3
#: Pairs that are merged at once.
MERGED = 1 << 18
#: Pairs a heap keeps beyond its k because the 16-bit values can't tell them from the k-th. A class that fills k + EXTRA with such
#: pairs may have lost some, so it is searched again in double precision.
EXTRA = 11
#: Parts that a part meets in a round. What the rounds found is merged after each, so it doesn't grow with the parts.
ROUND = 8
#: Links for each class that are kept between rounds.
LINKS = 4
#: Rows of a block in double precision.
EXACT_BLOCK = 512
#: Similarities are compared to 9 decimals.
DECIMALS = 10**9


def blocks(classes: DataFrame, dim: int, group: int = GROUP, unit: bool = True) -> tuple[DataFrame, int]:
    """classes: (class_id, vec) -> (part, block of up to BLOCK vectors as bytes) in the shared folder, and the number of parts.

    unit: vectors are centred and brought to length 1; without it they are taken as they are, and must not be longer than 1.
    """
    ready = unit_rows if unit else np.asarray
    n = classes.count()
    # enough parts for all cores, but none so small that sending every block to it costs more than its products
    parts = max(1, -(-n // group), min(classes.sparkSession.sparkContext.defaultParallelism * 2, -(-n // (2 * BLOCK))))

    def pack(batches):
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId(), []

        def emit(rows):
            ids, x = (np.concatenate(v) for v in zip(*rows, strict=True))
            for at in range(0, len(ids), BLOCK):
                hi, lo, step, e8, e16 = planes(ready(x[at : at + BLOCK]))
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "ids": [ids[at : at + BLOCK].tobytes()], "hi": [hi.tobytes()], "lo": [lo.tobytes()], "step": [step.tobytes()], "e8": [e8.tobytes()], "e16": [e16.tobytes()], "most": [float(e16.max())]})

        for batch in batches:
            held.append((batch.column("class_id").to_numpy(zero_copy_only=False), batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)))
            if sum(len(i) for i, _ in held) >= 4 * BLOCK:
                yield from emit(held)
                held = []
        if sum(len(i) for i, _ in held):
            yield from emit(held)

    packed = classes.repartition(parts, "class_id").mapInArrow(pack, "part int, ids binary, hi binary, lo binary, step binary, e8 binary, e16 binary, most double")
    return materialize(packed, "blocks"), parts


class _Block:
    def __init__(self, row: dict, dim: int):
        get = lambda c, kind: np.frombuffer(row[c], kind)
        self.ids, step = get("ids", np.int64), get("step", np.float64)
        hi, lo = get("hi", np.int8).reshape(-1, dim).astype(np.float32), get("lo", np.int8).reshape(-1, dim).astype(np.float32)
        self.e8, self.e16 = get("e8", np.float64), get("e16", np.float64)
        self.hi, self.step = get("hi", np.int8).reshape(-1, dim), step
        self.fine = (hi * 256 + lo) * step[:, None].astype(np.float32)

    @cached_property
    def coarse(self) -> np.ndarray:
        return self.hi * (256 * self.step[:, None]).astype(np.float32)


def _recomputed(a: np.ndarray, r: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.empty(len(r), np.float32)
    for at in range(0, len(r), 1 << 13):
        part = slice(at, at + (1 << 13))
        out[part] = np.einsum("ij,ij->i", a[r[part]], b[c[part]])
    return out


def _lengths(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)


def _centres(fine: np.ndarray, floor: float) -> np.ndarray:
    """Unit means of those that the row with the most others at the floor has around it, then of the rows that are left, and so on."""
    x = fine[:: max(1, len(fine) // LOOKED_AT)][:LOOKED_AT]
    near = x @ x.T >= np.float32(floor)
    count, found = near.sum(1), []
    while len(found) < CENTRES and count.max() >= MEMBERS:
        members = near[count.argmax()].copy()
        mean = x[members].mean(0, dtype=np.float64)
        found.append(mean / max(np.sqrt((mean * mean).sum()), 1e-300))
        count -= near[:, members].sum(1)
        near[:, members] = False
        count[members] = 0
    return np.array(found, np.float32).reshape(-1, fine.shape[1])


class _Rows:
    """The blocks that stay in a task. floor: with one above 0 the rows of a cell follow each other, after those of none."""

    def __init__(self, own: list[_Block], floor: float = -2.0):
        self.own = own
        for c in ("ids", "e8", "e16", "fine"):
            setattr(self, c, np.concatenate([getattr(b, c) for b in own]))
        if floor > 0:
            self.floor, self.centres = floor, _centres(self.fine, floor)
            cell, angle = self.cells(self.fine)
            order = np.argsort(cell, kind="stable")
            for c in ("ids", "e8", "e16", "fine"):
                setattr(self, c, getattr(self, c)[order])
            self.first = np.searchsorted(cell[order], np.arange(len(self.centres) + 2))
            self.angle = angle[order[: self.first[1]]]
            self.widest = [angle[order[lo:hi], j].max(initial=0) for j, (lo, hi) in enumerate(zip(self.first[1:-1], self.first[2:], strict=True))]

    @cached_property
    def coarse(self) -> np.ndarray:
        return np.concatenate([b.coarse for b in self.own])

    @cached_property
    def basis(self) -> np.ndarray:
        """The half of the directions in which the rows of no cell are longest."""
        x = self.fine[: self.first[1]]
        return np.linalg.eigh((x.T @ x).astype(np.float64))[1][:, ::-1][:, : x.shape[1] // 2 + 2].astype(np.float32)

    @cached_property
    def lead(self) -> np.ndarray:
        return self.led(self.fine[: self.first[1]])

    def led(self, fine: np.ndarray) -> np.ndarray:
        """Vectors along the basis and, last, the length of their rest: what the rests add to a similarity is the product of their lengths at most."""
        z = fine @ self.basis
        return np.concatenate((z, np.sqrt(np.maximum(_lengths(fine) - _lengths(z), 0) + np.float32(REST))[:, None]), 1)

    def cells(self, fine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each vector, 0 for none, and its angles to all centres."""
        cosine = fine @ self.centres.T / np.maximum(np.sqrt(_lengths(fine)), np.float32(1e-30))[:, None]
        angle = np.arccos(np.clip(cosine, -1, 1))
        if not angle.shape[1]:
            return np.zeros(len(fine), np.int64), angle
        return np.where(cosine.max(1) >= NEAR, 1 + cosine.argmax(1), 0), angle

    def product(self, lo: int, hi: int, block: _Block, buffer: np.ndarray) -> np.ndarray:
        tile = buffer[: (hi - lo) * len(block.ids)].reshape(hi - lo, len(block.ids))
        return np.matmul(self.coarse[lo:hi], block.coarse.T, out=tile)

    def scattered(self, block: _Block, cell: np.ndarray, buffer: np.ndarray):
        """(rows, columns) of the pairs of no cell on either side that may reach the floor. Most rows have none."""
        at, least = np.flatnonzero(cell == 0), np.float32(self.floor - self.error(block) - LEAD_ERROR)
        if not len(at) or not self.first[1]:
            return
        led = self.led(block.fine[at]).T
        for lo in range(0, self.first[1], STRIP):
            lead = self.lead[lo : lo + STRIP]
            tile = np.matmul(lead, led, out=buffer[: len(lead) * len(at)].reshape(len(lead), len(at)))
            some = np.flatnonzero(tile.max(1) >= least)
            r, c = np.divmod(np.flatnonzero(tile[some] >= least), len(at))
            if len(r):
                yield lo + some[r], at[c]

    def gathered(self, block: _Block, cell: np.ndarray, angle: np.ndarray):
        """(rows, columns) whose tiles have all other pairs that may reach the floor.

        If a cell's members are within w of its centre, no vector at an angle of more than w and the floor's angle to the centre reaches the floor with one.
        """
        reach = np.arccos(np.clip(self.floor - 2 * self.error(block) - LEAD_ERROR, -1, 1)) + ANGLE_ERROR
        for j in range(len(self.centres)):
            lo, hi = self.first[j + 1 : j + 3]
            if lo < hi and len(c := np.flatnonzero(angle[:, j] <= self.widest[j] + reach)):
                yield from ((np.arange(at, min(at + STRIP, hi)), c) for at in range(lo, hi, STRIP))
            c = np.flatnonzero(cell == j + 1)
            if len(c) and len(r := np.flatnonzero(self.angle[:, j] <= angle[c, j].max() + reach)):
                yield from ((r[at : at + STRIP], c) for at in range(0, len(r), STRIP))

    def error(self, block: _Block) -> float:
        a, b = self.e16.max(), block.e16.max()
        return a * (1 + b) + b + FLOAT_ERROR


def _bounds(errors: np.ndarray, others: np.ndarray) -> np.ndarray:
    """What an int8 similarity may miss, for each row against any row of the other side."""
    worst = others.max()
    return errors * (1 + worst) + worst + FLOAT_ERROR


class _Heaps:
    """The k best of each of some rows and what can't be told from the k-th, merged tile by tile."""

    def __init__(self, ids: np.ndarray, k: int, floor: float, error: float = 0.0):
        self.ids, self.k, self.floor, self.error = ids, k, floor, error
        self.best = np.full((len(ids), k), -2.0, np.float32)
        self.pool: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def least(self, r: np.ndarray | slice = slice(None)) -> np.ndarray:
        return np.maximum(self.best[r, -1] - 2 * self.error, self.floor - self.error)

    def take_best(self, r: np.ndarray, dense: np.ndarray, other_ids: np.ndarray) -> None:
        """Similarities of the rows r to all of the other side."""
        keep = min(self.k + EXTRA, dense.shape[1])
        top = np.argpartition(-dense, keep - 1, axis=1)[:, :keep]
        s, at, c = np.take_along_axis(dense, top, 1).ravel(), np.repeat(r, keep), top.ravel()
        held = s >= self.least()[at]
        self.merge(at[held], other_ids[c[held]], s[held])

    def merge(self, r: np.ndarray, ids: np.ndarray, s: np.ndarray) -> None:
        real = s > -2
        r, ids, s = r[real], ids[real], s[real]
        if not len(r):
            return
        order = np.argsort(r * 8.0 - s)  # by row, then the most similar first, in one sort
        r, ids, s = r[order], ids[order], s[order]
        rank = _rank(r)
        top, first = rank < self.k, rank == 0
        who = r[first]
        new = np.full((len(who), self.k), -2.0, np.float32)
        new[np.cumsum(first)[top] - 1, rank[top]] = s[top]
        self.best[who] = -np.sort(-np.concatenate((self.best[who], new), 1), 1)[:, : self.k]
        keep = (rank < self.k + EXTRA) & (s >= self.least()[r])
        self.pool.append((r[keep], ids[keep], s[keep]))
        self.waiting += int(keep.sum())
        if self.waiting > 4 * (self.k + EXTRA) * len(self.ids):
            self.shrink()

    def shrink(self) -> None:
        r, ids, s = (np.concatenate(x) for x in zip(*self.pool, strict=True))
        held = s >= self.least()[r]
        r, ids, s = r[held], ids[held], s[held]
        order = np.lexsort((ids, -s, r))
        r, ids, s = r[order], ids[order], s[order]
        keep = _rank(r) < self.k + EXTRA
        self.pool, self.waiting = [(r[keep], ids[keep], s[keep])], int(keep.sum())

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.pool:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.shrink()
        r, ids, s = self.pool[0]
        return self.ids[r], ids, s.astype(np.float64)


def _rank(r: np.ndarray) -> np.ndarray:
    """Position of each element within its run of equal values."""
    start = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.zeros(0, np.int64)
    return np.arange(len(r)) - np.repeat(start, np.diff(np.r_[start, len(r)]))


class _Searches:
    """Heaps of the rows that stay, and, block by block, of the blocks that pass: each tile serves both sides."""

    def __init__(self, rows: _Rows, k: int, floor: float):
        self.rows, self.heaps = rows, _Heaps(rows.ids, k, floor)

    def meet(self, block: _Block, own: bool, buffer: np.ndarray):
        """own: the block is among the rows that stay, so its rows have their heaps already."""
        rows, heaps = self.rows, self.heaps
        heaps.error = max(heaps.error, rows.error(block))
        passing = None if own else _Heaps(block.ids, heaps.k, heaps.floor, heaps.error)
        if heaps.floor > 0:
            self.near(block, own, passing, buffer)
        else:
            for lo in range(0, len(rows.ids), STRIP):
                self.strip(lo, min(lo + STRIP, len(rows.ids)), block, passing, buffer)
        return None if passing is None else passing.result()

    def near(self, block: _Block, own: bool, passing: _Heaps | None, buffer: np.ndarray) -> None:
        rows, (cell, angle), kept = self.rows, self.rows.cells(block.fine), []
        least_c = lambda: np.full(len(block.ids), np.inf) if passing is None else passing.least()

        def keep(r, c, s):
            kept.append((r, c, s))
            if sum(len(x) for x, *_ in kept) > MERGED:
                flush()

        def flush():
            if kept:
                self.merge(block, passing, *(np.concatenate(x) for x in zip(*kept, strict=True)))
                kept.clear()

        for r, c in rows.scattered(block, cell, buffer):
            keep(r, c, _recomputed(rows.fine, r, block.fine, c))
        for r, c in rows.gathered(block, cell, angle):
            tile = rows.fine[r] @ block.fine[c].T
            if own:
                tile[rows.ids[r][:, None] == block.ids[c]] = -2
            alive = tile >= self.heaps.least(r)[:, None]
            if passing is not None:
                alive |= tile >= least_c()[c]
            flat = np.flatnonzero(alive)
            if len(flat) > tile.size // 16:
                self.heaps.take_best(r, tile, block.ids[c])
                if passing is not None:
                    passing.take_best(c, tile.T, rows.ids[r])
            elif len(flat):
                i, j = np.divmod(flat, len(c))
                keep(r[i], c[j], tile.ravel()[flat])
        flush()

    def merge(self, block: _Block, passing: _Heaps | None, r: np.ndarray, c: np.ndarray, s: np.ndarray) -> None:
        s = np.where(self.rows.ids[r] == block.ids[c], np.float32(-2), s)
        held = s >= self.heaps.least(r)
        self.heaps.merge(r[held], block.ids[c[held]], s[held])
        if passing is not None:
            held = s >= passing.least(c)
            passing.merge(c[held], self.rows.ids[r[held]], s[held])

    def strip(self, lo: int, hi: int, block: _Block, passing: _Heaps | None, buffer: np.ndarray) -> None:
        rows, heaps = self.rows, self.heaps
        tile = rows.product(lo, hi, block, buffer)
        least_r = heaps.least()[lo:hi]
        least_c = np.full(len(block.ids), np.inf) if passing is None else passing.least()
        mask = tile >= (least_r - _bounds(rows.e8[lo:hi], block.e8)).astype(np.float32)[:, None]
        if passing is not None:
            mask |= tile >= (least_c - _bounds(block.e8, rows.e8[lo:hi])).astype(np.float32)[None, :]
        flat = np.flatnonzero(mask)
        r, c = np.divmod(flat, tile.shape[1])
        a, b = rows.e8[lo:hi][r], block.e8[c]
        reach = tile.ravel()[flat] + (a * (1 + b) + b + FLOAT_ERROR)
        alive = (reach >= least_r[r]) | (reach >= least_c[c])
        r, c = r[alive], c[alive]
        if len(r) > tile.size // 16:  # a large share of the tile: one more product costs less than picking
            fine = rows.fine[lo:hi] @ block.fine.T
            fine[rows.ids[lo:hi][:, None] == block.ids[None, :]] = -2
            heaps.take_best(lo + np.arange(hi - lo), fine, block.ids)
            if passing is not None:
                passing.take_best(np.arange(len(block.ids)), fine.T, rows.ids[lo:hi])
            return
        self.merge(block, passing, r + lo, c, _recomputed(rows.fine, r + lo, block.fine, c))

    def result(self):
        return self.heaps.result()


class _Forest:
    """A spanning forest of the links at or above the floor, tile by tile, the strongest of a tile first."""

    def __init__(self, rows: _Rows, floor: float):
        self.rows, self.floor = rows, floor
        self.label = np.arange(len(rows.ids))
        self.links: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def meet(self, block: _Block, own: bool, buffer: np.ndarray) -> None:
        rows, error, kept = self.rows, self.rows.error(block), []
        cell, angle = rows.cells(block.fine)
        part = np.full(len(block.ids), -1)  # the part of the rows that each of the block's vectors is linked to

        def pairs():
            for r, c in rows.scattered(block, cell, buffer):
                yield r, c, _recomputed(rows.fine, r, block.fine, c)
            for r, c in rows.gathered(block, cell, angle):
                tile = rows.fine[r] @ block.fine[c].T
                flat = np.flatnonzero(tile >= np.float32(self.floor - error))
                i, j = np.divmod(flat, len(c))
                yield r[i], c[j], tile.ravel()[flat]

        for found in pairs():
            kept.append(found)
            if sum(len(x) for x, *_ in kept) > MERGED:
                part, kept = self.link(*(np.concatenate(x) for x in zip(*kept, strict=True)), block, part), []
        if kept:
            self.link(*(np.concatenate(x) for x in zip(*kept, strict=True)), block, part)

    def link(self, r: np.ndarray, c: np.ndarray, s: np.ndarray, block: _Block, part: np.ndarray) -> np.ndarray:
        """Pairs that may reach the floor, with similarities of 16 bits."""
        rows, n, error = self.rows, len(self.label), self.rows.error(block)
        s = s.astype(np.float64)
        near = np.flatnonzero(np.abs(s - self.floor) <= error)  # too close to tell: all of them go on to the exact check
        self.links.append((rows.ids[r[near]], block.ids[c[near]], s[near]))
        held = (s > self.floor + error) & (rows.ids[r] != block.ids[c])
        r, c, s = r[held], c[held], s[held]
        # vectors that meet one part of the rows only give their best link, unless they have one, and can't join parts
        name, best = self.label[r], np.full(len(part), -2.0)
        low, high = np.where(part < 0, n, part), part.copy()
        np.minimum.at(low, c, name)
        np.maximum.at(high, c, name)
        np.maximum.at(best, c, s)
        settled = low[c] == high[c]
        top = np.flatnonzero(settled & (part[c] < 0) & (s == best[c]))
        top = top[np.unique(c[top], return_index=True)[1]]
        self.links.append((rows.ids[r[top]], block.ids[c[top]], s[top]))
        part = part.copy()
        part[c[top]] = low[c[top]]
        if settled.all():
            return part
        r, c, s = r[~settled], c[~settled], s[~settled]
        order = np.argsort(-s, kind="stable")
        r, c, s = r[order], c[order], s[order]
        label = np.concatenate((self.label, np.where(part < 0, n + np.arange(len(part)), part)))
        while True:
            a, b = label[r], label[n + c]
            open_ = a != b
            if not open_.any():
                break
            r, c, s, a, b = r[open_], c[open_], s[open_], a[open_], b[open_]
            both = np.empty(2 * len(a), np.int64)
            both[0::2], both[1::2] = a, b
            who, first = np.unique(both, return_index=True)  # links come best first, so this is each part's best link
            pick = first // 2
            parent = np.arange(len(label))
            parent[who] = np.where(a[pick] == who, b[pick], a[pick])
            mutual = parent[parent] == np.arange(len(parent))
            parent[mutual] = np.minimum(parent[mutual], np.flatnonzero(mutual))
            while (parent[parent] != parent).any():
                parent = parent[parent]
            label = parent[label]
            used = np.unique(pick)
            self.links.append((rows.ids[r[used]], block.ids[c[used]], s[used]))
        # the block leaves: a part is named after its first row
        name, at = np.unique(label[:n], return_index=True)
        named = np.full(len(label), -1)
        named[name] = at
        self.label = named[label[:n]]
        return named[label[n:]]

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.links:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return tuple(np.concatenate(x) for x in zip(*self.links, strict=True))


def _streamed(packed: DataFrame, parts: int, dim: int, floor: float, collect, merge) -> DataFrame:
    """Every part's blocks, in one task, against themselves and the blocks of half of the other parts: each two parts meet once.

    The tasks read the blocks where blocks() wrote them, so none is shuffled. merge: one table of what two rounds found.
    """
    spark, files = packed.sparkSession, {}
    for row in packed.select("part", F.col("_metadata.file_path").alias("file")).distinct().collect():
        files.setdefault(row["part"], []).append(row["file"])

    def blocks_of(part):
        for uri in files.get(part, []):
            system, path = pyarrow.fs.FileSystem.from_uri(uri)
            with system.open_input_file(path) as f:
                for batch in pq.ParquetFile(f).iter_batches(4, columns=["ids", "hi", "lo", "step", "e8", "e16"], use_threads=False):
                    for row in batch.to_pylist():
                        yield _Block(row, dim)

    def rows(result):
        a, b, s = result
        for at in range(0, len(a), 100_000):
            part = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(a[part], pa.int64()), pa.array(b[part], pa.int64()), pa.array(s[part], pa.float64())], names=["class_a", "class_b", "near"])

    def round_(shifts):
        def run(batches):
            for part in [i for batch in batches for i in batch.column("id").to_pylist()]:
                own = list(blocks_of(part))
                if not own:  # a part without rows has nothing to compare
                    continue
                found, buffer = collect(_Rows(own, floor)), np.empty(STRIP * BLOCK, np.float32)
                for shift in shifts:
                    # around a ring, a part meets the parts 1 .. parts/2 before it; at exactly half way only one of the two does
                    other = (part - shift) % parts
                    if shift and (other == part or shift * 2 == parts and other > part):
                        continue
                    for block in blocks_of(other) if shift else own:
                        got = found.meet(block, not shift, buffer)
                        if got is not None:
                            yield from rows(got)
                    own = []
                yield from rows(found.result())

        return run

    near = None
    for lo in range(0, parts // 2 + 1, ROUND):
        now = spark.range(0, parts, 1, parts).mapInArrow(round_(range(lo, min(lo + ROUND, parts // 2 + 1))), "class_a long, class_b long, near double")
        now = materialize(now, "tiles")
        near = now if near is None else merge(near, now)
    return near


def _written(df: DataFrame, name: str) -> DataFrame:
    """materialize() of what comes from rows that are blocks."""
    spark = df.sparkSession
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "8")
    try:
        return materialize(df, name)
    finally:
        spark.conf.set(key, before)


class _Exact:
    """The k best of each of some rows in double precision: similarities to 9 decimals, equal ones by the smaller id."""

    def __init__(self, own: list[tuple[np.ndarray, np.ndarray]], k: int):
        self.ids, self.u = (np.concatenate(x) for x in zip(*own, strict=True))
        self.k, self.less = k, np.full((len(self.ids), k), 9 * DECIMALS)  # 1 - similarity, in units of the last decimal
        self.others = np.full((len(self.ids), k), np.iinfo(np.int64).max)

    def meet(self, ids: np.ndarray, u: np.ndarray) -> None:
        order = np.argsort(ids)
        ids, u = ids[order], u[order]
        keep = min(self.k, len(ids))
        for lo in range(0, len(self.ids), STRIP):
            own = slice(lo, lo + STRIP)
            # distance and position by id in one number, so that the keep least are those of the rule
            key = (DECIMALS - np.rint((self.u[own] @ u.T) * DECIMALS).astype(np.int64)) * len(ids) + np.arange(len(ids))
            at = np.minimum(np.searchsorted(ids, self.ids[own]), len(ids) - 1)
            self_ = np.flatnonzero(ids[at] == self.ids[own])
            key[self_, at[self_]] = 9 * DECIMALS * len(ids)
            key.partition(keep - 1, axis=1)
            less, c = np.divmod(key[:, :keep], len(ids))
            less, others = np.concatenate((self.less[own], less), 1), np.concatenate((self.others[own], ids[c]), 1)
            best = np.lexsort((others, less), axis=1)[:, : self.k]
            self.less[own], self.others[own] = np.take_along_axis(less, best, 1), np.take_along_axis(others, best, 1)

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        there = self.less < 9 * DECIMALS
        return np.repeat(self.ids, there.sum(1)), self.others[there], self.less[there]


def exact_partners(some: DataFrame, classes: DataFrame, slices: int, dim: int, k: int, group: int = GROUP, unit: bool = True) -> DataFrame:
    """(class_a, class_b): for each class_id of some its k most similar others, in double precision.

    A task has a group of them and a slice of all classes; the lists a class has in several tasks are merged here.
    """
    groups = max(1, -(-some.count() // group))
    ready = unit_rows if unit else np.asarray

    def pack(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, EXACT_BLOCK):
                rows = batch.slice(at, EXACT_BLOCK)
                u = ready(rows.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
                yield pa.RecordBatch.from_pydict({"ids": [rows.column("class_id").to_numpy(zero_copy_only=False).tobytes()], "u": [u.tobytes()]})

    made = lambda df, kind: df.select("class_id", "vec").mapInArrow(pack, "ids binary, u binary").withColumn("kind", F.lit(kind))
    packed = materialize(made(classes.join(some, "class_id", "left_semi"), 0).unionByName(made(classes, 1)), "exact-blocks")
    of = lambda n: F.pmod(F.xxhash64("ids"), F.lit(n)).cast("int")
    own = packed.where("kind = 0").withColumn("target", F.explode(F.sequence(of(groups) * slices, of(groups) * slices + (slices - 1))))
    all_ = packed.where("kind = 1").withColumn("target", F.explode(F.sequence(of(slices), of(slices) + (groups - 1) * slices, F.lit(slices))))
    sent = own.unionByName(all_).repartitionById(groups * slices, F.col("target")).sortWithinPartitions("kind").select("kind", "ids", "u")

    def run(batches):
        own_, found = [], None
        for batch in batches:
            for row in batch.to_pylist():
                block = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["u"], np.float64).reshape(-1, dim)
                if row["kind"] == 0:
                    own_.append(block)
                elif own_:  # a part without rows has nothing to compare
                    found = found or _Exact(own_, k)
                    found.meet(*block)
        if found is not None:
            result = found.result()
            for at in range(0, len(result[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 100_000]) for x in result], names=["class_a", "class_b", "less"])

    lists = _written(sent.mapInArrow(run, "class_a long, class_b long, less long"), "exact")
    rank = F.row_number().over(W.partitionBy("class_a").orderBy("less", "class_b"))
    return lists.withColumn("rank", rank).where(F.col("rank") <= k).select("class_a", "class_b")


def best_partners(classes: DataFrame, dim: int, k: int, floor: float = -2.0, group: int = GROUP, unit: bool = True) -> DataFrame:
    """(class_a, class_b): for each class its k most similar others with a similarity of floor or more, and some of those the 16-bit
    values can't tell from the k-th. The heaps a class has in several tasks are merged here. Each keeps its k + EXTRA best, so what
    it left out is no better than those: only where k + EXTRA can't be told from the k-th may one of the k best be missing. Such
    classes are searched again in double precision."""
    packed, parts = blocks(classes, dim, group, unit)
    worst = packed.agg(F.max("most")).first()[0] or 0.0
    order = W.partitionBy("class_a").orderBy(F.desc("near"), "class_b")

    def unsure(near):
        ranked = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k + EXTRA)
        kth = F.min(F.when(F.col("rank") <= k, F.col("near"))).over(W.partitionBy("class_a"))
        return ranked.withColumn("kth", kth).where(F.col("near") >= F.col("kth") - 2 * (worst * (1 + worst) + worst + FLOAT_ERROR))

    def merge(a, b):
        out = materialize(unsure(a.unionByName(b)).select("class_a", "class_b", "near"), "tiles")
        discard(a, b)
        return out

    near = _streamed(packed, parts, dim, floor, lambda rows: _Searches(rows, k, floor), merge)
    discard(packed)
    found = materialize(unsure(near).select("class_a", "class_b", "rank"), "partners")
    discard(near)
    full = found.where(F.col("rank") == k + EXTRA).select(F.col("class_a").alias("class_id"))
    found = found.select("class_a", "class_b")
    return found if full.isEmpty() else found.unionByName(exact_partners(full, classes, parts, dim, k, group, unit))


def doubtful(floor: float, near: str = "near") -> Column:
    """Links whose similarity is so near to the floor that it must be computed in double precision."""
    return F.abs(F.col(near) - floor) < 0.002


def spanning_links(classes: DataFrame, dim: int, floor: float, group: int = GROUP) -> DataFrame:
    """(class_a, class_b, near): links that connect what all pairs with a similarity of floor or more connect.

    Each part gives a spanning forest of its links to all blocks it meets, so at most a link for each row and part. Where the
    rounds give more than LINKS for each class, those that are sure are replaced by links to the least class they connect with.
    """
    packed, parts = blocks(classes, dim, group)
    most = LINKS * classes.count()

    def merge(a, b):
        both = a.unionByName(b)
        if both.count() > most:
            unsure = doubtful(floor)
            joined = components(both.where(~unsure), "class_a", "class_b").select(F.col("node").alias("class_a"), F.col("component").alias("class_b"), F.lit(1.0).alias("near"))
            both = joined.where("class_a != class_b").unionByName(both.where(unsure).distinct())
        out = materialize(both, "tiles")
        discard(a, b)
        return out

    near = _streamed(packed, parts, dim, floor, lambda rows: _Forest(rows, floor), merge)
    discard(packed)
    return near
