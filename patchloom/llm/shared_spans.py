"""Long exact spans that stand in more than one text.

Winnowed anchors: of every window of span consecutive characters the least k-gram hash is an anchor, so two texts
with a common span have a common anchor in it. Texts meet by anchor, each chain of anchors once, and the characters
around the anchor decide. Equal texts are compared once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from patchloom.shared import materialize, mix64

SPAN, GRAM = 120, 48
#: An anchor of more texts than this is looked at window by window: its texts may have no more in common than the anchor.
HOT = 256
#: Longer texts are cut into pieces of this many characters that overlap by a span.
PIECE = 1 << 20
#: Anchors or windows that a task looks at together before it gives them on.
CHUNK = 1 << 20
#: Of the bitmap that keeps texts nobody asks for out of a shuffle: 2^20 rows of 16 bytes.
SIEVE_BITS = 26
_BASE = 0x9E3779B97F4A7C15


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base, inverse = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))
    up, down = np.full(n, base, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


class _Hasher:
    """Hashes of all substrings of a text from prefix sums modulo 2^64."""

    def __init__(self, most: int = PIECE):
        self.up, self.down = _powers(most + 1)

    def load(self, text: str) -> int:
        codes = mix64(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1))
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * self.up[: len(codes)], out=self.sums[1:])
        return len(codes)

    def grams(self, k: int) -> np.ndarray:
        return mix64((self.sums[k:] - self.sums[:-k]) * self.down[: len(self.sums) - k])

    def between(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def winnow(grams: np.ndarray, window: int) -> np.ndarray:
    """Positions of the least hash (leftmost if equal) of each window of consecutive hashes."""
    low = np.uint64(PIECE - 1)
    least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while width * 2 <= window:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if rest := window - width:
        least = np.minimum(least[:-rest], least[rest:])
    at = (least & low).astype(np.int64)
    return at[np.r_[True, at[1:] != at[:-1]]]


def anchors(hasher: _Hasher, text: str, span: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position, link) of a text's anchors. link: the hash from the previous anchor's start to this one's end, 0 without one."""
    out = []
    for at in range(0, max(1, len(text) - span + 1), PIECE - span + 1):
        piece = text[at : at + PIECE]
        if len(piece) < span:
            continue
        hasher.load(piece)
        grams = hasher.grams(k)
        pos = winnow(grams, span - k + 1)
        link = np.zeros(len(pos), np.uint64)
        link[1:] = hasher.between(pos[:-1], pos[1:] + k)
        out.append((grams[pos], pos + at, link))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _identified(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts, members). texts: (doc_id, h1, h2, text); members: (doc_id, class_id, n_chars), each doc_id once, in the shared folder.

    class_id is the smallest doc_id with the same text, by 128 bits and the length. If deliveries of a doc_id differ, the text with the
    least hash holds.
    """
    rows = docs.select("doc_id", "text").where("doc_id is not null and text is not null").withColumn("h1", F.xxhash64("text")).withColumn("h2", F.xxhash64(F.lit(7), "text"))
    text = F.struct("h1", "h2", F.length("text").cast("long").alias("n_chars"))
    told = materialize(rows.groupBy("doc_id").agg(F.min(text).alias("t"), F.max(text).alias("u")), "span-docs")
    differ = told.where("t != u").select("doc_id", F.col("t.h1").alias("k1"), F.col("t.h2").alias("k2"))
    if not differ.isEmpty():
        rows = rows.join(differ, "doc_id", "left").where("k1 is null or (k1 = h1 and k2 = h2)").drop("k1", "k2")
    same = told.groupBy("t").agg(F.min("doc_id").alias("class_id"))
    members = materialize(told.join(same, "t").select("doc_id", "class_id", "t.n_chars"), "span-members")
    return rows, members


def _emitted(columns: list[list[np.ndarray]], names: list[str], keys: list[str]):
    """Rows of a chunk, by what is known of their keys: of those that the chunk has in several documents one row is of kind 2 and the others of 1, else 0.

    Of keys that a third of all documents have, a chunk leaves one row (or one document's) to be settled, so no task gets them all.
    """
    values = dict(zip(names, (np.concatenate(x).view(np.int64) for x in columns), strict=True))
    order = np.lexsort([values[c] for c in reversed(keys)])
    values = {c: v[order] for c, v in values.items()}
    docs, new = values["doc_id"], np.zeros(len(order), bool)
    new[0] = True
    for c in keys:
        new[1:] |= values[c][1:] != values[c][:-1]
    start = np.flatnonzero(new)
    several = np.minimum.reduceat(docs, start) < np.maximum.reduceat(docs, start)
    kind = np.repeat(several, np.diff(np.r_[start, len(order)])).astype(np.int32)
    kind[start[several]] = 2
    for at in range(0, len(order), 1 << 16):
        part = slice(at, at + (1 << 16))
        yield pa.RecordBatch.from_arrays([*[pa.array(values[c][part]) for c in names], pa.array(kind[part])], names=[*names, "kind"])


def _in_several(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys stand in several documents. What a chunk knew already is spread by document, only the rest meets by key."""
    place = F.when(F.col("kind") == 1, F.col("doc_id")).otherwise(F.col(keys[0]))
    of = W.partitionBy("place", *keys[1:])
    open_ = F.when(F.col("kind") == 0, F.col("doc_id"))
    told = rows.withColumn("place", place).withColumn("lo", F.min(open_).over(of)).withColumn("hi", F.max(open_).over(of)).withColumn("marked", F.max(F.col("kind") == 2).over(of))
    return told.where("kind > 0 or marked or lo < hi").drop("kind", "place", "lo", "hi", "marked")


def _anchor_table(texts: DataFrame, span: int, k: int) -> DataFrame:
    names = ["anchor", "doc_id", "pos", "link"]

    def scan(batches):
        hasher, seen, held, size = _Hasher(), set(), [], 0
        for batch in batches:
            for doc, h1, h2, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "h1", "h2", "text")), strict=True):
                if (h1, h2) in seen:
                    continue  # copies within a task are scanned once
                seen.add((h1, h2))
                h, pos, link = anchors(hasher, text, span, k)
                held.append((h.view(np.int64), np.full(len(h), doc, np.int64), pos, link))
                size += len(h)
                if size >= CHUNK:
                    yield from _emitted(list(zip(*held, strict=True)), names, ["anchor"])
                    held, size = [], 0
        if size:
            yield from _emitted(list(zip(*held, strict=True)), names, ["anchor"])

    return texts.where(F.length("text") >= span).select("doc_id", "h1", "h2", "text").mapInArrow(scan, "anchor long, doc_id long, pos long, link long, kind int")


def _shared_anchors(texts: DataFrame, members: DataFrame, span: int, k: int) -> DataFrame:
    """Anchors that several documents have: (anchor, text_id, pos, link), each position of a text once, written to the shared folder.

    text_id: the class's doc_id. The texts are scanned once; of the anchors, only the few shared ones go on.
    """
    found = _in_several(_anchor_table(texts, span, k), ["anchor"]).join(members.select("doc_id", F.col("class_id").alias("text_id")), "doc_id")
    return materialize(found.groupBy("anchor", "text_id", "pos").agg(F.min("link").alias("link")), "span-anchors")


def _meetings(shared: DataFrame, *on: str) -> DataFrame:
    """(text_a, pos_a, text_b, pos_b) with text_a < text_b: where two texts share `on` but not what links it to the place before."""
    a, b = (shared.select(*on, *[F.col(c).alias(f"{n}_{s}") for c, n in (("text_id", "text"), ("pos", "pos"), ("link", "link"))]) for s in "ab")
    return a.join(b, [*on]).where("text_a < text_b and (link_a != link_b or link_a = 0)").select("text_a", "pos_a", "text_b", "pos_b")


def _sieved(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows whose key is wanted, and some others: a bitmap of hashes, 16 bits for each wanted key but 2^SIEVE_BITS at most, is broadcast."""
    bits = min(SIEVE_BITS, max(16, (16 * wanted.count()).bit_length()))
    h = F.xxhash64(key).bitwiseAND((1 << bits) - 1)
    word, bit = F.shiftright(h, 6), F.expr(f"shiftleft(1L, cast(xxhash64(`{key}`) & 63 as int))")
    words = wanted.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))  # 2^(bits - 6) rows at most
    return rows.withColumn("word", word).join(F.broadcast(words), "word").where(F.col("bits").bitwiseAND(bit) != 0).drop("word", "bits")


def _with_places(texts: DataFrame, places: DataFrame) -> DataFrame:
    """(text_id, text, at): each text once with its places. Texts without places stay where they are."""
    wanted = materialize(places.distinct().groupBy("text_id").agg(F.collect_list("pos").alias("at")), "span-places")
    found = _sieved(texts.select(F.col("doc_id").alias("text_id"), "text"), wanted.select("text_id"), "text_id")
    return wanted.join(found, "text_id").dropDuplicates(["text_id"]).select("text_id", "text", "at")


def _contexts(texts: DataFrame, places: DataFrame, around: int, k: int) -> DataFrame:
    """places: (text_id, pos) -> (text_id, pos, before, after): up to `around` characters before the anchor, it and as many after.

    All slices of a text are cut in one pass.
    """

    def cut(batches):
        for batch in batches:
            for i, text, at in zip(batch.column("text_id").to_pylist(), batch.column("text"), batch.column("at"), strict=True):
                text, at = text.as_py(), at.as_py()
                for lo in range(0, len(at), 4096):
                    some = at[lo : lo + 4096]
                    before = [text[max(p - around, 0) : p][::-1] for p in some]
                    after = [text[p : p + k + around] for p in some]
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(some), pa.int64()), pa.array(some, pa.int64()), pa.array(before), pa.array(after)], names=["text_id", "pos", "before", "after"])

    return _with_places(texts, places).mapInArrow(cut, "text_id long, pos long, before string, after string")


def _common_prefix(a: list[str], b: list[str]) -> np.ndarray:
    out = np.empty(len(a), np.int64)
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        n = min(len(x), len(y))
        if x[:n] == y[:n]:
            out[i] = n
        else:
            lo = 0
            while x[lo] == y[lo]:
                lo += 1
            out[i] = lo
    return out


def _windows(texts: DataFrame, places: DataFrame, span: int, k: int) -> DataFrame:
    """Windows of `span` characters over the places' anchors that several texts have: (window, half, text_id, pos, link).

    window and half: hashes of the window and of its second half, 128 bits together. link: the hash of the window and the
    character before it, 0 if the window before is not looked at.
    """
    names = ["window", "half", "doc_id", "pos", "link"]

    def scan(batches):
        hasher, held, size = _Hasher(), [], 0
        for batch in batches:
            for i, text, at in zip(batch.column("text_id").to_pylist(), batch.column("text"), batch.column("at"), strict=True):
                text, at = text.as_py(), np.sort(np.asarray(at.as_py(), np.int64))
                if len(text) >= len(hasher.up):
                    hasher = _Hasher(len(text))
                hasher.load(text)
                for lo in range(0, len(at), 4096):
                    some = at[lo : lo + 4096]
                    first = -1 if lo == 0 else at[lo - 1]  # the windows of the places before are done
                    starts = np.unique((some[:, None] - np.arange(span - k + 1)).ravel())
                    starts = starts[(starts > first) & (starts >= 0) & (starts <= len(text) - span)]
                    link = np.zeros(len(starts), np.uint64)
                    after = np.flatnonzero(np.diff(starts, prepend=first) == 1)
                    after = after[starts[after] > 0]
                    link[after] = hasher.between(starts[after] - 1, starts[after] + span)
                    h, half = hasher.between(starts, starts + span), hasher.between(starts + span // 2, starts + span)
                    held.append((h.view(np.int64), half, np.full(len(h), i, np.int64), starts, link))
                    size += len(h)
                    if size >= CHUNK:
                        yield from _emitted(list(zip(*held, strict=True)), names, ["window", "half"])
                        held, size = [], 0
        if size:
            yield from _emitted(list(zip(*held, strict=True)), names, ["window", "half"])

    seen = _with_places(texts, places).mapInArrow(scan, "window long, half long, doc_id long, pos long, link long, kind int")
    return _in_several(seen, ["window", "half"]).withColumnRenamed("doc_id", "text_id")


def _sharing_texts(texts: DataFrame, members: DataFrame, span: int, k: int, hot: int) -> DataFrame:
    """(text_a, text_b), text_a < text_b: all pairs of different texts with a common span of at least `span` characters."""
    shared = _shared_anchors(texts, members, span, k)
    often = shared.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("anchor")
    few, many = shared.join(often, "anchor", "left_anti"), shared.join(often, "anchor", "left_semi")
    met = materialize(_meetings(few, "anchor"), "span-meetings")
    places = met.select(F.col("text_a").alias("text_id"), F.col("pos_a").alias("pos")).union(met.select("text_b", "pos_b"))
    around = materialize(_contexts(texts, places, span - k, k), "span-contexts")

    def long_enough(batches):
        for batch in batches:
            col = lambda c: batch.column(c).to_pylist()  # noqa: B023, E731
            held = _common_prefix(col("before_a"), col("before_b")) + _common_prefix(col("after_a"), col("after_b")) >= span
            yield pa.RecordBatch.from_arrays([batch.column("text_a"), batch.column("text_b")], names=["text_a", "text_b"]).filter(pa.array(held))

    side = lambda s: around.select(F.col("text_id").alias(f"text_{s}"), F.col("pos").alias(f"pos_{s}"), F.col("before").alias(f"before_{s}"), F.col("after").alias(f"after_{s}"))
    both = met.join(side("a"), ["text_a", "pos_a"]).join(side("b"), ["text_b", "pos_b"])
    found = both.select("text_a", "text_b", "before_a", "after_a", "before_b", "after_b").mapInArrow(long_enough, "text_a long, text_b long")
    if many.isEmpty():
        return found.distinct()
    windows = materialize(_windows(texts, many.select("text_id", "pos"), span, k), "span-windows")
    return found.union(_meetings(windows, "window", "half").select("text_a", "text_b")).distinct()


def sharing_documents(docs: DataFrame, span: int = SPAN, k: int = GRAM, hot: int = HOT) -> DataFrame:
    """docs: (doc_id long, text string) -> (doc_id_a, doc_id_b), the smaller id first: documents that share a span.

    Rows count once by doc_id (if deliveries differ, the text with the least hash). Null ids and null texts are left out, texts of under `span` characters are in
    no pair, whole texts of any length are read, other columns don't matter, an empty table gives no pairs.
    """
    texts, members = _identified(docs)
    pairs = _sharing_texts(texts, members, span, k, hot)
    a, b = (members.where(F.col("n_chars") >= span).select(F.col("doc_id").alias(f"doc_{s}"), F.col("class_id").alias(f"text_{s}")) for s in "ab")
    across = pairs.join(a, "text_a").join(b, "text_b").select(F.least("doc_a", "doc_b").alias("doc_id_a"), F.greatest("doc_a", "doc_b").alias("doc_id_b"))
    copies = a.join(b.withColumnRenamed("text_b", "text_a"), "text_a").where("doc_a < doc_b").select(F.col("doc_a").alias("doc_id_a"), F.col("doc_b").alias("doc_id_b"))
    return across.union(copies)


def sharing_classes(docs: DataFrame, span: int = SPAN, k: int = GRAM, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): (class_a, class_b) of different texts that share a span, and (doc_id, class_id, n_chars), copies not expanded.

    Rows, nulls, short and long texts as in sharing_documents. class_id: the smallest doc_id with the same text.
    """
    texts, members = _identified(docs)
    pairs = _sharing_texts(texts, members, span, k, hot)
    return pairs.select(F.col("text_a").alias("class_a"), F.col("text_b").alias("class_b")), members


def shared_lengths(docs: DataFrame, span: int = SPAN, k: int = GRAM) -> DataFrame:
    """docs -> (doc_id, n_chars, shared_chars, spans): how much of each document stands verbatim in another one.

    A character counts if some run of `span` characters that holds it stands in another document. Of a text that
    several documents have, all of it counts if it has `span` characters. Only windows over an anchor that two texts
    share can be common, so only their hashes (128 bits) are compared.
    """
    texts, rows = _identified(docs)
    windows = _windows(texts, _shared_anchors(texts, rows, span, k).select("text_id", "pos"), span, k)
    starts = windows.groupBy("text_id").agg(F.sort_array(F.collect_set("pos")).alias("starts"))
    gap = lambda acc, s: F.struct(
        (acc["covered"] + F.least(F.lit(span).cast("long"), s + span - acc["upto"])).alias("covered"),
        (acc["spans"] + F.when(s > acc["upto"], 1).otherwise(0).cast("long")).alias("spans"),
        (s + span).alias("upto"),
    )
    zero = F.struct(F.lit(0).cast("long").alias("covered"), F.lit(0).cast("long").alias("spans"), F.lit(-1).cast("long").alias("upto"))
    cover = starts.select(F.col("text_id").alias("class_id"), F.aggregate("starts", zero, gap).alias("c")).select("class_id", F.col("c.covered").alias("covered"), F.col("c.spans").alias("found"))
    copies = rows.groupBy("class_id").agg(F.count("*").alias("copies"))
    whole = (F.col("copies") > 1) & (F.col("n_chars") >= span)
    return rows.join(copies, "class_id").join(cover, "class_id", "left").select(
        "doc_id", "n_chars",
        F.when(whole, F.col("n_chars")).otherwise(F.coalesce("covered", F.lit(0).cast("long"))).alias("shared_chars"),
        F.when(whole, F.lit(1).cast("long")).otherwise(F.coalesce("found", F.lit(0).cast("long"))).alias("spans"),
    )
