"""Sizes of texts in tokens of a public tokenizer, whose file's path is a parameter."""

from __future__ import annotations

import base64
import os

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.shared import materialize

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how byte-level BPE vocabularies of this kind split text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_LOADED: dict[str, object] = {}


def encoder(path: str):
    """The tokenizer of a file of base64 tokens and ranks."""
    import tiktoken

    if path not in _LOADED:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def token_sizes(docs: DataFrame, vocabulary: str = VOCABULARY, keep: tuple[str, ...] = ()) -> DataFrame:
    """docs: (doc_id long, text string, ...) -> (doc_id, n_tokens, *keep), written to the shared folder.

    Whole texts are counted. Null ids and texts are left out; an empty text has 0 tokens; a repeated id counts once.
    """

    def count(batches):
        tokenizer = encoder(vocabulary)
        for batch in batches:
            sizes = [len(tokenizer.encode_ordinary(t.as_py())) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[batch.column(c) for c in keep], pa.array(sizes, pa.int64())], names=["doc_id", *keep, "n_tokens"])

    rows = docs.select("doc_id", *keep, "text").where("doc_id is not null and text is not null")
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    sized = rows.mapInArrow(count, f"doc_id long, {kinds + ', ' if kinds else ''}n_tokens long")
    sized = sized.groupBy("doc_id").agg(F.min(F.struct("n_tokens", *keep)).alias("r")).select("doc_id", "r.*")
    return materialize(sized, "token-sizes")


