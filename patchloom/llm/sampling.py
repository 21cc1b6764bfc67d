"""A uniform sample of fixed size from data of unknown length that arrives in pieces."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A sample of up to this many rows is small enough to be broadcast to fetch its records.
BROADCAST_ROWS = 10_000


def sample_keys(records: DataFrame, id_column: str, size: int, seed: int) -> DataFrame:
    """records -> (id, sample_key): the `size` distinct ids with the smallest keys, all ids if there are fewer.

    A key is 60 bits of md5(seed-id): uniform, independent of arrival, order and partitions, and the same for every
    delivery of an id, so repeated rows don't raise its chance. Each task keeps a heap of its `size` smallest; what the
    heaps hold is merged the same way, so samples of pieces can be merged with later pieces as well. Null ids are left out.
    """
    if size < 0:
        raise ValueError("size must not be negative")
    key = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}-"), F.col(id_column).cast("string"))), 1, 15), 16, 10).cast("long")
    keyed = records.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), key.alias("sample_key"))

    def heap(batches):
        ids, keys = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            i, k = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "sample_key"))
            if len(ids) >= size > 0:
                near = k <= keys[-1]
                i, k = i[near], k[near]
            ids, keys = np.concatenate((ids, i)), np.concatenate((keys, k))
            order = np.lexsort((ids, keys))
            ids, keys = ids[order], keys[order]
            new = np.r_[True, (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])] if len(ids) else np.zeros(0, bool)
            ids, keys = ids[new][:size], keys[new][:size]
        for at in range(0, len(ids), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + 10_000]), pa.array(keys[at : at + 10_000])], names=["id", "sample_key"])

    held = keyed.mapInArrow(heap, "id long, sample_key long")
    return held.distinct().orderBy("sample_key", "id").limit(size)


def fixed_size_sample(records: DataFrame, id_column: str, size: int, seed: int = 42) -> DataFrame:
    """The sampled records with all their columns and sample_key; one delivery of each id.

    An empty table gives an empty sample; a column of the name sample_key is replaced.
    """
    keys = sample_keys(records, id_column, size, seed).withColumnRenamed("id", id_column)
    rows = records.drop("sample_key").join(F.broadcast(keys) if size <= BROADCAST_ROWS else keys, id_column)
    return rows.dropDuplicates([id_column])
