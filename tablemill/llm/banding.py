"""Rows that share a key: from the keys of each row to the buckets whose members must be compared.

A key says its band or table itself, so that keys of different ones never agree. A pair that shares several keys is
compared in the least of them only. Of buckets with the same members only that of the least key is kept, so a group of
copies is sent once, not once for each key.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.llm.common import stored


def bucket_lists(items: DataFrame, block_volume: int) -> DataFrame:
    """(id, buckets array<struct<h, blocks>>) for the rows that share a kept bucket with another row.

    items: id long (unique), keys array<long>, volume long. blocks is the number of blocks that keep the volume of a
    block near block_volume.
    """
    rows = items.select("id", "volume", F.explode(F.array_distinct("keys")).alias("h"))
    sums = rows.groupBy("h").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"), F.sum("volume").alias("volume"))
    kept = sums.where("n > 1").groupBy("n", "x", "y").agg(F.min("h").alias("h"), F.max("volume").alias("volume"))
    kept = stored(kept.select("h", F.greatest(F.lit(1), F.ceil(F.col("volume") / block_volume)).cast("int").alias("blocks")))
    return rows.join(kept, "h").groupBy("id").agg(F.collect_list(F.struct("h", "blocks")).alias("buckets"))


def rows_of(lists: pa.Array) -> np.ndarray:
    """Lists of equal length as rows."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def padded(lists: pa.Array) -> np.ndarray:
    """Lists of whole numbers as rows, shorter ones filled with the largest number there is."""
    sizes = np.diff(lists.offsets.to_numpy())
    rows = np.full((len(lists), int(sizes.max(initial=0))), np.iinfo(np.int64).max)
    rows[np.arange(rows.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return rows


def least_common(keys: np.ndarray, h: int) -> Callable[[int, np.ndarray], np.ndarray]:
    """For the members of bucket h, whose keys are rows: those of js that share no lesser key with i."""
    values, at = np.unique(keys, return_inverse=True)
    at = np.where(keys < h, at.reshape(keys.shape) + 1, 0)
    mark = np.zeros(len(values) + 1, dtype=bool)

    def first(i: int, js: np.ndarray) -> np.ndarray:
        mark[at[i]] = True
        mark[0] = False
        kept = js[~mark[at[js]].any(axis=1)]
        mark[at[i]] = False
        return kept

    return first
