"""Comparing all rows of a group with each other, in blocks of bounded size, without emitting pairs.

A group's rows are dealt into blocks; a tile is a pair of blocks. Every tile is one unit of work in one task, and
reports one row per member with links: the weight of its links in this tile, and one link to the least member that it
is connected with inside the tile. A group that holds a third of all rows becomes many tiles over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.llm.common import schema

LINKS = schema("id long, weight long, other long")
_LINKS = pa.schema([("id", pa.int64()), ("weight", pa.int64()), ("other", pa.int64())])
#: Given a tile's rows as columns, yields (i, js): the positions j > i that i is linked with. In a tile of two blocks the
#: second one begins at the given position, and only i before it and j from it on are asked for; else it is None.
Compare = Callable[[dict[str, pa.Array], int | None], Iterator[tuple[int, np.ndarray]]]


def tiles(rows: DataFrame, blocks: str) -> DataFrame:
    """rows with columns tile_a <= tile_b: a row goes to the tiles of its block (by hash of id) with every block.

    blocks: a column with the number of blocks of the row's group.
    """
    own = F.pmod(F.xxhash64("id", F.lit(7)), F.col(blocks)).cast("int")
    rows = rows.withColumn("tile_own", own)
    others = F.sequence(F.lit(0), F.col(blocks).cast("int") - 1)
    rows = rows.withColumn("tile_with", F.explode(others))
    a, b = F.least("tile_own", "tile_with"), F.greatest("tile_own", "tile_with")
    return rows.withColumn("tile_a", a).withColumn("tile_b", b).drop("tile_with")


def link_tiles(tiled: DataFrame, group: list[str], columns: list[str], compare: Compare) -> DataFrame:
    """(id, weight, other) over all tiles. tiled: id long, weight long, the group, the tile, tile_own, and columns.
    compare gets the group and columns."""
    key = [*group, "tile_a", "tile_b"]
    columns = [c for c in columns if c not in group]
    spread = tiled.select(F.xxhash64(*key).alias("tile"), *key, "tile_own", "id", "weight", *columns)
    dealt = spread.repartition("tile").sortWithinPartitions("tile", *key, "id")
    dealt = dealt.select(F.concat_ws("|", *[F.col(k).cast("string") for k in key]).alias("tile"), (F.col("tile_a") == F.col("tile_b")).alias("alone"), "tile_own", "id", "weight", *group, *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        name = None
        for batch in batches:
            names = batch.column(0)
            at = 0
            # Runs of equal tile names; the last run may go on in the next batch.
            told = np.asarray(names.dictionary_encode().indices)
            cuts = [0, *(np.flatnonzero(np.diff(told)) + 1).tolist(), len(told)] if len(told) else [0]
            for at, end in zip(cuts, cuts[1:], strict=False):
                if (now := names[at].as_py()) != name and held:
                    yield from _one(held, compare)
                    held = []
                name = now
                held.append(batch.slice(at, end - at))
        if held:
            yield from _one(held, compare)

    return dealt.mapInArrow(run, LINKS)


def _one(held: list[pa.RecordBatch], compare: Compare) -> Iterator[pa.RecordBatch]:
    if sum(len(b) for b in held) < 2:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    ids = table["id"].to_numpy()
    keep = np.ones(len(ids), dtype=bool)
    keep[1:] = ids[1:] != ids[:-1]
    if not keep.all():  # a row that came twice
        table = table.filter(pa.array(keep))
        ids = table["id"].to_numpy()
    n = len(ids)
    if n < 2:
        return
    second = None
    if not table["alone"][0].as_py():  # pairs of one block belong to that block's own tile
        block = table["tile_own"].to_numpy()
        table = table.take(pa.array(np.argsort(block, kind="stable")))
        ids, second = table["id"].to_numpy(), int((block == block.min()).sum())
        if second == n:
            return
    weight = table["weight"].to_numpy()
    cols = {c: table[c].combine_chunks() for c in table.column_names if c not in ("tile", "alone", "tile_own", "id", "weight")}
    sums = np.zeros(n, dtype=np.int64)
    root = np.arange(n)

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for i, js in compare(cols, second):
        if not len(js):
            continue
        sums[i] += weight[js].sum()
        sums[js] += weight[i]
        a = top(i)
        for b in {top(int(j)) for j in np.unique(root[js])}:
            if a != b:
                root[max(a, b)] = min(a, b)
                a = min(a, b)
    linked = np.flatnonzero(sums)
    if len(linked):
        roots = np.array([top(int(k)) for k in linked])
        yield pa.RecordBatch.from_arrays([pa.array(ids[linked]), pa.array(sums[linked]), pa.array(ids[roots])], schema=_LINKS)
