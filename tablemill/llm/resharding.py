"""Resharding by minimum-cost flow: move the fewest bytes from old shards to new ones of near-equal size.

Rows fall into blocks (old shard, hash of the text). Blocks that are large are cut further by another hash of the text,
and texts that are large by themselves become blocks of their own. Large blocks are placed one by one; for the rest, a
flow from old shard sizes to new capacities, at a cost of one for each byte that leaves its shard, says how many bytes
go where, and blocks are dealt to fill it. Slots number the rows of a shard without gaps: rows are numbered within
parts of a block, and each part has an offset, so no task holds a shard.

Rows of equal texts in one old shard share a block, and with it a shard. Only a text whose rows together exceed the
capacity of a shard is parted, by the hash of the id: its shards could not be near equal otherwise.

Edge cases: a null text has no bytes and the checksum of an empty one; null ids are ordered first; rows equal in id and
text are interchangeable; an empty table gives an empty plan; fewer new shards than old ones empty the others.
"""

from __future__ import annotations

import heapq
import json
import uuid
from collections import defaultdict
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablemill.llm.common import BROADCAST_ROWS, broadcast_if_small, fresh, stored
from tablemill.sources import files

OVERHEAD = 8
#: Blocks of an old shard. The driver gets a row for each block, so with thousands of old shards take fewer.
BLOCKS = 512
#: Rows, and share of a new shard's bytes, from which a block is cut and a text is a block of its own.
BLOCK_ROWS, BLOCK_SHARE = 2_000_000, 0.05


def min_cost_flow(supply: list[int], capacity: list[int]) -> dict[tuple[int, int], int]:
    """flow[i, j] > 0 with row sums supply and column sums <= capacity, of the least cost (0 for i = j, else 1).

    Edges i = j cost nothing, so some cheapest flow fills them. Any other edge costs the same, so whatever pairs excess
    with room is cheapest for the rest: taking both in their order needs at most one edge for each shard.
    """
    flow = {(i, i): min(s, c) for i, (s, c) in enumerate(zip(supply, capacity, strict=False)) if min(s, c) > 0}
    left = [(i, s - flow.get((i, i), 0)) for i, s in enumerate(supply)]
    room = iter([(j, c - flow.get((j, j), 0)) for j, c in enumerate(capacity)])
    j, free = next(room, (0, 0))
    for i, excess in left:
        while excess > 0:
            while free <= 0:
                j, free = next(room)
            amount = min(excess, free)
            flow[i, j] = flow.get((i, j), 0) + amount
            excess, free = excess - amount, free - amount
    return flow


def deal_blocks(blocks: list[tuple[int, int]], capacity: list[int]) -> list[int]:
    """The new shard of each (old shard, bytes) block. The sum of capacities must hold all blocks."""
    n = len(capacity)
    room, new = list(capacity), [-1] * len(blocks)
    large = sum(capacity) / n * BLOCK_SHARE
    order = sorted(range(len(blocks)), key=lambda k: (-blocks[k][1], k))
    # Blocks that a flow could miss by much: each stays where it is if it fits, else goes where most room is.
    by_room = [(-r, j) for j, r in enumerate(room)]
    heapq.heapify(by_room)
    small = []
    for k in order:
        old, size = blocks[k]
        if size <= large:
            small.append(k)
            continue
        if old < n and room[old] >= size:
            j = old
        else:
            while -by_room[0][0] != room[by_room[0][1]]:  # an entry from before its shard got something
                heapq.heapreplace(by_room, (-room[by_room[0][1]], by_room[0][1]))
            j = by_room[0][1]
        room[j] -= size
        new[k] = j
    supply = [0] * (1 + max((old for old, _ in blocks), default=-1))
    for k in small:
        supply[blocks[k][0]] += blocks[k][1]
    free = [max(0, r) for r in room]
    short = sum(supply) - sum(free)  # what overfilled shards lack elsewhere
    for j in range(n):
        free[j] += max(0, -(-short // n))
    want: dict[int, list] = defaultdict(list)
    for (i, j), amount in min_cost_flow(supply, free).items():
        want[i].append((-amount, j != i, j))
    for heap in want.values():
        heapq.heapify(heap)
    # The largest first; each goes where most of its shard's flow is still to be filled.
    for k in small:
        old, size = blocks[k]
        if want[old]:
            w, away, j = want[old][0]
            heapq.heapreplace(want[old], (w + size, away, j))
        else:
            j = old % n  # no bytes at all
        new[k] = j
    return new


def reshard(docs: DataFrame, old_shard: Column, capacity: list[float] | int, blocks: int = BLOCKS) -> tuple[DataFrame, str]:
    """docs with one struct column more (its name is returned): size, text_crc32, old_shard, shard, slot.

    capacity: relative capacities of the new shards, or their number. old_shard: an int column of few distinct values.
    The driver gets one row per block: old shards x blocks, and as many more as large blocks are cut into.
    """
    spark = docs.sparkSession
    shares = [1.0] * capacity if isinstance(capacity, int) else list(capacity)
    text = F.coalesce(F.col("text"), F.lit(""))
    names = [fresh(docs, f"shard_{n}") for n in ("size", "crc", "old", "bucket", "hash", "cuts", "pieces", "parts", "unit", "part", "new", "offset")]
    size, crc, old, bucket, text_hash, cuts, pieces, parts, unit, part, new, offset = names
    rows = docs.withColumn(size, (F.octet_length(text) + OVERHEAD).cast("long")).withColumn(crc, F.crc32(text.cast("binary")))
    rows = rows.withColumn(old, old_shard.cast("int")).withColumn(bucket, F.pmod(F.xxhash64(text, F.lit(1)), F.lit(blocks)).cast("int"))
    rows = rows.withColumn(text_hash, F.xxhash64(text, F.lit(2)))
    sums = [F.sum(size).alias("bytes"), F.count("*").alias("n")]
    first = stored(rows.groupBy(old, bucket).agg(*sums))
    total = first.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    capacities = [int(total * s / sum(shares)) + 1 for s in shares]
    limit, most = max(1, int(total / len(shares) * BLOCK_SHARE)), max(capacities)

    # Large blocks, and the texts in them that are large themselves: at most total / limit + rows / BLOCK_ROWS of each.
    large = (F.col("bytes") > limit) | (F.col("n") > BLOCK_ROWS)
    big = stored(first.where(large).select(old, bucket, F.col("bytes").alias("all_bytes"), F.col("n").alias("all_n")))
    texts = rows.select(old, bucket, text_hash, size).join(broadcast_if_small(big.select(old, bucket)), [old, bucket]).groupBy(old, bucket, text_hash).agg(*sums)
    hot = stored(texts.where(large))
    rest = hot.groupBy(old, bucket).agg(F.sum("bytes").alias("hot_bytes"), F.sum("n").alias("hot_n"))
    over = lambda c, k: F.ceil((F.col(f"all_{c}") - F.coalesce(f"hot_{c}", F.lit(0))) / k)
    cut = big.join(broadcast_if_small(rest), [old, bucket], "left").select(old, bucket, F.greatest(F.lit(1), over("bytes", limit), over("n", BLOCK_ROWS)).cast("int").alias(cuts))
    # A text that no shard can hold is parted; the rows of any other stay together, numbered in parts.
    pieces_of = F.when(F.col("bytes") > most, F.ceil(F.col("bytes") / limit)).otherwise(1).cast("int").alias(pieces)
    hot = hot.select(old, bucket, text_hash, pieces_of, F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK_ROWS)).cast("int").alias(parts))
    rows = rows.join(broadcast_if_small(stored(cut)), [old, bucket], "left").join(broadcast_if_small(stored(hot)), [old, bucket, text_hash], "left")
    spread = lambda k, seed: F.pmod(F.xxhash64(F.col("doc_id"), F.col(crc), F.lit(seed)), F.col(k))
    own = F.when(F.col(pieces).isNotNull(), F.xxhash64(text_hash, spread(pieces, 3))).when(F.col(cuts).isNotNull(), F.pmod(F.xxhash64(text_hash, F.lit(4)), F.col(cuts))).otherwise(0)
    rows = rows.withColumn(unit, own.cast("long")).withColumn(part, F.coalesce(spread(parts, 5), F.lit(0)).cast("int"))

    key = [old, bucket, unit, part]
    counted = rows.groupBy(*key).agg(*sums).orderBy(*key).collect()
    units: dict[tuple, int] = defaultdict(int)
    for b in counted:
        units[b[old], b[bucket], b[unit]] += b["bytes"]
    places = dict(zip(units, deal_blocks([(k[0], n) for k, n in units.items()], capacities), strict=True))
    filled, table = [0] * len(shares), []
    for b in counted:
        j = places[b[old], b[bucket], b[unit]]
        table.append((*(b[k] for k in key), j, filled[j]))
        filled[j] += b["n"]
    plan = spark.createDataFrame(table, f"`{old}` int, `{bucket}` int, `{unit}` long, `{part}` int, `{new}` int, `{offset}` long")
    out = rows.join(F.broadcast(plan) if len(table) <= BROADCAST_ROWS else plan, key)
    within = F.row_number().over(Window.partitionBy(*key).orderBy("doc_id", crc))
    name = fresh(out, "reshard")
    said = F.struct(F.col(size).alias("size"), F.col(crc).alias("text_crc32"), F.col(old).alias("old_shard"), F.col(new).alias("shard"), (F.col(offset) + within - 1).cast("long").alias("slot"))
    return out.withColumn(name, said).drop(*names), name


def rewrite_affected(out: DataFrame, name: str, path: str, rows_per_file: int = 1_000_000) -> list[int]:
    """Write the shards that gain or lose rows as path/shard=N, rows by slot; shards without a move keep their files.

    Returns the shards written or emptied. out, name: what reshard() returned; it may read path itself. New files are
    staged beside the shards. When all are written, one small file is renamed into place that says so, and from then on
    the new layout holds: what was staged is moved over the old shards, and a shard that ends empty goes. If that is cut
    off, before or after, read_shards() reads the old layout or the new one whole, and finish_rewrite() does the rest.
    """
    if files.exists(out.sparkSession, f"{path}/{NOTE}"):
        raise RuntimeError("an earlier rewrite isn't finished: finish_rewrite() does it")
    s, spark = F.col(name), out.sparkSession
    moves = out.where(s["old_shard"] != s["shard"]).select(F.explode(F.array(s["old_shard"], s["shard"])).alias("k")).distinct()
    affected = sorted(r["k"] for r in moves.collect())  # at most as many as there are shards
    own = [c for c in out.columns if c != name]
    shard, slot = fresh(out, "shard"), fresh(out, "slot")
    part = out.where(s["shard"].isin(affected)).select(*[F.col(f"`{c}`") for c in own], s["shard"].alias(shard), s["slot"].alias(slot))
    file = F.floor(F.col(slot) / rows_per_file)
    staged = f"_staged-{uuid.uuid4().hex}"  # readers skip names with an underscore
    part.repartition(F.col(shard), file).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(f"{path}/{staged}")
    written = [n for n in files.names(spark, f"{path}/{staged}") if n.startswith(f"{shard}=")]
    emptied = [f"{shard}={k}" for k in affected if f"{shard}={k}" not in written]
    files.write_text(spark, f"{path}/{NOTE}", json.dumps({"staged": staged, "written": written, "emptied": emptied}))
    finish_rewrite(spark, path)
    return affected


#: Says what a rewrite has staged; there while it is moved into place.
NOTE = "_rewrite.json"


def finish_rewrite(spark: SparkSession, path: str) -> None:
    """Move what a rewrite has staged into place, from wherever it was cut off; nothing to do if none was."""
    if not (said := files.read_text(spark, f"{path}/{NOTE}")):
        return
    note = json.loads(said)
    for folder in note["emptied"]:
        files.delete(spark, f"{path}/{folder}")
    for folder in note["written"]:
        # The old shard goes while the new one is still staged; if that isn't there, it has been moved.
        if files.exists(spark, f"{path}/{note['staged']}/{folder}"):
            files.delete(spark, f"{path}/{folder}")
            files.move(spark, f"{path}/{note['staged']}/{folder}", f"{path}/{folder}")
    files.delete(spark, f"{path}/{NOTE}")
    files.delete(spark, f"{path}/{note['staged']}")


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """All shards: of the layout that holds, also while a rewrite is moved into place or after it was cut off."""
    if not (said := files.read_text(spark, f"{path}/{NOTE}")):
        return spark.read.parquet(path)
    note = json.loads(said)
    changed = {*note["written"], *note["emptied"]}
    there = [f"{path}/{n}" for n in files.names(spark, path) if not n.startswith(("_", ".")) and n not in changed]
    staged = {n: f"{path}/{note['staged']}/{n}" for n in note["written"]}
    there += [p if files.exists(spark, p) else f"{path}/{n}" for n, p in staged.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [_one_shard(spark, p) for p in there])


def _one_shard(spark: SparkSession, folder: str) -> DataFrame:
    name, number = folder.rsplit("/", 1)[1].split("=")
    return spark.read.parquet(folder).withColumn(name, F.lit(int(number)))
