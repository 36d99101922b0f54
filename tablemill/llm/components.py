"""Connected components by alternating star steps, with no task or driver that holds a component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.llm.common import stored


def _mark(edges: DataFrame) -> tuple:
    """A fingerprint of a set of edges, order-free: one row to the driver."""
    mixed = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.sum(F.shiftright(mixed, 20)), F.bit_xor(mixed)).first())


#: Edges that one task writes; graphs shrink from round to round, and tiny tasks cost more than they do.
EDGES_PER_TASK = 200_000


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node long, root long) for every node of edges (a long, b long): root is the least node reachable.

    Each round links every node's larger neighbours, then its smaller ones, to the least of them; the graph becomes a
    star per component after about log^2 rounds. Rows never exceed the edges, and a hub's edges are pre-aggregated
    before its minimum is shuffled. Loops and repeated edges do no harm; an empty frame gives an empty one.
    """
    step = stored(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = _mark(step)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        both = step.unionByName(step.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").where((F.col("v") > F.col("u")) & (F.col("v") != F.col("m"))).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        parts = 1 + mark[0] // EDGES_PER_TASK
        large = stored(large.coalesce(parts))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        step = stored(small.unionByName(least.withColumnRenamed("m", "v")).distinct().coalesce(parts))
        before, mark = mark, _mark(step)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = step.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return step.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
