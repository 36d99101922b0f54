"""Row numbers over a whole table, without putting the table into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemill.scratch import fresh, stored


def global_row_number(df: DataFrame, order: Sequence[str | Column], name: str = "row_number") -> DataFrame:
    """Rows numbered from 1 in the given order, which should be total; rows that tie in it come in order of a hash.

    Rows are dealt into ranges of the order, sorted there, and stored with their number within the range; the counts of
    earlier ranges (one row per range) are added. A window without partitions would sort everything in one task.
    """
    part, own, at = fresh(df, "range_no"), fresh(df, "range_row"), fresh(df, "range_offset")
    ties = F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema if not isinstance(f.dataType, T.MapType)])  # many ties are many ranges
    sorted_ranges = df.repartitionByRange(*order, ties).sortWithinPartitions(*order, ties)
    # The lower 33 bits of the id count the rows of a task in their order.
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = stored(sorted_ranges.select("*", F.spark_partition_id().alias(part), row.alias(own)))
    sizes = ranged.groupBy(part).count()
    offsets = sizes.select(part, (F.sum("count").over(Window.orderBy(part)) - F.col("count")).alias(at))
    # One row per range: bounded by the number of shuffle partitions.
    return ranged.join(F.broadcast(offsets), part).withColumn(name, (F.col(own) + F.col(at) + 1).cast("long")).drop(part, own, at)


def global_running_sums(df: DataFrame, order: Sequence[str | Column], **sums: str) -> DataFrame:
    """df with {new: column} sums of all rows before and of the row itself, in the given order, which should be total.

    Like row numbers: running sums within ranges of the order, and the totals of earlier ranges (one row per range).
    """
    part = fresh(df, "range_no")
    ranged = stored(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    own = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    before = {n: fresh(df, f"{n}_before") for n in sums}
    totals = ranged.groupBy(part).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    totals = totals.select(part, *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(before[n]) for n in sums])
    local = ranged.withColumns({n: F.coalesce(F.sum(c).over(own), F.lit(0)) for n, c in sums.items()})
    # One row per range: bounded by the number of shuffle partitions.
    out = local.join(F.broadcast(totals), part).withColumns({n: F.col(n) + F.col(before[n]) for n in sums})
    return out.drop(part, *before.values())


def split_by_row_number(df: DataFrame, order: Sequence[str | Column], every: int = 10, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """(train, test): every so-and-so-many-th row is test; with offset 9 of 10 the first row is."""
    numbered = stored(global_row_number(df, order, name := fresh(df, "row_number")))
    test = (F.col(name) + offset) % every == 0
    return numbered.where(~test).drop(name), numbered.where(test).drop(name)


def mark_duplicates(df: DataFrame, keys: Sequence[str], name: str = "is_duplicate") -> DataFrame:
    """Whether the key of a row occurs more than once. Counts are pre-aggregated, so a hot key isn't one task's load."""
    n = fresh(df, "key_count")
    counts = df.groupBy(*keys).agg(F.count("*").alias(n)).where(F.col(n) > 1)
    match = [F.col(f"d.`{k}`").eqNullSafe(F.col(f"c.`{k}`")) for k in keys]
    return df.alias("d").join(counts.alias("c"), match, "left").select("d.*", F.col(n).isNotNull().alias(name))
