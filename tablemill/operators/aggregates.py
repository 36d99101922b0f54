"""Aggregates and fingerprints: partial sums in every task, one small row or one row per key after the shuffle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def group_sum(df: DataFrame, keys: Sequence[str], **sums: str) -> DataFrame:
    """{new: column} sums by key."""
    return df.groupBy(*keys).agg(*[F.sum(c).alias(n) for n, c in sums.items()])


def completeness(required: Mapping[str, DataFrame], optional: Mapping[str, DataFrame | None]) -> DataFrame:
    """One row: cnt_<name> of required tables, has_<name> of optional ones."""
    parts = [df.agg(F.count("*").alias(f"cnt_{n}")) for n, df in required.items()]
    row = reduce(DataFrame.crossJoin, parts)  # one row each
    return row.select(*[F.lit(df is not None).alias(f"has_{n}") for n, df in optional.items()], "*")


def distinct_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys).distinct()


def keys_without_open_end(df: DataFrame, keys: Sequence[str], column: str, open_end: object) -> DataFrame:
    """Keys none of whose intervals is open."""
    return df.groupBy(*keys).agg(F.max(column).alias(f"max_{column}")).where(F.col(f"max_{column}") < F.lit(open_end))


def fingerprint(name: str, df: DataFrame, key: str, dates: Sequence[str] = ()) -> DataFrame:
    """One row that changes when the table gets or loses rows: row count, sum of key lengths, latest dates."""
    latest = [F.max(d).cast("string") for d in dates]
    return df.agg(
        F.count("*").alias("row_count"), F.coalesce(F.sum(F.length(F.col(key).cast("string"))), F.lit(0)).cast("long").alias("key_length"),
        (F.concat_ws("|", *latest) if latest else F.lit("")).alias("latest"),
    ).select(F.lit(name).alias("table_name"), "*")


def fingerprints(tables: Mapping[str, tuple[DataFrame, str, Sequence[str]]]) -> DataFrame:
    """One row per table, all in one job."""
    return reduce(DataFrame.unionByName, [fingerprint(n, *t) for n, t in tables.items()])


def is_constant(df: DataFrame, column: str) -> DataFrame:
    """One row: least and largest value, and whether they are the same (nothing to learn from)."""
    low, high = F.min(column), F.max(column)
    return df.agg(low.alias("low"), high.alias("high"), F.coalesce(low == high, F.lit(True)).alias("constant"))


def null_marked(columns: Sequence[Column]) -> Column:
    """Columns as one text that tells them apart whatever they hold: each its length and a colon before it, or n for null."""
    said = [c.cast("string") for c in columns]
    return F.concat(*[F.coalesce(F.concat(F.length(s), F.lit(":"), s), F.lit("n")) for s in said])


def hash_measures(columns: Sequence[Column]) -> dict[str, Column]:
    """Aggregates from which content_hash() makes the hash of a table: any pass over its rows can take them along.

    The sum of 60-bit MD5 prefixes, as three sums of 20 bits, which stay longs up to 2^43 rows.
    """
    row = F.conv(F.substring(F.md5(null_marked(columns).cast("binary")), 1, 15), 16, 10).cast("long")
    return {"row_count": F.count("*")} | {f"s{k}": F.coalesce(F.sum(F.shiftright(row, 20 * k).bitwiseAND(F.lit((1 << 20) - 1))), F.lit(0)) for k in range(3)}


def content_hash(measures: Mapping[str, int]) -> str:
    """The hash of a table from its measures, as table_hash() has it. They add up over parts of a table."""
    return str(sum(int(measures[f"s{k}"] or 0) << 20 * k for k in range(3)))


def table_hash(df: DataFrame, columns: Sequence[Column] | None = None) -> DataFrame:
    """One row (row_count, content_hash) that doesn't depend on row order; repeated rows count.

    Partial sums, no sort; put together as a decimal. columns: how to write rows as text, where an engine's default
    differs.
    """
    one = df.agg(*[c.alias(n) for n, c in hash_measures(columns or [F.col(f"`{c}`") for c in df.columns]).items()])
    whole = reduce(Column.__add__, [F.col(f"s{k}").cast("decimal(25,0)") * F.lit(1 << 20 * k).cast("decimal(13,0)") for k in range(3)])
    return one.select("row_count", whole.cast("decimal(38,0)").cast("string").alias("content_hash"))
