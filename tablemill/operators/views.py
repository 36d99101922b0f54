"""Sorting, limits, unions, and views made of them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.scratch import new_path
from tablemill.specs import SortKey, ViewSpec


def sort_column(key: SortKey) -> Column:
    c = F.col(f"`{key.column}`")
    if key.nulls_first is None:
        return c.desc() if key.descending else c.asc()
    if key.descending:
        return c.desc_nulls_first() if key.nulls_first else c.desc_nulls_last()
    return c.asc_nulls_first() if key.nulls_first else c.asc_nulls_last()


def sort_by(df: DataFrame, keys: Sequence[SortKey]) -> DataFrame:
    return df.orderBy(*map(sort_column, keys))


def top_k(df: DataFrame, keys: Sequence[SortKey], k: int) -> DataFrame:
    """The first k rows: every task keeps k rows, and there is no full sort."""
    return sort_by(df, keys).limit(k)


def union_all(tables: Sequence[DataFrame]) -> DataFrame:
    """All rows of tables with the same columns; other columns are an error, another order is not."""
    names = set(tables[0].columns)
    for df in tables[1:]:
        if set(df.columns) != names:
            raise ValueError(f"columns differ: {sorted(names ^ set(df.columns))}")
    return reduce(DataFrame.unionByName, tables)


def split_by_value(df: DataFrame, column: str) -> str:
    """Write one folder per value of column in a single pass and return where: read one value with a partition filter,
    or all with a union by reading the whole."""
    path = new_path(df.sparkSession)
    df.write.option("compression", "zstd").partitionBy(column).parquet(path)
    return path


def except_all(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of left beyond those of right, repeated rows counted."""
    return left.exceptAll(right.select(*left.columns))


def resolve(view: ViewSpec, tables: Mapping[str, DataFrame], limit: int | None = None) -> DataFrame:
    """The rows of a view: views below it are fused first. limit: a further limit of the reader, the smaller one holds."""
    view = view.fuse()
    sources = [view.src] if isinstance(view.src, str) else list(view.src)
    df = union_all([tables[s] for s in sources])
    if keys := view.sort_keys():
        df = sort_by(df, keys)
    if (names := view.renames()) is not None:
        df = df.select(*[F.col(f"`{old}`").alias(new) for new, old in names.items()])
    limits = [x for x in (view.limit, limit) if x is not None]
    return df.limit(min(limits)) if limits else df


def nest(view: ViewSpec, tables: Mapping[str, DataFrame]) -> DataFrame:
    """The rows of a view by plain composition: an inner sort and limit take effect before the outer sort."""
    if not isinstance(view.src, ViewSpec):
        return resolve(view, tables)
    return resolve(ViewSpec("inner", view.columns, view.sort_by, view.limit), {"inner": nest(view.src, tables)})
