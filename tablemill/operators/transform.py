"""Projection, typing and filters."""

from __future__ import annotations

import datetime
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The end of an interval that is still open.
OPEN_END = datetime.date(9999, 1, 1)


def select_cols(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in columns])


def rename_cols(df: DataFrame, renames: Mapping[str, str]) -> DataFrame:
    """{new: old}; other columns go."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in renames.items()])


def transmute(df: DataFrame, **exprs: Column) -> DataFrame:
    """All columns replaced by the expressions."""
    return df.select(*[e.alias(n) for n, e in exprs.items()])


def add_literal(df: DataFrame, name: str, value: object) -> DataFrame:
    return df.withColumn(name, F.lit(value))


def trim_all_strings(df: DataFrame) -> DataFrame:
    """Spaces trimmed off every string column; other columns untouched. One projection, whatever their number."""
    return df.select(*[F.trim(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in df.schema])


def apply_type_map(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Casts of the columns named; a value that doesn't fit raises (ANSI mode)."""
    if unknown := set(types) - set(df.columns):
        raise ValueError(f"no such columns: {sorted(unknown)}")
    return df.select(*[F.col(f"`{c}`").cast(types[c]).alias(c) if c in types else F.col(f"`{c}`") for c in df.columns])


def repair_types(df: DataFrame) -> DataFrame:
    """Types as databases deliver them to types that tables keep: whole decimals to the integer of their size, zoned
    timestamps to zone-less ones."""

    def kind(t: T.DataType) -> str | None:
        if isinstance(t, T.DecimalType) and t.scale == 0:
            return "long" if t.precision >= 19 else "long" if t.precision >= 10 else "int" if t.precision >= 5 else "short"
        return "timestamp_ntz" if isinstance(t, T.TimestampType) else None

    return apply_type_map(df, {f.name: k for f in df.schema if (k := kind(f.dataType))})


def try_cast(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Casts that give null where a value doesn't fit."""
    return df.select(*[F.col(f"`{c}`").try_cast(types[c]).alias(c) if c in types else F.col(f"`{c}`") for c in df.columns])


def narrowest(df: DataFrame, kinds: Mapping[str, Sequence[str]]) -> dict[str, str]:
    """Of the types named for each column, narrow ones first, the first that holds all its values; columns for which none
    does are left out. One row comes back."""
    named = [(c, k) for c, own in kinds.items() for k in own]
    kept = [F.coalesce(F.bool_and(F.col(f"`{c}`").try_cast(k).eqNullSafe(F.col(f"`{c}`"))), F.lit(True)).alias(f"kept_{i}") for i, (c, k) in enumerate(named)]
    row = df.agg(*kept).first() if named else ()
    return {c: k for (c, k), fits in reversed([*zip(named, row, strict=True)]) if fits}


def known_by(df: DataFrame, date: datetime.datetime | datetime.date, column: str = "known_from") -> DataFrame:
    """Rows that were known by the date: the filter reaches the parquet scan."""
    return df.where(F.col(column) <= F.lit(date).cast(df.schema[column].dataType))


def current_rows(df: DataFrame, column: str = "end_date") -> DataFrame:
    """Rows whose interval is open."""
    return df.where(F.col(column) == F.lit(OPEN_END).cast(df.schema[column].dataType))
