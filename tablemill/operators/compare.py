"""Comparing two versions of a table set."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemill.operators.aggregates import table_hash
from tablemill.scratch import fresh

Tables = Mapping[str, DataFrame]


def _counted(said: list[tuple[tuple[str, ...], DataFrame, Column]], columns: Sequence[str], name: str, spark: SparkSession) -> DataFrame:
    """A row for each finding with one count over its table, taken by Spark."""
    rows = [df.agg(count.alias(name)).select(*[F.lit(v).alias(c) for v, c in zip(values, columns, strict=True)], name) for values, df, count in said]
    if not rows:
        return spark.createDataFrame([], ", ".join([*(f"{c} string" for c in columns), f"{name} long"]))
    return reduce(DataFrame.unionByName, rows)


def diff_tables(spark: SparkSession, new: Tables, old: Tables) -> DataFrame:
    """(table_name, value, n_rows): added or missing, and how many rows the table has or had."""
    said = [((n, "added"), new[n], F.count("*")) for n in sorted(set(new) - set(old))] + [((n, "missing"), old[n], F.count("*")) for n in sorted(set(old) - set(new))]
    return _counted(said, ("table_name", "value"), "n_rows", spark)


def diff_columns(spark: SparkSession, new: Tables, old: Tables) -> DataFrame:
    """(table_name, column_name, value, n_values) of columns that tables of both versions gained, lost, or have with
    another type, and how many values other than null they hold (lost ones: held)."""
    said = []
    for n in sorted(set(new) & set(old)):
        a, b = dict(new[n].dtypes), dict(old[n].dtypes)
        said += [((n, c, "missing"), old[n], F.count(f"`{c}`")) for c in b if c not in a] + [((n, c, "added"), new[n], F.count(f"`{c}`")) for c in a if c not in b]
        said += [((n, c, f"{b[c]} to {a[c]}"), new[n], F.count(f"`{c}`")) for c in a if c in b and a[c] != b[c]]
    return _counted(said, ("table_name", "column_name", "value"), "n_values", spark)


def tables_equal(new: DataFrame, old: DataFrame) -> bool:
    """Equal rows, in any order, repeated ones counted. Two hashes decide; no row is shuffled."""
    if sorted(new.dtypes) != sorted(old.dtypes):
        return False
    return table_hash(new.select(*sorted(new.columns))).first() == table_hash(old.select(*sorted(new.columns))).first()


def _ordered(c: Column, kind: T.DataType) -> Column:
    """c with maps, which have no order, as their entries in order of keys."""
    if isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(c), lambda e: F.struct(_ordered(e["key"], kind.keyType).alias("key"), _ordered(e["value"], kind.valueType).alias("value")))
        return F.array_sort(entries)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _ordered(x, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_ordered(c[f.name], f.dataType).alias(f.name) for f in kind]))
    return c


def hashable(c: Column, kind: T.DataType) -> Column:
    """c in a form whose hash tells it: nested values as text, as hashes of them pass over null and empty ones."""
    if isinstance(kind, T.MapType | T.ArrayType | T.StructType):
        return F.to_json(F.struct(_ordered(c, kind)), {"ignoreNullFields": "false"})
    return c


def diff_rows(new: DataFrame, old: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, change, columns): a row for each key that was added, removed or changed, with the names of the columns
    that changed, comma-joined.

    One aggregation by key over both sides, pre-aggregated in every task: neither a key that is repeated very often nor
    null, which is a key like any other, is one task's load. Where a key is repeated, its rows and the values of each
    column are compared as a whole, in any order (by sums of 64-bit hashes). A column that one side lacks is null there.
    """
    types = {1: dict(new.dtypes), -1: dict(old.dtypes)}
    rest = [c for c in dict.fromkeys([*new.columns, *old.columns]) if c not in keys]
    cells, sign = [f"cell_{k}" for k in range(len(rest))], fresh(new.select(*keys), "side_sign")

    def side(df: DataFrame, mark: int) -> DataFrame:
        def cell(c: str) -> Column:
            if c not in types[mark]:
                return F.lit(None).cast("string")
            same = types[-mark].get(c, types[mark][c]) == types[mark][c]
            return hashable(F.col(f"`{c}`"), df.schema[c].dataType) if same else F.col(f"`{c}`").cast("string")  # another type: as text

        hashes = [F.xxhash64(cell(c)).alias(n) for c, n in zip(rest, cells, strict=True)]
        return df.select(*[F.col(f"`{k}`") for k in keys], *hashes, F.lit(mark).alias(sign))

    both = side(new, 1).unionByName(side(old, -1))

    def balance(h: Column) -> list[Column]:
        """Two sums that are 0 if both sides hold the same values."""
        return [F.sum(part * F.col(sign)) for part in (h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32))]

    measured = [*cells, fresh(new.select(*keys), "whole_row")]
    sums = {f"{n}_{i}": s for n, h in zip(measured, [*map(F.col, cells), F.xxhash64(*cells) if cells else F.lit(0).cast("long")], strict=True) for i, s in enumerate(balance(h))}
    count = lambda mark: F.count(F.when(F.col(sign) == mark, 1))
    per = both.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(count(1).alias("n_new"), count(-1).alias("n_old"), *[s.alias(n) for n, s in sums.items()])
    differs = lambda n: (F.col(f"{n}_0") != 0) | (F.col(f"{n}_1") != 0)
    changed = F.array_compact(F.array(*[F.when(differs(n), F.lit(c)) for c, n in zip(rest, cells, strict=True)]).cast("array<string>"))
    change = F.when(F.col("n_old") == 0, "added").when(F.col("n_new") == 0, "removed").when(differs(measured[-1]) | (F.col("n_new") != F.col("n_old")), "changed")
    columns = F.when(change == "changed", F.array_join(changed, ",")).otherwise("")
    return per.where(change.isNotNull()).select(*[F.col(f"`{k}`") for k in keys], change.alias("change"), columns.alias("columns"))


def compare_versions(new: Tables, old: Tables, check: Callable[[str, DataFrame, DataFrame], DataFrame]) -> dict[str, DataFrame | str]:
    """check(name, new, old) for every table of both versions; a missing partner is reported, not fatal."""
    out: dict[str, DataFrame | str] = {}
    for n in sorted(set(new) | set(old)):
        out[n] = check(n, new[n], old[n]) if n in new and n in old else "only in the new version" if n in new else "only in the old version"
    return out
