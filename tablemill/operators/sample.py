"""Small, stable, consistent copies of a set of tables."""

from __future__ import annotations

import datetime
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.operators.transform import known_by
from tablemill.scratch import fresh, stored
from tablemill.sources.tables import write_table


def first_rows(tables: Mapping[str, DataFrame], order: Mapping[str, Sequence[str]], n: int) -> dict[str, DataFrame]:
    """The first n rows of every table by its order (a top-k, not a sort)."""
    return {name: df.orderBy(*order[name]).limit(n) for name, df in tables.items()}


def hash_filter(key: Column, share: float) -> Column:
    """Whether a key falls into a share of all keys: by the first 15 hex digits of its MD5, the same every time. A null
    key is in no share below 1."""
    if (limit := round(share * 16**15)) >= 16**15:
        return F.lit(True)
    return F.substring(F.md5(key.cast("string").cast("binary")), 1, 15) < F.lit(f"{limit:015x}")


def hash_sample(root: DataFrame, key: str, share: float) -> DataFrame:
    """About a share of the rows of root, chosen by the hash of the key."""
    return root.where(hash_filter(F.col(key), share))


def follow_keys(root: DataFrame, tables: Mapping[str, tuple[DataFrame, str, str]]) -> dict[str, DataFrame]:
    """Rows of other tables whose foreign key is in root: {name: (table, foreign key, key of root)}."""
    out = {}
    for name, (df, foreign, key) in tables.items():
        keys = root.select(F.col(key).alias(foreign)).distinct()
        out[name] = df.join(keys, foreign, "left_semi")
    return out


@dataclass(frozen=True)
class ForeignKey:
    """Column child_key of table child refers to parent_key of table parent."""

    child: str
    child_key: str
    parent: str
    parent_key: str


def closure(tables: Mapping[str, DataFrame], keys: Sequence[ForeignKey], seeds: Mapping[str, Column]) -> dict[str, DataFrame]:
    """A sample of a whole set of tables in which no key dangles.

    seeds: {table: which of its rows}. First down: rows that refer to a row of the sample join it, and those that refer
    to them, and so on. Then up: rows that rows of the sample refer to join it. Rows that came in by going up don't bring
    in others that refer to them, or a sampled order would bring its customer, and that all their orders. Both ways
    go to a fixed point, so keys may form a graph of any shape, with cycles and tables that refer to themselves.

    A row is in if its key is in one of the sets of keys that are wanted of its table; these are stored, so that each
    round only asks for keys along references from tables that grew, and their number tells whether they did. They are
    distinct, so joining on them can't multiply rows; where tables are large, Spark's runtime filters put a Bloom filter
    of the keys on the scan before it shuffles. Null refers to nothing.
    """
    if unknown := ({t for k in keys for t in (k.child, k.parent)} | set(seeds)) - set(tables):
        raise ValueError(f"no such tables: {sorted(unknown)}")
    wanted: dict[tuple[str, str, str], tuple[DataFrame, int]] = {}  # (table, its column, way and reference) -> keys

    def rows(table: str) -> DataFrame | None:
        """Those of the table that are in so far."""
        df = tables[table]
        sets = [(column, keys) for (t, column, _), (keys, _) in wanted.items() if t == table]
        marks = [fresh(df, f"wanted_{k}") for k in range(len(sets))]
        said = [seeds[table]] if table in seeds else []
        out = df
        for (column, keys), mark in zip(sets, marks, strict=True):
            side = keys.select(F.col("k").alias(mark))
            out = out.join(side, F.col(f"`{column}`") == F.col(mark), "left")
            said.append(F.col(mark).isNotNull())
        return out.where(reduce(Column.__or__, [F.coalesce(c, F.lit(False)) for c in said])).select(*[F.col(f"`{c}`") for c in df.columns]) if said else None

    def walk(down: bool, grown: set[str]) -> None:
        while grown:
            now: set[str] = set()
            for n, k in enumerate(keys):
                source, column, target, target_key = (k.parent, k.parent_key, k.child, k.child_key) if down else (k.child, k.child_key, k.parent, k.parent_key)
                if source not in grown or (there := rows(source)) is None:
                    continue
                found = there.where(F.col(f"`{column}`").isNotNull()).select(F.col(f"`{column}`").alias("k")).distinct()
                found = stored(found)
                place, size = (target, target_key, f"{'down' if down else 'up'} {n}"), found.count()
                if size != wanted.get(place, (None, 0))[1]:
                    wanted[place] = found, size
                    now.add(target)
            grown = now

    walk(True, set(seeds))
    walk(False, {k.child for k in keys})
    return {t: df.limit(0) if (there := rows(t)) is None else there for t, df in tables.items()}


def by_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in a table of ids; Spark broadcasts the ids if statistics say they are few."""
    return df.join(ids, key, "left_semi")


def every_kth(df: DataFrame, key: str, step: int, start: int = 0) -> DataFrame:
    """Rows whose id is k * step + start: a filter, no join with a number table."""
    return df.where((F.col(key) >= start) & ((F.col(key) - start) % step == 0))


def stable_date(tables: Mapping[str, DataFrame], columns: Mapping[str, str], date: datetime.datetime) -> dict[str, DataFrame]:
    """Every table as known at the date; tables without such a column whole."""
    return {n: known_by(df, date, columns[n]) if n in columns else df for n, df in tables.items()}


def copy_set(tables: Mapping[str, DataFrame], root: str) -> dict[str, DataFrame]:
    """Store a set of (sampled) tables."""
    return {n: write_table(df, root, n) for n, df in tables.items()}
