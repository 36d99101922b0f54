"""Descriptions of tables, views, rules and write options. Plain data: nothing here touches Spark."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any


def table_name(name: str) -> str:
    """Case-folded, stripped, with / as _."""
    return name.strip().casefold().replace("/", "_")


_number = itertools.count()


def mangle_name(name: str | None, task: str, key: str = "") -> str:
    """name, or task_<hash>_<number> where there is none; a trailing %% stands for that suffix."""
    suffix = f"{hashlib.sha256(key.encode()).hexdigest()[:6]}_{next(_number):04d}"
    if name is None:
        return table_name(f"{task}_{suffix}")
    return table_name(name[:-2] + "_" + suffix if name.endswith("%%") else name)


@dataclass(frozen=True)
class SortKey:
    """nulls_first None is Spark's default: first in ascending order, last in descending."""

    column: str
    descending: bool = False
    nulls_first: bool | None = None


@dataclass(frozen=True)
class ViewSpec:
    """A lazy view: tables (or one view) united, sorted by source columns, projected or renamed {new: old}, limited."""

    src: str | ViewSpec | Sequence[str]
    columns: str | Sequence[str] | Mapping[str, str] | None = None
    sort_by: str | SortKey | Sequence[str | SortKey] | None = None
    limit: int | None = None

    def __post_init__(self) -> None:
        if not isinstance(self.src, str | ViewSpec):
            if not self.src:
                raise ValueError("a view needs a source")
            if any(isinstance(s, ViewSpec) for s in self.src):
                raise ValueError("only tables can be united; a view on a view has that view as its one source")
        if self.limit is not None and self.limit < 0:
            raise ValueError("limit is negative")

    def renames(self) -> dict[str, str] | None:
        """{new: old}, or None for all columns."""
        if self.columns is None:
            return None
        if isinstance(self.columns, str):
            return {self.columns: self.columns}
        return dict(self.columns) if isinstance(self.columns, Mapping) else {c: c for c in self.columns}

    def sort_keys(self) -> list[SortKey]:
        if self.sort_by is None:
            return []
        keys = [self.sort_by] if isinstance(self.sort_by, str | SortKey) else self.sort_by
        return [SortKey(k) if isinstance(k, str) else k for k in keys]

    def fuse(self) -> ViewSpec:
        """One view for a chain of views: the outer sort, else the inner one; outer columns translated through inner
        renames; the smaller limit. Not the nested result where an inner sort and limit meet an outer sort."""
        if not isinstance(self.src, ViewSpec):
            return self
        inner = self.src.fuse()
        names, outer = inner.renames(), self.renames()

        def old(name: str) -> str:
            if names is not None and name not in names:
                raise ValueError(f"column {name} is not in the inner view")
            return names[name] if names is not None else name

        columns = names if outer is None else {new: old(c) for new, c in outer.items()}
        sort = [replace(k, column=old(k.column)) for k in self.sort_keys()] or inner.sort_keys()
        limits = [x for x in (self.limit, inner.limit) if x is not None]
        return ViewSpec(inner.src, columns, sort or None, min(limits, default=None))


@dataclass(frozen=True)
class TableSpec:
    """What is known of a table beside its rows. nullable and non_nullable: each alone implies the complement."""

    name: str
    primary_key: Sequence[str] = ()
    type_map: Mapping[str, str] = field(default_factory=dict)
    nullable: Sequence[str] | None = None
    non_nullable: Sequence[str] | None = None

    def null_flags(self, columns: Sequence[str]) -> dict[str, bool]:
        """{column: may be null} by the complement rules; a key column is never null where nothing else is said."""
        for said in (self.nullable, self.non_nullable):
            if said is not None and (isinstance(said, str) or not isinstance(said, Sequence)):
                raise TypeError("nullable and non_nullable are lists of column names")
        yes, no = (None if x is None else set(x) for x in (self.nullable, self.non_nullable))
        if unknown := ((yes or set()) | (no or set())) - set(columns):
            raise ValueError(f"no such columns: {sorted(unknown)}")
        if yes is not None and no is not None:
            if yes & no:
                raise ValueError(f"both nullable and not: {sorted(yes & no)}")
            if missing := set(columns) - yes - no:
                raise ValueError(f"neither nullable nor not: {sorted(missing)}")
        if yes is None and no is None:
            return {c: c not in self.primary_key for c in columns}
        return {c: (c in yes if yes is not None else c not in no) for c in columns}


@dataclass(frozen=True)
class WriteOptions:
    """Options of a table, by label; the label __any__ holds defaults for all."""

    by_label: Mapping[str, Mapping[str, Any]]

    def resolve(self, label: str | None = None) -> dict[str, Any]:
        """compression, partitions, sort_by: those of the label over the defaults."""
        if label is not None and label not in self.by_label:
            raise KeyError(label)
        return {**self.by_label.get("__any__", {}), **(self.by_label[label] if label else {})}


@dataclass(frozen=True)
class ColumnRule:
    """A typed column: SQL type, whether null is allowed, bounds and allowed values."""

    name: str
    type: str
    nullable: bool = True
    min: Any = None
    max: Any = None
    values: Sequence[Any] | None = None


@dataclass(frozen=True)
class TableRules:
    """Column rules and a key; a + b holds the rules of both, those of b in place of equally named ones of a."""

    columns: Sequence[ColumnRule]
    primary_key: Sequence[str] = ()

    def __add__(self, other: TableRules) -> TableRules:
        own = {c.name: c for c in self.columns} | {c.name: c for c in other.columns}
        return TableRules(tuple(own.values()), tuple(dict.fromkeys([*self.primary_key, *other.primary_key])))


@dataclass(frozen=True)
class CrossRule:
    """A condition (SQL over left.<column> and right.<column>) on rows of two members with the same common key."""

    name: str
    left: str
    right: str
    condition: str


@dataclass(frozen=True)
class CollectionRules:
    """Rules for a group of tables. Members in optional may be missing; equal_keys asks for each key in every member."""

    members: Mapping[str, TableRules]
    common_key: Sequence[str]
    optional: frozenset[str] = frozenset()
    equal_keys: bool = False
    cross: Sequence[CrossRule] = ()

    def __add__(self, other: CollectionRules) -> CollectionRules:
        return CollectionRules(
            {**self.members, **other.members}, tuple(dict.fromkeys([*self.common_key, *other.common_key])),
            self.optional | other.optional, self.equal_keys or other.equal_keys, (*self.cross, *other.cross),
        )
