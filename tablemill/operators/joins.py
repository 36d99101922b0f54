"""Joins on keys. Sides are left to Spark's statistics: it broadcasts a small one and splits skewed partitions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablemill.scratch import fresh

Keys = str | Sequence[str]


def _keys(keys: Keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def left_join_pk(left: DataFrame, right: DataFrame, keys: Keys) -> DataFrame:
    """Every row of left with its partner in right, the key once."""
    return left.join(right, _keys(keys), "left")


def inner_join(left: DataFrame, right: DataFrame, keys: Keys) -> DataFrame:
    return left.join(right, _keys(keys))


def missing_keys(left: DataFrame, right: DataFrame, keys: Keys, reason: str) -> DataFrame:
    """Distinct keys of left that right lacks, with the reason. The distinct comes first: it is what the join shuffles."""
    return left.select(*_keys(keys)).distinct().join(right, _keys(keys), "left_anti").withColumn("reason", F.lit(reason))


def rows_with_keys(df: DataFrame, keyed: DataFrame, keys: Keys) -> DataFrame:
    """Rows of df whose key occurs in keyed."""
    return df.join(keyed, _keys(keys), "left_semi")


def full_join(left: DataFrame, right: DataFrame, keys: Keys, extra: Column | None = None) -> DataFrame:
    """All rows of both; keys from whichever side has them. extra: a further condition over columns that only one side
    has, or that are qualified by the aliases l and r. Other columns of both sides' name are an error."""
    left, right, names = left.alias("l"), right.alias("r"), _keys(keys)
    if both := ({c.lower() for c in left.columns} & {c.lower() for c in right.columns}) - {k.lower() for k in names}:
        raise ValueError(f"in both tables: {sorted(both)}")
    on = [F.col(f"l.`{k}`") == F.col(f"r.`{k}`") for k in names]
    joined = left.join(right, [*on, *([extra] if extra is not None else [])], "full")
    own = [F.coalesce(F.col(f"l.`{k}`"), F.col(f"r.`{k}`")).alias(k) for k in names]
    rest = [F.col(f"{side}.`{c}`") for side, df in (("l", left), ("r", right)) for c in df.columns if c not in names]
    return joined.select(*own, *rest)


#: Values of a band join are at most so many tolerances from zero: further out, doubles can't tell neighbouring bins.
MOST_BINS = 1 << 32


def conflicting_pairs(df: DataFrame, keys: Keys, column: str, condition: Column | None = None, within: tuple[str, float] | None = None) -> DataFrame:
    """Pairs (l, r) of rows with equal keys that differ in column, and that meet the condition. Rows that agree in all
    columns count once; null keys and null values conflict with nothing.

    within: (column, tolerance), for pairs whose values of that column differ by less than the tolerance. Then values are
    dealt into bins as wide as the tolerance and a row meets those of its own and the two neighbouring bins: a key that
    many rows have is spread over its bins, and what is joined is about what is near. Without it the keys alone drive the
    shuffle, and all pairs of a key are looked at.
    """
    names = _keys(keys)
    rows = df.distinct()
    differ = F.col(f"l.`{column}`") != F.col(f"r.`{column}`")
    rest = [differ] if condition is None else [differ, condition]
    if within is None:
        return rows.alias("l").join(rows.alias("r"), [*[F.col(f"l.`{k}`") == F.col(f"r.`{k}`") for k in names], *rest])
    measure, tolerance = within
    if not tolerance > 0:
        raise ValueError("a tolerance is above zero")
    value, bin_name = F.col(f"`{measure}`").cast("double"), fresh(df, "value_bin")
    usable = reduce(Column.__and__, [F.col(f"`{k}`").isNotNull() for k in names], (F.abs(value) < float("inf")) & F.col(f"`{column}`").isNotNull())
    # A little wider than the tolerance, so that rounding parts no near values by two bins.
    place = value / F.lit(float(tolerance) * (1 + 2.0**-20))
    far = F.raise_error(F.concat(F.lit(f"{measure} is too far from zero for that tolerance: "), value.cast("string"))).cast("long")
    place = F.when(F.abs(place) < MOST_BINS, F.floor(place)).otherwise(far)
    left = rows.where(usable).withColumn(bin_name, place)
    right = left.withColumn(bin_name, F.explode(F.sequence(F.col(bin_name) - 1, F.col(bin_name) + 1)))
    on = [F.col(f"l.`{k}`") == F.col(f"r.`{k}`") for k in [*names, bin_name]]
    near = F.abs(F.col(f"l.`{measure}`") - F.col(f"r.`{measure}`")) < tolerance
    joined = left.alias("l").join(right.alias("r"), [*on, near, *rest])
    return joined.drop(F.col(f"l.`{bin_name}`"), F.col(f"r.`{bin_name}`"))


def enrich_with_aggregate(df: DataFrame, keys: Keys, **aggregates: Column) -> DataFrame:
    """Each row with aggregates over its key; null is a key like any other. The aggregate is a small table, so this
    joins rather than windows: a window would sort all rows and hold a hot key in one task."""
    names = _keys(keys)
    own = {k: fresh(df, f"of_{k}") for k in names}
    per = df.groupBy(*[F.col(f"`{k}`").alias(own[k]) for k in names]).agg(*[a.alias(n) for n, a in aggregates.items()])
    match = [F.col(f"l.`{k}`").eqNullSafe(F.col(f"r.`{own[k]}`")) for k in names]
    return df.alias("l").join(per.alias("r"), match, "left").select("l.*", *[F.col(f"r.`{n}`") for n in aggregates])


def enrich_with_window(df: DataFrame, keys: Keys, **aggregates: Column) -> DataFrame:
    """The same by a window: one shuffle, for keys that are many and even."""
    return df.withColumns({n: a.over(Window.partitionBy(*_keys(keys))) for n, a in aggregates.items()})


def cross_join_small(left: DataFrame, right: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """Every pair of rows of two small tables; raises if the product exceeds max_rows."""
    if (n := left.limit(max_rows + 1).count() * right.limit(max_rows + 1).count()) > max_rows:
        raise ValueError(f"a cross join of {n} rows or more")
    return left.crossJoin(right)


def combine_features(tables: Sequence[DataFrame], keys: Keys) -> DataFrame:
    """Feature tables of one key side by side, left to right, the key once; equal names are an error."""
    out = tables[0]
    for df in tables[1:]:
        if both := (set(out.columns) & set(df.columns)) - set(_keys(keys)):
            raise ValueError(f"in several feature tables: {sorted(both)}")
        out = left_join_pk(out, df, keys)
    return out


def join_versions(current: DataFrame, other: DataFrame, keys: Keys, suffix: str = "_before", how: str = "left") -> DataFrame:
    """Rows of one version with those of another; columns of the other get the suffix."""
    names = _keys(keys)
    return current.join(other.select(*names, *[F.col(c).alias(c + suffix) for c in other.columns if c not in names]), names, how)
