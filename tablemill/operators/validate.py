"""Validation: all rules of a table in one pass, good rows, bad rows with the names of failed rules, counts.

Rule names: <column>|dtype, |nullability, |min, |max, |enum, and _primary_key_. A row with a repeated or null key fails
the key rule, and so do all rows of that key. A value that is lost by its cast fails dtype and the other rules don't see
it; null passes bounds and enums. A cast to whole numbers cuts a fraction off, as Spark's casts do, and that is no failure.

Where rows are stored anyway, row count, content hash and failures of rules are observed in the pass that writes them
(write_audited), so a source is evaluated once, and the figures are those of the rows as they were written.
"""

from __future__ import annotations

import logging
from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tablemill.operators.aggregates import content_hash, hash_measures
from tablemill.operators.windows import mark_duplicates
from tablemill.scratch import broadcast_if_small, fresh, new_path, stored
from tablemill.specs import CollectionRules, ColumnRule, TableRules, TableSpec

KEY_RULE = "_primary_key_"
log = logging.getLogger(__name__)


class ValidationError(ValueError):
    """Rows break the rules. counts: {rule: failed rows}; samples: a few of them."""

    def __init__(self, counts: dict[str, int], samples: list) -> None:
        super().__init__(f"{sum(counts.values())} failures: {counts}; such as {samples}")
        self.counts, self.samples = counts, samples


def column_failures(rule: ColumnRule) -> dict[str, Column]:
    raw = F.col(f"`{rule.name}`")
    value = raw.try_cast(rule.type)
    failed = {f"{rule.name}|dtype": raw.isNotNull() & value.isNull()}
    if not rule.nullable:
        failed[f"{rule.name}|nullability"] = raw.isNull()
    if rule.min is not None:
        failed[f"{rule.name}|min"] = F.coalesce(value < F.lit(rule.min), F.lit(False))
    if rule.max is not None:
        failed[f"{rule.name}|max"] = F.coalesce(value > F.lit(rule.max), F.lit(False))
    if rule.values is not None:
        failed[f"{rule.name}|enum"] = F.coalesce(~value.isin(list(rule.values)), F.lit(False))
    return failed


def rule_names(rules: TableRules) -> list[str]:
    return [n for c in rules.columns for n in column_failures(c)] + [KEY_RULE] * bool(rules.primary_key)


def check(df: DataFrame, rules: TableRules) -> tuple[DataFrame, str]:
    """df with one array column more (its name is returned): the names of the rules that the row fails.

    One scan. Only a key rule shuffles, and only counts of keys.
    """
    failed = {n: f for c in rules.columns for n, f in column_failures(c).items()}
    if rules.primary_key:
        dup = fresh(df, "key_repeated")
        df = mark_duplicates(df, rules.primary_key, dup)
        null = reduce(Column.__or__, [F.col(f"`{k}`").isNull() for k in rules.primary_key])
        failed[KEY_RULE] = F.col(dup) | null
    name = fresh(df, "failed_rules")
    out = df.withColumn(name, F.array_compact(F.array(*[F.when(f, F.lit(n)) for n, f in failed.items()]).cast("array<string>")))
    return (out.drop(dup) if rules.primary_key else out), name


def filter_rows(df: DataFrame, rules: TableRules, cast: bool = True) -> tuple[DataFrame, DataFrame]:
    """(good, bad): good rows under the declared types, bad ones as they are with their failed_rules."""
    checked, failed = check(df, rules)
    types = {c.name: c.type for c in rules.columns} if cast else {}
    good = checked.where(F.size(failed) == 0).drop(failed)
    good = good.select(*[F.col(f"`{c}`").try_cast(types[c]).alias(c) if c in types else F.col(f"`{c}`") for c in df.columns])
    return good, checked.where(F.size(failed) > 0)


def failure_counts(df: DataFrame, rules: TableRules) -> DataFrame:
    """(rule, n) of the rules that rows fail."""
    checked, failed = check(df, rules)
    return checked.select(F.explode(failed).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


def is_valid(df: DataFrame, rules: TableRules) -> bool:
    checked, failed = check(df, rules)
    return checked.where(F.size(failed) > 0).limit(1).count() == 0


@dataclass(frozen=True)
class Audited:
    """What was seen of the rows while they were written: failures are {rule: rows that fail it}, without zeros."""

    row_count: int
    content_hash: str
    failures: dict[str, int] = field(default_factory=dict)

    @property
    def key(self) -> str:
        """As content_key() of the stored table."""
        return f"{self.row_count}:{self.content_hash}"


def write_audited(df: DataFrame, path: str, rules: TableRules | None = None, mark: str | None = None) -> Audited:
    """Store df as parquet at path and say what was written.

    One evaluation of df. Only a key rule needs all keys at once: it reads the key columns of what is stored. mark: the
    name of an array column to store with each row, the column rules that it fails (the key rule isn't in it).
    """
    failed = {n: f for c in rules.columns for n, f in column_failures(c).items()} if rules else {}
    measures = hash_measures([F.col(f"`{c}`") for c in df.columns])
    counts = {f"rule_{k}": F.count(F.when(f, 1)) for k, f in enumerate(failed.values())}
    seen = Observation()
    rows = df.observe(seen, *[c.alias(n) for n, c in (measures | counts).items()])
    if mark:
        names = F.array_compact(F.array(*[F.when(f, F.lit(n)) for n, f in failed.items()]).cast("array<string>"))
        rows = rows.withColumn(mark, names)
    rows.write.option("compression", "zstd").parquet(path)
    said = seen.get
    failures = {n: said[f"rule_{k}"] for k, n in enumerate(failed)}
    if rules and rules.primary_key:
        failures[KEY_RULE] = key_failures(df.sparkSession.read.schema(rows.schema).parquet(path), rules)
    return Audited(said["row_count"], content_hash(said), {n: k for n, k in failures.items() if k})


def key_failures(stored: DataFrame, rules: TableRules) -> int:
    """Rows whose key is null or there more than once; only key columns are read, and only counts of keys shuffled."""
    keys = [F.col(f"`{k}`") for k in rules.primary_key]
    null = F.exists(F.array(*[k.isNull() for k in keys]), lambda x: x)
    n = "n_rows" if "n_rows" not in rules.primary_key else "n_rows_of_key"
    per = stored.groupBy(*keys).agg(F.count("*").alias(n))
    return per.agg(F.coalesce(F.sum(F.when((F.col(n) > 1) | null, F.col(n))), F.lit(0)).alias("n")).first()["n"]


def split_audited(df: DataFrame, path: str, rules: TableRules) -> tuple[DataFrame, DataFrame, Audited]:
    """(good, bad, audited): df stored once at path, and read from there: good rows under the declared types, bad ones as
    they are with their failed_rules."""
    mark = fresh(df, "failed_rules")
    said = write_audited(df, path, rules, mark)
    rows = df.sparkSession.read.parquet(path)
    if said.failures.get(KEY_RULE):
        dup = fresh(rows, "key_repeated")
        rows = mark_duplicates(rows, rules.primary_key, dup)
        null = F.exists(F.array(*[F.col(f"`{k}`").isNull() for k in rules.primary_key]), lambda x: x)
        rows = rows.withColumn(mark, F.when(F.col(dup) | null, F.array_append(mark, F.lit(KEY_RULE))).otherwise(F.col(mark))).drop(dup)
    types = {c.name: c.type for c in rules.columns}
    good = rows.where(F.size(mark) == 0).select(*[F.col(f"`{c}`").try_cast(types[c]).alias(c) if c in types else F.col(f"`{c}`") for c in df.columns])
    return good, rows.where(F.size(mark) > 0), said


def validate(df: DataFrame, rules: TableRules, mode: str = "raise") -> DataFrame:
    """df, cast to the declared types. mode: raise on failures, log them, or off.

    df is evaluated once: its rows are stored with the rules that each fails, and counted as they are written. Counts,
    samples and the result come from what is stored.
    """
    if mode not in ("raise", "log", "off"):
        raise ValueError(mode)
    if mode == "off":
        return filter_rows(df, rules)[0]
    good, bad, said = split_audited(df, new_path(df.sparkSession), rules)
    if said.failures:
        error = ValidationError(said.failures, bad.limit(5).collect())
        if mode == "raise":
            raise error
        log.warning("%s", error)
    return good


def check_nulls(df: DataFrame, spec: TableSpec) -> TableRules:
    """The rules that a table's null flags and key amount to, for its columns as they are typed."""
    flags = spec.null_flags(df.columns)
    return TableRules(tuple(ColumnRule(f.name, f.dataType.simpleString(), nullable=flags[f.name]) for f in df.schema), tuple(spec.primary_key))


def filter_collection(tables: Mapping[str, DataFrame | None], rules: CollectionRules) -> tuple[dict[str, DataFrame], dict[str, DataFrame], dict[str, DataFrame]]:
    """(good, bad, counts) by member. Member rules first; rules over keys and pairs see the rows that passed those, each
    independently, and a row goes if it fails any."""
    key = list(rules.common_key)
    if missing := [m for m in rules.members if tables.get(m) is None and m not in rules.optional]:
        raise ValueError(f"members missing: {missing}")
    there = [m for m in rules.members if tables.get(m) is not None]
    passed, bad, counts = {}, {}, {}
    for m in there:
        checked, failed = check(tables[m], rules.members[m])
        checked = stored(checked.withColumnRenamed(failed, "failed_rules"))
        types = {c.name: c.type for c in rules.members[m].columns}
        good = checked.where(F.size("failed_rules") == 0)
        passed[m] = good.select(*[F.col(f"`{c}`").try_cast(types[c]).alias(c) if c in types else F.col(f"`{c}`") for c in tables[m].columns])
        bad[m] = checked.where(F.size("failed_rules") > 0)
    marks, names = _key_marks(passed, rules, there)
    marks = broadcast_if_small(stored(marks)) if names else marks
    good = {}
    for m in there:
        rows, mark = passed[m], {n: fresh(passed[m], f"mark_{n}") for n in (*names, *key)}
        own = {n: rule for n, (rule, members) in names.items() if m in members}
        if own:
            side = marks.select(*[F.col(c).alias(mark[c]) for c in (*own, *key)])
            on = reduce(Column.__and__, [F.col(f"`{k}`").eqNullSafe(F.col(mark[k])) for k in key])  # null is a key here
            rows = rows.join(side, on, "left")
        failed = F.array_compact(F.array(*[F.when(F.col(mark[n]), F.lit(rule)) for n, rule in own.items()]).cast("array<string>"))
        name = fresh(tables[m], "failed_rules")
        marked = rows.select(*[F.col(f"`{c}`") for c in tables[m].columns], failed.alias(name))
        good[m] = marked.where(F.size(name) == 0).drop(name)
        more = marked.where(F.size(name) > 0)
        counts[m] = bad[m].select("failed_rules").unionByName(more.select(F.col(name).alias("failed_rules"))).select(F.explode("failed_rules").alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))
        as_read = [F.col(f"`{c}`").cast(tables[m].schema[c].dataType).alias(c) for c in tables[m].columns]
        bad[m] = bad[m].unionByName(more.select(*as_read, F.col(name).alias("failed_rules")))
    return good, bad, counts


#: Comparisons of which all pairs of a key hold if the outermost values of both sides do: (of left, of right, SQL).
_ORDERED = {"GreaterThan": ("min", "max", ">"), "GreaterThanOrEqual": ("min", "max", ">="), "LessThan": ("max", "min", "<"), "LessThanOrEqual": ("max", "min", "<=")}


def _conjuncts(tables: Mapping[str, DataFrame], rule: CrossRule) -> list[tuple[str, Column, Column]] | None:
    """The condition of a rule as comparisons of something of left with something of right of one type: (kind, left,
    right) each; None if it is no conjunction of such."""
    left, right = tables[rule.left].alias("left"), tables[rule.right].alias("right")
    parser, out = left.sparkSession._jsparkSession.sessionState().sqlParser(), []
    turned = {"GreaterThan": "LessThan", "GreaterThanOrEqual": "LessThanOrEqual", "LessThan": "GreaterThan", "LessThanOrEqual": "GreaterThanOrEqual", "EqualTo": "EqualTo"}

    def sides(node) -> set[str]:
        if node.getClass().getSimpleName() == "UnresolvedAttribute":
            return {node.nameParts().head().lower() if node.nameParts().length() > 1 else ""}
        return {x for k in range(node.children().length()) for x in sides(node.children().apply(k))}

    def walk(node) -> bool:
        kind = node.getClass().getSimpleName()
        if kind == "And":
            return walk(node.left()) and walk(node.right())
        if kind not in turned:
            return False
        a, b = node.left(), node.right()
        if (sides(a), sides(b)) == ({"right"}, {"left"}):
            a, b, kind = b, a, turned[kind]
        elif (sides(a), sides(b)) != ({"left"}, {"right"}):
            return False
        said = F.expr(a.sql()), F.expr(b.sql())
        if left.select(said[0]).schema[0].dataType != right.select(said[1]).schema[0].dataType:
            return False
        out.append((kind, *said))
        return True

    return out if walk(parser.parseExpression(rule.condition)) else None


def _key_marks(passed: Mapping[str, DataFrame], rules: CollectionRules, there: list[str]) -> tuple[DataFrame, dict[str, tuple[str, set[str]]]]:
    """(marks, names): a row for each common key that fails a rule over keys or pairs, with one boolean column for each
    rule; names: {column: (rule, members that it concerns)}.

    One aggregation over the keys of all members together, pre-aggregated in every task: how often each member has the
    key, and for comparisons of two members the outermost values of both. So no rows of a key meet, however many there
    are. A condition that isn't made of comparisons is tried on all pairs of a key.
    """
    key = list(rules.common_key)
    cross = [r for r in rules.cross if r.left in passed and r.right in passed]
    said = {k: _conjuncts(passed, r) for k, r in enumerate(cross)}
    cells = {f"{side}_{k}_{n}": (getattr(r, side), expr) for k, r in enumerate(cross) for n, (_, *both) in enumerate(said[k] or []) for side, expr in zip(("left", "right"), both, strict=True)}
    types = {c: passed[m].alias(c.split("_")[0]).select(e).schema[0].dataType for c, (m, e) in cells.items()}
    parts = []
    for tag, m in enumerate(there):
        keys = [F.col(f"`{k}`").alias(f"key_{n}") for n, k in enumerate(key)]
        for side in ("left", "right"):
            # A member may be both sides of a rule; then its rows are counted as the first.
            own = [(e if m == of and c.startswith(side) else F.lit(None).cast(types[c])).alias(c) for c, (of, e) in cells.items()]
            if side == "left" or any(m == of and c.startswith(side) for c, (of, _) in cells.items()):
                parts.append(passed[m].alias(side).select(F.lit(tag if side == "left" else -1).alias("tag"), *keys, *own))
    keys = [f"key_{n}" for n in range(len(key))]
    found = {f"n_{tag}": F.count(F.when(F.col("tag") == tag, 1)) for tag in range(len(there))} | {f"{f}_{c}": getattr(F, f)(c) for c in cells for f in ("min", "max")}
    names: dict[str, tuple[str, set[str]]] = {}
    fails: dict[str, Column] = {}
    null = reduce(Column.__or__, [F.col(k).isNull() for k in keys])
    if rules.equal_keys:
        names["fails_equal"] = ("equal_primary_keys", set(there))
        fails["fails_equal"] = reduce(Column.__or__, [F.col(f"n_{t}") == 0 for t, m in enumerate(there) if m not in rules.optional], null)
    for k, rule in enumerate(cross):
        names[f"fails_{k}"] = (rule.name, {rule.left, rule.right})
        holds = []
        for n, (kind, *_) in enumerate(said[k] or []):
            low, high = ([F.col(f"{f}_{side}_{k}_{n}") for side in ("left", "right")] for f in ("min", "max"))
            if kind == "EqualTo":
                holds += [low[0] == high[1], high[0] == low[1]]
            else:
                of_left, of_right, op = _ORDERED[kind]
                holds.append(F.expr(f"{of_left}_left_{k}_{n} {op} {of_right}_right_{k}_{n}"))
        # What is null holds, and null is no partner of null.
        fails[f"fails_{k}"] = ~null & ~reduce(Column.__and__, [F.coalesce(h, F.lit(True)) for h in holds], F.lit(True))
    per = reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(*[c.alias(n) for n, c in found.items()])
    marks = per.select(*keys, *[c.alias(n) for n, c in fails.items()])
    for k, rule in enumerate(cross):
        if said[k] is None:
            on = reduce(Column.__and__, [F.col(f"left.`{c}`") == F.col(f"right.`{c}`") for c in key])
            pairs = passed[rule.left].alias("left").join(passed[rule.right].alias("right"), on)
            bad = pairs.where(~F.expr(rule.condition)).select(*[F.col(f"left.`{c}`").alias(n) for n, c in zip(keys, key, strict=True)], F.lit(True).alias("pair_fails")).distinct()
            marks = marks.join(bad, keys, "left").withColumn(f"fails_{k}", F.coalesce("pair_fails", F.lit(False))).drop("pair_fails")
    failing = marks.where(reduce(Column.__or__, [F.col(n) for n in fails], F.lit(False)))
    return failing.select(*[F.col(n).alias(k) for n, k in zip(keys, key, strict=True)], *fails), names
