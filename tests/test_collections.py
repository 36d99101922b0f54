"""Rules over a group of tables in one pass over their keys, against all pairs by brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tablemill.operators import validate
from tablemill.specs import CollectionRules, ColumnRule, CrossRule, TableRules

CONDITIONS = {
    "greater": ("left.b > right.b", lambda a, b: a > b), "turned": ("right.b + 1 >= left.b", lambda a, b: b + 1 >= a), "both": ("left.b < right.b AND left.b * 2 <= right.b + 3", lambda a, b: a < b and a * 2 <= b + 3),
    "equal": ("left.b = right.b", lambda a, b: a == b), "unlike": ("left.b <> right.b", lambda a, b: a != b), "sum": ("left.b + right.b < 4", lambda a, b: a + b < 4),
    "either": ("left.b > right.b OR left.b = 0", lambda a, b: a > b or a == 0),
}


def brute(first, second, holds, equal):
    """(good rows, failed rules of the others) of both, by all pairs of rows."""
    fails = [[[] for _ in side] for side in (first, second)]
    keys = [{k for k, _ in side if k is not None} for side in (first, second)]
    for x, side in enumerate((first, second)):
        for n, (k, _) in enumerate(side):
            if equal and k not in keys[1 - x]:
                fails[x][n].append("equal_primary_keys")
    bad = {k for k, a in first for j, b in second if k == j and k is not None and None not in (a, b) and not holds(a, b)}
    for x, side in enumerate((first, second)):
        for n, (k, _) in enumerate(side):
            if k in bad:
                fails[x][n].append("cross")
    return [[(r, tuple(f)) for r, f in zip(side, fs, strict=True)] for side, fs in zip((first, second), fails, strict=True)]


@pytest.mark.parametrize("name", sorted(CONDITIONS))
def test_collections_by_brute_force(spark, name):
    rnd = random.Random(name)
    condition, holds = CONDITIONS[name]
    value = lambda: (rnd.choice([None, *range(12)]), rnd.choice([None, *range(4)]))
    first, second = [value() for _ in range(25)], [value() for _ in range(20)]
    equal = name in ("greater", "sum", "both")
    rule = TableRules((ColumnRule("b", "int"),))
    rules = CollectionRules({"first": rule, "second": rule}, ("k",), equal_keys=equal, cross=(CrossRule("cross", "first", "second", condition),))
    tables = {"first": spark.createDataFrame(first, "k int, b int"), "second": spark.createDataFrame(second, "k long, b int")}
    good, bad, counts = validate.filter_collection(tables, rules)
    for m, want in zip(("first", "second"), brute(first, second, holds, equal), strict=True):
        assert sorted(map(tuple, good[m].collect()), key=str) == sorted((r for r, f in want if not f), key=str)
        assert sorted(((r["k"], r["b"]), tuple(r["failed_rules"])) for r in bad[m].na.fill(-1).collect()) == sorted((tuple(-1 if v is None else v for v in r), f) for r, f in want if f)
        found = {r["rule"]: r["n"] for r in counts[m].collect()}
        assert found == {n: c for n in ("equal_primary_keys", "cross") if (c := sum(n in f for _, f in want))}


def test_one_shuffle_by_key(spark):
    """A hot key and a null key hold a third of the rows each; no rows of a key meet."""
    n = 30_000
    key = F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 3 == 1, None).otherwise(F.col("id"))
    first, second = (spark.range(n).select(key.alias("k"), (F.col("id") % 100 + shift).alias("b")) for shift in (1000, 0))
    rule = TableRules((ColumnRule("b", "bigint"),))
    rules = CollectionRules({"first": rule, "second": rule}, ("k",), equal_keys=True, cross=(CrossRule("greater", "first", "second", "left.b > right.b"), CrossRule("self", "first", "first", "left.b + 99 >= right.b")))
    passed = {"first": first, "second": second}
    marks, names = validate._key_marks(passed, rules, ["first", "second"])
    plan = marks._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and len(names) == 3
    good, bad, counts = validate.filter_collection(passed, rules)
    assert good["first"].count() == 20_000 and {r["rule"]: r["n"] for r in counts["first"].collect()} == {"equal_primary_keys": 10_000}


def test_optional_members_and_clashing_names(spark):
    rule = TableRules((ColumnRule("n_0", "int", min=0),))
    rules = CollectionRules({"a": rule, "b": rule, "c": rule}, ("key_0",), frozenset({"b", "c"}), equal_keys=True)
    a, c = (spark.createDataFrame(rows, "key_0 int, n_0 int, fails_equal string") for rows in ([(1, 1, "x"), (2, -1, "y")], [(1, 5, None), (3, 5, None)]))
    good, bad, counts = validate.filter_collection({"a": a, "b": None, "c": c}, rules)
    assert [tuple(r) for r in good["c"].collect()] == [(1, 5, None)] and [r["key_0"] for r in good["a"].collect()] == [1] and "b" not in good
    with pytest.raises(ValueError):
        validate.filter_collection({"a": None, "c": c}, rules)
