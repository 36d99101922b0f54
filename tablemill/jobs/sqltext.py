"""SQL text over named tables: single selects, scripts with the objects that they make, functions, parameters."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

#: What statements do to the first name in them, by the node that Spark parses them to.
_EFFECTS = {
    "CreateViewCommand": ("make", "temporary view"), "CreateTempViewUsing": ("make", "temporary view"), "CacheTableAsSelect": ("make", "temporary view"),
    "CreateView": ("make", "view"), "CreateTable": ("make", "table"), "CreateTableAsSelect": ("make", "table"), "CreateTableLikeCommand": ("make", "table"), "CreateTableLike": ("make", "table"),
    "ReplaceTable": ("make", "table"), "ReplaceTableAsSelect": ("make", "table"), "InsertIntoStatement": ("change", "table"), "TruncateTable": ("change", "table"),
    "DeleteFromTable": ("change", "table"), "UpdateTable": ("change", "table"), "MergeIntoTable": ("change", "table"), "RenameTable": ("rename", "table"),
    "DropTable": ("drop", "table"), "DropView": ("drop", "view"), "CreateFunction": ("make", "function"), "CreateSQLFunctionCommand": ("make", "function"),
    "CreateUserDefinedFunction": ("make", "function"), "CreateFunctionCommand": ("make", "function"), "DropFunction": ("drop", "function"), "DropFunctionCommand": ("drop", "function"),
    "SetCatalogAndNamespace": ("use", "database"),
}
#: (database, name), in lower case; the database of temporary objects is "".
Name = tuple[str, str]


def select(spark: SparkSession, query: str, args: Mapping[str, object] | None = None, **tables: DataFrame) -> DataFrame:
    """The rows of a select in which {name} stands for a table and :name for a parameter."""
    return spark.sql(query, args=dict(args) if args else None, **tables)


_TOKEN = r"--[^\n]*|/\*.*?\*/|'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.|\"\")*\"|`(?:[^`]|``)*`"


def statements(script: str) -> list[str]:
    """Statements of a script, split at semicolons outside quotes and comments."""
    parts = re.findall(rf"(?:{_TOKEN}|[^;])+", script, flags=re.S)
    return [p.strip() for p in parts if re.sub(r"--[^\n]*|/\*.*?\*/", "", p, flags=re.S).strip()]


@dataclass(frozen=True)
class Effect:
    """What a statement does: make, change, rename or drop the object of these name parts, or use the database before
    an empty last part."""

    action: str
    kind: str
    parts: tuple[str, ...]
    renamed: tuple[str, ...] = ()


def _seq(names) -> tuple[str, ...]:
    return tuple(names.apply(k) for k in range(names.length()))


def effects(spark: SparkSession, statement: str) -> list[Effect]:
    """What a statement will do to tables, views and functions, from Spark's own parsed plan."""

    def walk(plan) -> Iterator[Effect]:
        kind = plan.getClass().getSimpleName()
        if kind in _EFFECTS:
            action, what = _EFFECTS[kind]
            target = plan.productElement(0)
            if isinstance(target, str):
                parts = (target,)
            elif action == "use":
                parts = (*_seq(target.multipartIdentifier()), "") if _has(target, "multipartIdentifier") else ()
            else:
                parts = _seq(target.multipartIdentifier() if _has(target, "multipartIdentifier") else target.nameParts())
            yield Effect(action, what, parts, _seq(plan.newName()) if action == "rename" else ())
            return
        children = plan.children()
        for k in range(children.length()):
            yield from walk(children.apply(k))

    return list(walk(spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)))


def _has(target, method: str) -> bool:
    return any(m.getName() == method for m in target.getClass().getMethods())


def catalog(spark: SparkSession, databases: set[str]) -> dict[Name, str]:
    """{(database, name): kind} of all tables, views and functions in these databases, and of the temporary ones. Names
    alone are asked for, so that large catalogs cost little."""
    found: dict[Name, str] = {}
    there = {r[0].lower() for r in spark.sql("SHOW DATABASES").collect()}
    for db in sorted(databases & there):
        for r in spark.sql(f"SHOW TABLES IN `{db}`").collect():
            found["" if r["isTemporary"] else db, r["tableName"].lower()] = "temporary view" if r["isTemporary"] else "table"
        for r in spark.sql(f"SHOW VIEWS IN `{db}`").collect():
            if not r["isTemporary"]:
                found[db, r["viewName"].lower()] = "view"
        for r in spark.sql(f"SHOW USER FUNCTIONS IN `{db}`").collect():
            *where, name = r[0].replace("`", "").lower().split(".")
            found[(where[-1] if where else ""), name + "()"] = "function"
    return found


@dataclass
class ScriptRun:
    """What a script did. made, replaced, changed and dropped hold names: plain ones of temporary objects and of the
    database that was in use when it began, database.name of others, with () after functions. tables: the tables and
    views among the first three, to be read. Objects that the script made and dropped itself are in none."""

    statements: int = 0
    made: dict[str, str] = field(default_factory=dict)
    replaced: dict[str, str] = field(default_factory=dict)
    changed: dict[str, str] = field(default_factory=dict)
    dropped: dict[str, str] = field(default_factory=dict)
    tables: dict[str, DataFrame] = field(default_factory=dict)


def execute_script(spark: SparkSession, script: str, **places: str) -> ScriptRun:
    """Run a script's statements, with {{place}} replaced, and say which tables, views and functions it made, replaced,
    changed and dropped.

    What is there is told by the catalog before and after; what was made anew or changed under a name that was there
    before, by the statements' parsed plans. A statement that fails raises; the database in use is then, as after the
    script, that of the beginning.
    """
    for name, value in places.items():
        script = script.replace("{{" + name + "}}", value)
    if left := re.findall(r"\{\{(\w+)\}\}", script):
        raise ValueError(f"no value for {left}")
    home = spark.catalog.currentDatabase()
    todo = [(s, effects(spark, s)) for s in statements(script)]  # a script that can't be parsed does nothing
    databases = {home.lower(), *(e.parts[-2].lower() for _, es in todo for e in es if len(e.parts) > 1)}
    before = catalog(spark, databases)
    temporary = spark._jsparkSession.sessionState().catalog()
    made, changed = set(), set()

    def place(parts: tuple[str, ...], effect: Effect, in_use: str) -> Name:
        """Where a name that a statement uses is."""
        name = parts[-1].lower() + "()" * (effect.kind == "function")
        if len(parts) > 1:
            return parts[-2].lower(), name
        if effect.kind == "function":
            known = catalog(spark, {in_use})
            return ("", name) if ("", name) in known else (in_use, name)
        is_temporary = effect.kind == "temporary view" or (effect.action != "make" and temporary.getTempView(parts[-1]).isDefined())
        return ("" if is_temporary else in_use), name

    try:
        for statement, does in todo:
            in_use = spark.catalog.currentDatabase().lower()
            does = [e for e in does if e.action != "use"]
            wheres = [None if e.action == "make" and e.kind == "function" else place(e.parts, e, in_use) for e in does]
            spark.sql(statement)
            for e, where in zip(does, wheres, strict=True):
                if where is None:  # whether a new function is temporary is known once it is there
                    where = place(e.parts, e, in_use)
                if e.action == "make":
                    made.add(where)
                elif e.action == "change":
                    changed.add(where)
                elif e.action == "rename":
                    made.add(place(e.renamed, e, in_use))
    finally:
        spark.catalog.setCurrentDatabase(home)
    after = catalog(spark, databases)
    said = lambda where: where[1] if where[0] in ("", home.lower()) else ".".join(where)
    out = ScriptRun(len(todo))
    for where, kind in after.items():
        if where not in before:
            out.made[said(where)] = kind
        elif where in made:
            out.replaced[said(where)] = kind
        elif where in changed:
            out.changed[said(where)] = kind
        else:
            continue
        if kind != "function":
            out.tables[said(where)] = spark.table(".".join(f"`{p}`" for p in where if p))
    out.dropped = {said(where): kind for where, kind in before.items() if where not in after}
    return out


def run_script(spark: SparkSession, script: str, **places: str) -> dict[str, DataFrame]:
    """Run a script and return the tables and views that it made, replaced or changed, by name."""
    return execute_script(spark, script, **places).tables


def scalar_function(spark: SparkSession, name: str, parameters: str, returns: str, body: str) -> None:
    """A SQL function that Spark inlines into plans, so it costs no Python."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {body}")
