"""Scripts: what they make, replace, change and drop, by the catalog and Spark's parsed plans."""

import uuid

import pytest

from tablemill.jobs.sqltext import Effect, effects, execute_script, run_script, statements


@pytest.fixture
def db(spark, tmp_path):
    name = f"script_{uuid.uuid4().hex[:10]}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{tmp_path}/{name}'")
    yield name
    spark.sql(f"DROP DATABASE {name} CASCADE")


def test_statements_end_outside_quotes_and_comments():
    script = """-- a; b
        SELECT ';', "x;y", `c;d`; /* e; f */ SELECT 'it\\'s; here', 'so''s; this';;
        -- only a comment;
    """
    assert [s.split("\n")[-1].strip() for s in statements(script)] == ["""SELECT ';', "x;y", `c;d`""", "/* e; f */ SELECT 'it\\'s; here', 'so''s; this'"]


def test_effects_by_parsed_plan(spark):
    found = {
        "/* n */ -- m\nCREATE OR REPLACE TEMP VIEW `v 1` AS SELECT 1": [Effect("make", "temporary view", ("v 1",))],
        "create table if not exists d.t using parquet as select 1": [Effect("make", "table", ("d", "t"))],
        "FROM a INSERT INTO b SELECT * INSERT INTO d.c SELECT *": [Effect("change", "table", ("b",)), Effect("change", "table", ("d", "c"))],
        "WITH x AS (SELECT 1) INSERT OVERWRITE t SELECT * FROM x": [Effect("change", "table", ("t",))],
        "ALTER TABLE t RENAME TO u": [Effect("rename", "table", ("t",), ("u",))],
        "DROP VIEW IF EXISTS v": [Effect("drop", "view", ("v",))],
        "CREATE TEMPORARY FUNCTION f(x INT) RETURNS INT RETURN x": [Effect("make", "function", ("f",))],
        "SELECT 'CREATE TABLE x'": [],
    }
    for statement, want in found.items():
        assert effects(spark, statement) == want, statement


def test_objects_of_a_script(spark, db):
    spark.sql(f"CREATE TABLE {db}.old USING parquet AS SELECT 1 AS x")
    spark.sql(f"CREATE TABLE {db}.more USING parquet AS SELECT 1 AS x")
    spark.sql(f"CREATE VIEW {db}.seen AS SELECT 1 AS x")
    spark.range(3).createOrReplaceTempView("temporary_before")
    before = spark.catalog.currentDatabase()
    ran = execute_script(spark, """
        USE {{db}};
        /* note */ CREATE OR REPLACE TEMP VIEW script_v1 AS SELECT 1 AS x;
        CREATE TABLE Made_T USING parquet AS SELECT 1 AS x UNION ALL SELECT 2;
        CREATE OR REPLACE VIEW `seen` AS SELECT * FROM made_t;
        INSERT INTO more VALUES (2);
        CREATE TABLE away USING parquet AS SELECT 1 AS x;
        ALTER TABLE away RENAME TO kept;
        CREATE OR REPLACE TEMP VIEW temporary_before AS SELECT 'a' AS y;
        CREATE TEMPORARY FUNCTION script_f(x INT) RETURNS INT RETURN x + 1;
        DROP TABLE IF EXISTS old; DROP TABLE IF EXISTS never_there;
    """, db=db)  # fmt: skip
    assert ran.made == {"script_v1": "temporary view", f"{db}.made_t": "table", f"{db}.kept": "table", "script_f()": "function"}
    assert ran.replaced == {f"{db}.seen": "view", "temporary_before": "temporary view"}
    assert ran.changed == {f"{db}.more": "table"} and ran.dropped == {f"{db}.old": "table"} and ran.statements == 11
    assert {n: t.count() for n, t in ran.tables.items()} == {"script_v1": 1, f"{db}.made_t": 2, f"{db}.kept": 1, f"{db}.seen": 2, "temporary_before": 1, f"{db}.more": 2}
    assert spark.catalog.currentDatabase() == before
    for name in ("script_v1", "temporary_before"):
        spark.catalog.dropTempView(name)
    spark.sql("DROP TEMPORARY FUNCTION script_f")


def test_views_of_a_script_are_handed_on(spark):
    made = run_script(spark, "-- x; y\nCREATE OR REPLACE TEMP VIEW handed AS SELECT * FROM {{what}}", what="VALUES (1), (2)")
    assert made["handed"].count() == 2
    assert run_script(spark, "CREATE OR REPLACE TEMP VIEW handed AS SELECT 1 AS x")["handed"].columns == ["x"]
    spark.catalog.dropTempView("handed")
    with pytest.raises(ValueError):
        run_script(spark, "SELECT {{nothing}}")


def test_a_script_that_fails(spark, db):
    """Text that can't be parsed does nothing at all; a statement that fails leaves those before it, and the database."""
    with pytest.raises(Exception, match="PARSE|parse"):
        execute_script(spark, "CREATE TABLE {{db}}.t USING parquet AS SELECT 1 AS x; CREATE NONSENSE", db=db)
    assert not spark.catalog.tableExists(f"{db}.t")
    before = spark.catalog.currentDatabase()
    with pytest.raises(Exception, match="no_such_table"):
        execute_script(spark, "USE {{db}}; CREATE TABLE t USING parquet AS SELECT 1 AS x; SELECT * FROM no_such_table", db=db)
    assert spark.catalog.tableExists(f"{db}.t") and spark.catalog.currentDatabase() == before
