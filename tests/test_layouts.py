"""Buckets, ranges and database tables: what is shuffled, which files are read, how even the parts are."""

import datetime
import uuid

import duckdb
import pytest
from pyspark.sql import functions as F

from tablemill.operators import joins
from tablemill.sources import database, layout
from tablemill.sources import tables as store

DERBY = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    stem = f"t{uuid.uuid4().hex[:10]}"
    frames = [spark.range(0, 4000, n).select("id", (F.col("id") * n).alias(f"x{n}")) for n in (1, 2, 3)]
    tables = [layout.write_bucketed(df, f"{stem}_{k}", "id", 6, f"{tmp_path}/{k}") for k, df in enumerate(frames)]
    spark.conf.set(threshold, "-1")
    try:
        joined = joins.combine_features(tables, "id")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("SortMergeJoin") == 2
        want = joins.combine_features(frames, "id")
        assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, want.collect()))
    finally:
        spark.conf.set(threshold, before)
        for k in range(3):
            spark.sql(f"DROP TABLE {stem}_{k}")


@pytest.fixture
def days(spark, tmp_path):
    rows = spark.range(4000).select("id", F.expr("CASE WHEN id % 50 <> 0 THEN date_add(DATE '2020-01-01', CAST(id * 7919 % 1000 AS INT)) END").alias("day"))
    layout.write_by_range(rows, path := f"{tmp_path}/days.parquet", "day", 10)
    return rows, path


@pytest.mark.parametrize("low, high, nulls", [
    (datetime.date(2021, 3, 1), datetime.date(2021, 3, 31), False), (None, datetime.date(2020, 1, 5), False), (datetime.date(2022, 9, 1), None, True), (None, None, True), (None, None, False),
    (datetime.date(2030, 1, 1), None, False), (datetime.date(2020, 5, 2), datetime.date(2020, 5, 1), False),
])
def test_ranges_read_the_files_that_can_match(spark, days, low, high, nulls):
    rows, path = days
    found = layout.read_range(spark, path, "day", low, high, nulls)
    within = lambda d: nulls if d is None else (low is None or d >= low) and (high is None or d <= high)
    assert sorted(map(tuple, found.collect())) == sorted(tuple(r) for r in rows.collect() if within(r["day"]))
    listed = layout.ranges(spark, path).collect()
    want = [r for r in listed if nulls and r["null_count"] or (low is None or r["high"] and r["high"] >= low) and (high is None or r["low"] and r["low"] <= high) and r["low"]]
    if want:
        assert len(found.inputFiles()) == len(want)
    if low and high:
        assert len(want) <= 2 < len(listed)


def test_files_that_are_not_listed_are_read(spark, days):
    rows, path = days
    more = spark.createDataFrame([(9999, datetime.date(2021, 3, 5))], rows.schema)
    more.write.mode("append").parquet(path)
    day = datetime.date(2021, 3, 5)
    assert 9999 in {r["id"] for r in layout.read_range(spark, path, "day", day, day).collect()}
    layout.list_ranges(spark, path, "day")
    assert layout.ranges(spark, path).agg(F.sum("row_count")).first()[0] == 4001
    assert 9999 in {r["id"] for r in layout.read_range(spark, path, "day", day, day).collect()}


@pytest.fixture
def url():
    return f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"


@pytest.mark.parametrize("key", ["cube", "name", "day", "at"])
def test_even_parts_of_a_skewed_key(spark, url, key):
    """Parts are within 20 % of each other for numbers, texts, dates and times; every row is in one, those without a key too."""
    rows = spark.range(2000).select(
        F.col("id").alias("k"), F.when(F.col("id") >= 40, F.pow("id", F.lit(3)).cast("long")).alias("cube"), F.concat(F.lit("it's "), F.sha2(F.col("id").cast("string"), 256)).alias("name"),
        F.expr("date_add(DATE '2020-01-01', CAST(floor(sqrt(id)) AS INT))").alias("day"), F.expr("timestamp_ntz '2020-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id * id)").alias("at"),
    )
    store.write_jdbc(rows, url, "t", driver=DERBY, column_types="name VARCHAR(100)")
    back = database.read_jdbc_evenly(spark, url, "t", f'"{key}"', 5, DERBY)
    sizes = [r["count"] for r in back.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) == 5 == back.rdd.getNumPartitions() and max(sizes) <= 1.2 * min(sizes)
    assert sorted(r["k"] for r in back.collect()) == list(range(2000))


def test_parts_whatever_the_order_of_the_database():
    """Cuts that the database orders otherwise still part the rows: each meets one condition."""
    values, cuts = ["a", "A", "b", "B", "c", "", "it's", "z", None], ["b", "A", "it's", "C"]
    for column in ("x", "x COLLATE NOCASE"):
        said = database.even_predicates(column, cuts)
        counts = duckdb.execute("SELECT " + " + ".join(f"CAST(coalesce({p}, false) AS INT)" for p in said) + " FROM (SELECT unnest(?::VARCHAR[]) AS x)", [values]).fetchall()
        assert [c for (c,) in counts] == [1] * len(values)
    assert database.even_predicates("x", []) == ["1 = 1"]
    assert database.sql_literal(datetime.datetime(2020, 1, 2, 3)) == "{ts '2020-01-02 03:00:00'}" and database.sql_literal(datetime.date(2020, 1, 2)) == "{d '2020-01-02'}"


def test_a_load_that_fails_leaves_the_table(spark, url):
    database.load_jdbc(spark.range(10).toDF("k"), url, "t", 2, DERBY)
    bad = spark.range(0, 1000, 1, 4).select(F.when(F.col("id") == 900, F.raise_error(F.lit("broken")).cast("long")).otherwise(F.col("id")).alias("k"))
    with pytest.raises(Exception, match="broken"):
        database.load_jdbc(bad, url, "t", 4, DERBY)
    assert store.read_jdbc(spark, url, "t", driver=DERBY).count() == 10
    with database._connection(spark, url, DERBY) as connection:
        found = connection.getMetaData().getTables(None, None, "T%", None)
        names = []
        while found.next():
            names.append(found.getString(3))
    assert names == ["T"]
    database.load_jdbc(spark.range(25).toDF("k"), url, "t", 2, DERBY)
    assert sorted(r["k"] for r in store.read_jdbc(spark, url, "t", driver=DERBY).collect()) == list(range(25))


def test_of_repeated_tasks_one_stays(spark, url, monkeypatch):
    """A task came in, and was run again: its rows are there once."""
    rows, write = spark.range(0, 60, 1, 3).toDF("k"), database.write_jdbc

    def twice(df, url, table, **kw):
        write(df, url, table, **kw)
        first = df.where(F.col("load_part") == 1).withColumn("load_attempt", F.col("load_attempt") + 1000)
        write(first, url, table, mode="append", driver=DERBY)

    monkeypatch.setattr(database, "write_jdbc", twice)
    database.load_jdbc(rows, url, "t", 3, DERBY)
    back = store.read_jdbc(spark, url, "t", driver=DERBY)
    assert sorted(r["k"] for r in back.collect()) == list(range(60)) and back.columns == ["k"]
