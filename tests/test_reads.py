"""Reads that lose nothing: line breaks in CSV, tables of several schemas."""

import datetime
import itertools

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemill.sources import tables as store

TEXTS = ["a\nb", "\n", "a\r\nb", "\r", "x\ry", "a,\n\"b\"\r\n", "\n\n", "\\n", "\"", "\"\n", "plain", "", None, " \n "]


@pytest.mark.parametrize("columns", [1, 2, 3])
def test_csv_texts_with_line_breaks(spark, tmp_path, columns):
    rows = list(itertools.product(TEXTS, repeat=columns)) if columns < 3 else [(a, b, k) for k, (a, b) in enumerate(zip(TEXTS, reversed(TEXTS), strict=True))]
    df = spark.createDataFrame(rows, ", ".join(["s string", "t string", "n int"][:columns])).repartition(3)
    store.write_csv(df, f"{tmp_path}/texts.csv.gz")
    back = store.read_csv_dir(spark, str(tmp_path), {"texts": df.schema})["texts"]
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


def stored_as(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(str(path))
    return str(path)


def test_one_schema_is_one_scan(spark, tmp_path):
    paths = [stored_as(spark, tmp_path / str(k), [(k,)], "a int") for k in range(3)]
    df = store.read_union(spark, paths)
    assert sorted(r["a"] for r in df.collect()) == [0, 1, 2] and "Union" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_columns_of_some_tables_stay(spark, tmp_path):
    a = stored_as(spark, tmp_path / "a", [(1,)], "id int")
    b = stored_as(spark, tmp_path / "b", [(2, "x")], "id int, b string")
    c = stored_as(spark, tmp_path / "c", [(2**40, 1.5, "y", [1], (1, "p"))], "ID long, c double, b string, l array<int>, s struct<x: int, y: string>")
    d = stored_as(spark, tmp_path / "d", [([2**40], (2**40, 1.0))], "l array<long>, s struct<x: long, z: float>")
    df = store.read_union(spark, [a, b, c, d])
    assert dict(df.dtypes) == {"id": "bigint", "b": "string", "c": "double", "l": "array<bigint>", "s": "struct<x:bigint,y:string,z:float>"}
    found = {tuple(r) for r in df.withColumn("l", F.to_json("l")).withColumn("s", F.to_json("s")).collect()}
    assert found == {(1, None, None, None, None), (2, "x", None, None, None), (2**40, "y", 1.5, "[1]", '{"x":1,"y":"p"}'), (None, None, None, f"[{2**40}]", f'{{"x":{2**40},"z":1.0}}')}
    assert df.select("id", "b").where("id = 2").count() == 1


def test_types_unite_without_loss():
    dec = T.DecimalType
    for a, b, want in [
        (T.ByteType(), T.LongType(), T.LongType()), (T.IntegerType(), dec(5, 2), dec(12, 2)), (T.LongType(), dec(5, 2), dec(21, 2)), (dec(10, 4), dec(12, 1), dec(15, 4)),
        (T.IntegerType(), T.DoubleType(), T.DoubleType()), (T.IntegerType(), T.FloatType(), T.DoubleType()), (T.ShortType(), T.FloatType(), T.FloatType()),
        (T.DateType(), T.TimestampNTZType(), T.TimestampNTZType()), (T.NullType(), T.StringType(), T.StringType()),
    ]:
        assert store.wider(a, b) == store.wider(b, a) == want
    for a, b in [
        (T.LongType(), T.DoubleType()), (T.StringType(), T.IntegerType()), (dec(38, 0), dec(38, 10)), (T.TimestampType(), T.TimestampNTZType()), (dec(5, 1), T.DoubleType()),
        (T.ArrayType(T.StringType()), T.StringType()), (T.BooleanType(), T.IntegerType()),
    ]:
        for x, y in ((a, b), (b, a)):
            with pytest.raises(TypeError, match="without loss"):
                store.wider(x, y)


def test_what_would_be_lost_is_refused(spark, tmp_path):
    a = stored_as(spark, tmp_path / "a", [(1, 2**60)], "k int, v long")
    b = stored_as(spark, tmp_path / "b", [(1, 0.5)], "k int, v double")
    with pytest.raises(TypeError, match="v: "):
        store.read_union(spark, [a, b])


def test_dates_become_timestamps(spark, tmp_path):
    a = stored_as(spark, tmp_path / "a", [(datetime.date(2020, 1, 2),)], "d date")
    b = stored_as(spark, tmp_path / "b", [(datetime.datetime(2020, 1, 2, 3),)], "d timestamp_ntz")
    assert {r["d"] for r in store.read_union(spark, [a, b]).collect()} == {datetime.datetime(2020, 1, 2), datetime.datetime(2020, 1, 2, 3)}
