"""Layouts that later reads gain from: buckets for joins on one key, ranges with minima and maxima for each file."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.sources import files


def write_bucketed(df: DataFrame, name: str, keys: str | Sequence[str], buckets: int, path: str) -> DataFrame:
    """Store df as catalog table name, its files at path, dealt into buckets by keys and sorted by them.

    Tables of equal keys and buckets join without a shuffle: bucket meets bucket. Each bucket is one sorted file, so it
    should be one task's load: for tables that are joined often on keys of which none has a large part of the rows.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    dealt = df.repartition(buckets, *[F.col(f"`{k}`") for k in keys])
    dealt.write.option("compression", "zstd").option("path", path).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    return df.sparkSession.table(name)


def _list_path(path: str) -> str:
    return path.rstrip("/") + ".ranges"


def write_by_range(df: DataFrame, path: str, column: str, parts: int) -> None:
    """Store df in ranges of a column, such as a date, and beside it (path.ranges) a small table of what each file holds:
    least and largest value, rows, and rows without a value. The figures are read back from that column of the files."""
    df.repartitionByRange(parts, F.col(f"`{column}`")).sortWithinPartitions(F.col(f"`{column}`")).write.option("compression", "zstd").parquet(path)
    list_ranges(df.sparkSession, path, column)


def list_ranges(spark: SparkSession, path: str, column: str) -> None:
    """Write (anew) the table of ranges of a stored table, such as one that rows were appended to. Readers see the old
    table or the new one: the name of the list in use is renamed into place."""
    rows = spark.read.parquet(path)
    value = F.col(f"`{column}`")
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    per = rows.groupBy(name.alias("file")).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count("*").alias("row_count"), F.count(F.when(value.isNull(), 1)).alias("null_count"))
    place = f"{_list_path(path)}/{spark._jvm.java.util.UUID.randomUUID().toString()}"
    per.write.parquet(place)
    files.write_text(spark, f"{_list_path(path)}/current", place.rsplit("/", 1)[1])


def ranges(spark: SparkSession, path: str) -> DataFrame:
    """(file, low, high, row_count, null_count) of a table stored by range."""
    return spark.read.parquet(f"{_list_path(path)}/{files.read_text(spark, f'{_list_path(path)}/current')}")


def read_range(spark: SparkSession, path: str, column: str, low: object = None, high: object = None, nulls: bool = False) -> DataFrame:
    """Rows whose value is from low to high (both included, None: no limit), and with nulls those without a value.

    Only files whose range meets that one are part of the scan; others are not even opened. Files that were added since
    the ranges were listed are read, as nothing is known of them.
    """
    listed, whole = ranges(spark, path), spark.read.parquet(path)
    kind = whole.schema[column].dataType
    value = F.col(f"`{column}`")

    def inside(least: Column, most: Column, missing: Column) -> Column:
        limits = [most >= F.lit(low).cast(kind)] * (low is not None) + [least <= F.lit(high).cast(kind)] * (high is not None)
        meets = F.coalesce(reduce(Column.__and__, limits, least.isNotNull()), F.lit(False))
        return meets | missing if nulls else meets

    away = {r["file"] for r in listed.where(~inside(F.col("low"), F.col("high"), F.col("null_count") > 0)).select("file").collect()}  # names of files
    there = [n for n in files.names(spark, path) if not n.startswith(("_", ".")) and n not in away]
    rows = spark.read.schema(whole.schema).parquet(*[f"{path}/{n}" for n in there]) if there else whole.limit(0)
    return rows.where(inside(value, value, value.isNull()))
