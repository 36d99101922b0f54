"""Small column functions and generated tables."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def sampling_factor(name: Column) -> Column:
    """The number after the last _m of a name, such as 100 of orders_m100; 1 where there is none."""
    return F.coalesce(F.regexp_extract(name, r"_m(\d+)$", 1).try_cast("int"), F.lit(1))


def stable_hash(text: Column) -> Column:
    """60 bits of MD5 as a long: the same in any engine and on any day."""
    return F.conv(F.substring(F.md5(text.cast("string").cast("binary")), 1, 15), 16, 10).cast("long")


def calendar(spark: SparkSession, first: datetime.date, last: datetime.date, name: str = "dt") -> DataFrame:
    """One row per day, both ends included."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias(name))


def numbers(spark: SparkSession, n: int, step: int = 1, start: int = 0, name: str = "nr") -> DataFrame:
    """n rows k * step + start, in parallel."""
    return spark.range(n).select((F.col("id") * step + start).alias(name))
