"""Small helpers that the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemill.scratch import BROADCAST_ROWS, broadcast_if_small, fresh, new_path, stored

__all__ = ["BROADCAST_ROWS", "bounded_sample", "broadcast_if_small", "documents", "fresh", "new_path", "schema", "stored"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bounded_sample(df: DataFrame, by: Column, n: int) -> DataFrame:
    """The n rows of df with the least hash by (a long), the same every time. A threshold on the hash leaves about 2n
    rows to sort, however many partitions there are: a plain top-n would send n rows of each to one task."""
    bits = 1 << 40
    if (total := df.count()) > 2 * n:
        df = df.where(F.pmod(by, F.lit(bits)) < F.lit(2 * n * bits // total))
    return df.orderBy(F.pmod(by, F.lit(bits)), by).limit(n)


def schema(said: str) -> T.StructType:
    """A struct type from "name type, ..." without a running Spark, as workers that import a module need it."""
    kinds = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "binary": T.BinaryType(), "double": T.DoubleType(), "longs": T.ArrayType(T.LongType()), "ints": T.ArrayType(T.IntegerType())}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split() for x in said.split(","))])
