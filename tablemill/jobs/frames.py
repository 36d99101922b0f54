"""Functions over frames: batches of pandas, and hooks around reading and writing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def map_pandas(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str | None = None) -> DataFrame:
    """fn over Arrow batches of rows. fn must treat rows one by one: it never sees the whole table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield fn(batch)

    return df.mapInPandas(run, schema or df.schema)


class Hooks:
    """Lazy functions applied to every table that a store reads or writes, such as an added column."""

    def __init__(self, on_read: Callable[[DataFrame], DataFrame] = lambda df: df, on_write: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
        self.on_read, self.on_write = on_read, on_write

    def write(self, df: DataFrame, path: str) -> None:
        df.transform(self.on_write).write.option("compression", "zstd").parquet(path)

    def read(self, spark, path: str) -> DataFrame:
        return spark.read.parquet(path).transform(self.on_read)
