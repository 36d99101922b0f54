"""Intermediate tables in the folder that driver and executors share, and broadcasts behind a check of size."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.sources import files

#: Paths that this process has given out and not removed; those of a step that removes its own are in a list of the step.
_made: list[str] = []
_step: ContextVar[list[str]] = ContextVar("step", default=_made)
#: A table of at most so many narrow rows may be broadcast (about 10 MB); larger ones are joined by shuffle.
BROADCAST_ROWS = 200_000


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a temporary one only where that is unset and Spark runs locally."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path
    if path := spark.sparkContext.getCheckpointDir():
        return path
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(path := tempfile.mkdtemp(prefix="tablemill-"))
    return path


def new_path(spark: SparkSession) -> str:
    path = f"{scratch_dir(spark)}/{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    _step.get().append(path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors, is computed once."""
    path = new_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_alone(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """Store what make() returns, and remove the intermediate tables that it stored on the way: the result no longer
    needs them. For steps of a job that would otherwise leave several times their input behind. Tables that other threads
    store meanwhile are not the step's, and stay."""
    own: list[str] = []
    before = _step.set(own)
    try:
        made = make()
    finally:
        _step.reset(before)
        _made.extend(own)  # until they are removed, or if the step fails
    out = stored(made)
    for path in own:
        files.delete(spark, path)
        _made.remove(path)
    return out


def remove_intermediate(spark: SparkSession) -> int:
    """Remove all intermediate tables that this process has stored, once results are written; returns their number."""
    n = len(_made)
    while _made:
        files.delete(spark, _made.pop())
    return n


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting df (cheap: df should be stored); else leave the join to a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have in any letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
