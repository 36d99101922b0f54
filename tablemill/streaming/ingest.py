"""Files that arrive in a folder, appended to a table: each file once, across restarts.

The batch jobs decide by fingerprints whether input is fresh; for folders that only ever gain files, a file stream with
a checkpoint does that without reading old files again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def append_new_files(spark: SparkSession, source: str, schema: T.StructType, target: str, checkpoint: str, glob: str = "*.parquet", transform: Callable[[DataFrame], DataFrame] | None = None, max_files: int = 1000) -> None:
    """Append the rows of files not seen before to the parquet table target, then stop."""
    rows = spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", max_files).parquet(source)
    rows = transform(rows) if transform else rows
    job = rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append")
    job.trigger(availableNow=True).start().awaitTermination()
