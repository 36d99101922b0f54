"""Small files and folders in whatever file system a path names, through Hadoop's API."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _path(spark, path)
    return fs.exists(where)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of files and folders in path, sorted; none if path isn't there."""
    fs, where = _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, where = _path(spark, path)
    fs.delete(where, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename a file or folder within one file system; target must not be there."""
    fs, where = _path(spark, source)
    if not fs.rename(where, spark._jvm.org.apache.hadoop.fs.Path(target)):
        raise OSError(f"could not move {source} to {target}")


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, such as a pointer; None if it isn't there."""
    fs, where = _path(spark, path)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _rename(spark: SparkSession, where, draft, over: bool) -> None:
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark._jsc.hadoopConfiguration())
    option = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(option, 1)
    options[0] = option.OVERWRITE if over else option.NONE
    context.rename(draft, where, options)


def _draft(spark: SparkSession, path: str, text: str):
    fs, where = _path(spark, path)
    _, draft = _path(spark, f"{path}.{uuid.uuid4().hex[:8]}.tmp")
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    return fs, where, draft


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file beside path and rename it onto path, so readers see the old text or the new one."""
    _, where, draft = _draft(spark, path, text)
    _rename(spark, where, draft, True)


def claim_text(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file that isn't there yet; False if it is. Of several writers that try at once, one succeeds, where
    the file system refuses to rename onto a file."""
    fs, where, draft = _draft(spark, path, text)
    try:
        _rename(spark, where, draft, False)
    except Py4JJavaError as error:
        fs.delete(draft, False)
        if fs.exists(where):
            return False
        raise error
    return True
