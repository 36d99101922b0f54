"""Rebuilding only what changed: fingerprints of inputs decide whether a stored table is copied or computed."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from enum import Enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.operators.aggregates import table_hash
from tablemill.sources import files


#: Files of at most so many bytes are hashed by tasks; a larger one would be a row too large, and is hashed as a stream.
WHOLE_FILE = 128 << 20
#: Streams at once.
HASHERS = 8


class Mode(Enum):
    NORMAL = "normal"
    IGNORE_FRESH_INPUT = "ignore fresh input"
    ASSERT_NO_FRESH_INPUT = "assert no fresh input"
    FORCE_FRESH_INPUT = "force fresh input"
    FORCE_ALL = "force all"


def file_hashes(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(file_name, file_size, sha256) of the files in a folder.

    Tasks hash files of up to WHOLE_FILE bytes, as partitioned tables have them. Larger ones are read by the driver as
    streams, so that no file is held whole: their number is that of files, not of rows.
    """
    files_there = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    name = F.element_at(F.split("path", "/"), -1).alias("file_name")
    small = files_there.where(F.col("length") <= WHOLE_FILE).select(name, F.col("length").alias("file_size"), F.sha2("content", 256).alias("sha256"))
    found = files_there.where(F.col("length") > WHOLE_FILE).select("path", "length").collect()
    if not found:
        return small
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()

    def digest(name: str) -> str:
        where = jvm.org.apache.hadoop.fs.Path(name)
        stream = where.getFileSystem(conf).open(where)
        try:
            return jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
        finally:
            stream.close()

    with ThreadPoolExecutor(HASHERS) as pool:
        digests = list(pool.map(digest, [r["path"] for r in found]))
    rows = [(r["path"].rsplit("/", 1)[-1], r["length"], said) for r, said in zip(found, digests, strict=True)]
    return small.unionByName(spark.createDataFrame(rows, small.schema))


def canonical(query_text: str) -> str:
    """Query text without comments and needless white space, so that layout is no change."""
    text = re.sub(r"--[^\n]*|/\*.*?\*/", " ", query_text, flags=re.S)
    return " ".join(text.split()).rstrip("; ")


def content_key(df: DataFrame) -> str:
    row = table_hash(df).first()
    return f"{row['row_count']}:{row['content_hash']}"


class Rebuilder:
    """Tables under root, each with a small note of what it was made from.

    build() computes a table only if its version text, its query text or its inputs changed; else the stored one is
    used. A new table goes to a place of its own and the note is renamed onto the old one last, so a build that fails or
    dies leaves the old table as it was, also where the mode forces it; the table before stays for one more build. Input keys are content hashes, or fingerprints that the caller has (a date, an aggregate).
    """

    def __init__(self, spark: SparkSession, root: str, mode: Mode = Mode.NORMAL) -> None:
        self.spark, self.root, self.mode = spark, root, mode
        self.computed: list[str] = []

    def key(self, name: str, version: str, query_text: str) -> str:
        return hashlib.sha256(json.dumps([name, version, canonical(query_text)]).encode()).hexdigest()

    def build(self, name: str, fn: Callable[..., DataFrame], inputs: Mapping[str, DataFrame], version: str = "", query_text: str = "", fingerprint: str | None = None) -> DataFrame:
        """The table, from store or computed as fn(**inputs) and stored. fingerprint: in place of hashing the inputs."""
        note_path = f"{self.root}/{name}.json"
        note = json.loads(files.read_text(self.spark, note_path) or "{}")
        key = self.key(name, version, query_text)
        known = note.get("key") == key and self.mode is not Mode.FORCE_ALL
        if known and self.mode is Mode.IGNORE_FRESH_INPUT:
            return self.spark.read.parquet(f"{self.root}/{note['path']}")
        fresh = fingerprint or hashlib.sha256(json.dumps({n: content_key(df) for n, df in sorted(inputs.items())}).encode()).hexdigest()
        if self.mode is Mode.ASSERT_NO_FRESH_INPUT and note.get("inputs") != fresh:
            raise RuntimeError(f"{name}: an input is fresh")
        if known and note.get("inputs") == fresh and self.mode is not Mode.FORCE_FRESH_INPUT:
            return self.spark.read.parquet(f"{self.root}/{note['path']}")
        # A place of its own: until the note is replaced, the old table is there, and a build that fails changes nothing.
        path = f"{name}-{hashlib.sha256((key + fresh).encode()).hexdigest()[:12]}-{uuid.uuid4().hex[:8]}.parquet"
        try:
            fn(**inputs).write.option("compression", "zstd").parquet(f"{self.root}/{path}")
        except Exception:
            files.delete(self.spark, f"{self.root}/{path}")
            raise
        files.write_text(self.spark, note_path, json.dumps({"key": key, "inputs": fresh, "path": path, "before": note.get("path")}))
        # The table before stays for those who read it now; the one before that goes.
        if older := note.get("before"):
            files.delete(self.spark, f"{self.root}/{older}")
        self.computed.append(name)
        return self.spark.read.parquet(f"{self.root}/{path}")
