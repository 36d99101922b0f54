"""Tables by key, in versions: what changed between two is found from hashes, and changes rewrite only files they touch.

Rows are dealt into buckets by the hash of their key, and stored. Beside each version lies its file list: for each file
its bucket, number of rows, and the sums of its rows' hashes. They add up to a hash for each bucket and one for the
table, a tree of two levels: equal tables are told by one comparison, and of unequal ones only unequal buckets are read.
A merge reads the buckets of the keys it brings, finds the files that hold them, and writes these anew; all other files
are part of the new version as they are.

Edge cases: null is a key like any other; a key may be repeated, then a merge replaces all its rows; of repeated keys
among the changes all rows come in; an empty table has a version without files.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemill.jobs.publish import Conflict
from tablemill.operators.aggregates import content_hash, hash_measures, null_marked
from tablemill.operators.compare import diff_rows
from tablemill.scratch import fresh, stored
from tablemill.sources import files

BUCKETS = 64
#: Hash sums of a file; they add up over files.
SUMS = ("s0", "s1", "s2")
FILES = "bucket int, file string, row_count long, s0 long, s1 long, s2 long"
#: Versions whose files stay.
KEPT = 2


class KeyedTable:
    """A table under root: data files by bucket, versions/<number>.json, and a file list for each version.

    A version is claimed by making its file, so of two changes that began at the same version one is refused (Conflict)
    and loses nothing but its work.
    """

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], buckets: int = BUCKETS, kept: int = KEPT) -> None:
        self.spark, self.root, self.keys, self.buckets, self.kept = spark, root, list(keys), buckets, kept

    # Versions

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in files.names(self.spark, f"{self.root}/versions") if n.endswith(".json"))

    def _note(self, version: int | None = None) -> dict:
        there = self.versions()
        if not there and version is None:
            return {"version": 0}
        version = there[-1] if version is None else version
        if version not in there:
            raise LookupError(f"no version {version}")
        return json.loads(files.read_text(self.spark, f"{self.root}/versions/{version:09d}.json"))

    def file_list(self, version: int | None = None) -> DataFrame:
        """(bucket, file, row_count, s0, s1, s2) of a version's files."""
        note = self._note(version)
        if not note["version"]:
            return self.spark.createDataFrame([], FILES)
        return self.spark.read.schema(FILES).parquet(f"{self.root}/{note['files']}")

    def hash(self, version: int | None = None) -> str:
        """Row count and content hash of a version, as content_key() of its rows: the root of the tree."""
        return self._note(version).get("hash", "0:0")

    def _read(self, version: int | None, listed: DataFrame | None = None) -> DataFrame:
        """Rows of a version, or of its files that are listed. Paths are as many as files, and no row is among them."""
        schema = T.StructType.fromJson(self._note(version)["schema"])
        chosen = [f"{self.root}/{r['file']}" for r in (self.file_list(version) if listed is None else listed).select("file").toLocalIterator()]
        if not chosen:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*chosen)

    def read(self, version: int | None = None) -> DataFrame:
        return self._read(version)

    # Writing

    def _bucket(self, df: DataFrame) -> Column:
        """By MD5, so that any engine can tell a key's bucket."""
        said = F.md5(null_marked([F.col(f"`{k}`") for k in self.keys]).cast("binary"))
        return (F.conv(F.substring(said, 1, 8), 16, 10).cast("long") % self.buckets).cast("int")

    def _store(self, df: DataFrame) -> DataFrame:
        """Write rows by bucket and list the new files, with the hashes of what they hold."""
        folder, bucket = f"data/{uuid.uuid4().hex}", fresh(df, "bucket")
        dealt = df.withColumn(bucket, self._bucket(df))
        # Rebalanced, not repartitioned: Spark deals a large bucket, such as that of a hot key, over several tasks and files.
        dealt.hint("rebalance", bucket).write.option("compression", "zstd").partitionBy(bucket).parquet(f"{self.root}/{folder}")
        if not [n for n in files.names(self.spark, f"{self.root}/{folder}") if n.startswith(bucket)]:
            return self.spark.createDataFrame([], FILES)
        rows = self.spark.read.schema(df.schema).parquet(f"{self.root}/{folder}/*")
        place = "file_path"
        measures = [c.alias(n) for n, c in hash_measures([F.col(f"`{c}`") for c in df.columns]).items()]
        # Paths are taken apart once they are one row per file.
        per = rows.groupBy(F.col("_metadata.file_path").alias(place)).agg(*measures)
        ends = F.split(F.col(place), "/")
        number = F.regexp_extract(F.element_at(ends, -2), r"=(\d+)$", 1).cast("int")
        found = per.select(number.alias("bucket"), F.concat_ws("/", F.lit(folder), F.element_at(ends, -2), F.element_at(ends, -1)).alias("file"), "row_count", *SUMS)
        return stored(found.select("bucket", "file", "row_count", *SUMS))

    def _commit(self, listed: DataFrame, schema: T.StructType, began: int) -> int:
        number = began + 1
        place = f"lists/{number:09d}-{uuid.uuid4().hex[:8]}"
        listed.repartitionByRange(max(1, self.buckets // 256), "bucket").sortWithinPartitions("bucket").write.parquet(f"{self.root}/{place}")
        sums = self.spark.read.schema(FILES).parquet(f"{self.root}/{place}").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("row_count", *SUMS)]).first().asDict()
        note = {"version": number, "files": place, "hash": f"{sums['row_count']}:{content_hash(sums)}", "keys": self.keys, "buckets": self.buckets, "schema": schema.jsonValue()}
        if not files.claim_text(self.spark, f"{self.root}/versions/{number:09d}.json", json.dumps(note)):
            raise Conflict(f"version {number} is there already")
        return number

    def write(self, df: DataFrame) -> int:
        """A new version with these rows; returns its number."""
        began = self._note()["version"]
        return self._commit(self._store(df), df.schema, began)

    # What changed

    def tree(self, version: int | None = None) -> DataFrame:
        """(bucket, row_count, s0, s1, s2): one row for each bucket with rows."""
        return self.file_list(version).groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("row_count", *SUMS)])

    def changed_buckets(self, new: int, old: int, other: KeyedTable | None = None) -> DataFrame:
        """(bucket, rows_new, rows_old) of buckets that differ. other: the table that the old version is of."""
        other = other or self
        if (other.keys, other.buckets) != (self.keys, self.buckets):
            raise ValueError("the tables are dealt otherwise")
        a, b = self.tree(new), other.tree(old).select(F.col("bucket"), *[F.col(c).alias(f"{c}_old") for c in ("row_count", *SUMS)])
        differs = reduce(Column.__or__, [~F.col(c).eqNullSafe(F.col(f"{c}_old")) for c in ("row_count", *SUMS)])
        both = a.join(b, "bucket", "full").where(differs)
        return both.select("bucket", F.coalesce("row_count", F.lit(0)).alias("rows_new"), F.coalesce("row_count_old", F.lit(0)).alias("rows_old"))

    def diff(self, new: int, old: int, other: KeyedTable | None = None) -> DataFrame:
        """(keys, change, columns) of keys that differ, as diff_rows() has them.

        Only files of unequal buckets are read, and of those only files that the two versions don't share: a change
        writes all files anew that hold its keys.
        """
        before = other or self
        if self.hash(new) == before.hash(old) and self._note(new)["schema"] == before._note(old)["schema"]:
            return diff_rows(self._read(new).limit(0), before._read(old).limit(0), self.keys)
        buckets = stored(self.changed_buckets(new, old, other).select("bucket"))
        mine, theirs = (t.file_list(v).join(F.broadcast(buckets), "bucket", "left_semi") for t, v in ((self, new), (before, old)))  # one row per bucket
        if before.root == self.root:
            mine, theirs = mine.join(theirs, "file", "left_anti"), theirs.join(mine, "file", "left_anti")
        return diff_rows(self._read(new, mine), before._read(old, theirs), self.keys)

    # Changing

    def merge(self, upserts: DataFrame | None = None, deletes: DataFrame | None = None) -> int:
        """A new version in which rows of the keys in upserts are those of upserts, and keys in deletes are gone (unless
        upserts has them); returns its number.

        upserts has the table's columns, deletes its keys. Files without such a key stay as they are. What is read are
        the key columns of the buckets concerned, and the files concerned.
        """
        began = self._note()["version"]
        if not began:
            raise LookupError("no table to change")
        schema = T.StructType.fromJson(self._note()["schema"])
        keys = [F.col(f"`{k}`") for k in self.keys]
        types = [schema[k].dataType for k in self.keys]
        parts = [df.select(*[k.cast(t).alias(n) for k, t, n in zip(keys, types, self.keys, strict=True)]) for df in (upserts, deletes) if df is not None]
        if not parts:
            return began
        if upserts is not None:
            if sorted(upserts.columns) != sorted(schema.names):
                raise ValueError(f"columns differ: {sorted(set(upserts.columns) ^ set(schema.names))}")
            upserts = stored(upserts.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema]))
            parts[0] = upserts.select(*keys)
        brought = reduce(DataFrame.unionByName, parts).distinct()
        bucket = fresh(brought, "bucket")
        brought = stored(brought.withColumn(bucket, self._bucket(brought)))
        listed = self.file_list(began)
        concerned = stored(listed.join(brought.select(F.col(bucket).alias("bucket")).distinct(), "bucket", "left_semi"))
        same = reduce(Column.__and__, [F.col(f"t.`{k}`").eqNullSafe(F.col(f"b.`{k}`")) for k in self.keys])
        rows = self._read(began, concerned)
        # Which of these files hold a key that is brought: from key columns alone.
        path = fresh(brought, "hit_path")
        hit = rows.select(*keys, F.col("_metadata.file_path").alias(path)).alias("t") if concerned.count() else None
        if hit is None:
            touched = concerned.select("file")
        else:
            paths = hit.join(brought.alias("b"), same, "left_semi").select(path).distinct()
            touched = paths.select(F.concat_ws("/", F.slice(F.split(path, "/"), -4, 4)).alias("file"))
        touched = stored(touched)
        kept_rows = self._read(began, listed.join(touched, "file", "left_semi")).alias("t").join(brought.alias("b"), same, "left_anti")
        new_rows = kept_rows if upserts is None else kept_rows.unionByName(upserts)
        added = self._store(new_rows)
        return self._commit(listed.join(touched, "file", "left_anti").unionByName(added), schema, began)

    def clean(self) -> None:
        """Remove all but the last versions, and data that none of those names. Not while changes are under way."""
        there = self.versions()
        kept = there[-self.kept :]
        lists = {self._note(v)["files"] for v in kept}
        used = {"/".join(r["file"].split("/")[:2]) for v in kept for r in self.file_list(v).select("file").toLocalIterator()}
        for v in set(there) - set(kept):
            files.delete(self.spark, f"{self.root}/versions/{v:09d}.json")
        for folder in files.names(self.spark, f"{self.root}/lists"):
            if f"lists/{folder}" not in lists:
                files.delete(self.spark, f"{self.root}/lists/{folder}")
        for folder in files.names(self.spark, f"{self.root}/data"):
            if f"data/{folder}" not in used:
                files.delete(self.spark, f"{self.root}/data/{folder}")
