"""Keyed tables: hash trees, diffs that read only what differs, merges that rewrite only what they touch."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tablemill.jobs import keyed
from tablemill.jobs.incremental import content_key
from tablemill.jobs.keyed import KeyedTable
from tablemill.jobs.publish import Conflict
from tablemill.operators.compare import diff_rows


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def bytes_of(path):
    return {str(p.relative_to(path)): hashlib.md5(p.read_bytes()).hexdigest() for p in path.glob("data/*/*/*.parquet")}


@pytest.fixture
def many(spark):
    return spark.range(2000).select(F.col("id").alias("k"), (F.col("id") % 7).cast("string").alias("v"), F.lit("x").alias("bucket"))


def test_a_version_is_its_rows(spark, tmp_path, many):
    table = KeyedTable(spark, str(tmp_path), ["k"], 16)
    assert table.versions() == [] and table.hash() == "0:0"
    assert table.write(many) == 1 and rows(table.read()) == rows(many)
    assert table.hash() == content_key(many)
    assert table.tree().agg(F.sum("row_count"), F.count("*")).first() == (2000, 16)
    assert table.write(many.orderBy(F.desc("k"))) == 2 and table.hash(1) == table.hash(2) and table.changed_buckets(2, 1).count() == 0


def test_one_changed_row_reads_one_bucket(spark, tmp_path, many):
    """The diff's scan holds that bucket's files alone."""
    table = KeyedTable(spark, str(tmp_path), ["k"], 16)
    table.write(many)
    changed = many.withColumn("v", F.when(F.col("k") == 77, "new").otherwise(F.col("v")))
    table.write(changed)
    diff = table.diff(2, 1)
    assert rows(diff) == [(77, "changed", "v")]
    bucket = {f.split("/")[-2] for f in diff.inputFiles()}
    assert len(bucket) == 1 and len(diff.inputFiles()) == table.file_list(1).where(F.col("bucket") == int(next(iter(bucket)).split("=")[1])).count() * 2
    assert table.changed_buckets(2, 1).count() == 1
    table.write(changed)
    assert not table.diff(3, 2).inputFiles() and table.diff(3, 2).count() == 0


def test_merge_rewrites_only_files_with_its_keys(spark, tmp_path, many):
    table = KeyedTable(spark, str(tmp_path), ["k"], 16)
    table.write(many)
    before = bytes_of(tmp_path)
    up = spark.createDataFrame([(5, "five", "y"), (9999, "new", "y")], "k long, v string, bucket string")
    assert table.merge(up, spark.createDataFrame([(6,), (123456,)], "k int")) == 2
    want = rows(many.where("k not in (5, 6)").union(up))
    assert rows(table.read()) == want and table.hash() == content_key(table.read())
    after = bytes_of(tmp_path)
    assert before.items() <= after.items()
    shared = {r["file"] for r in table.file_list(1).collect()} & {r["file"] for r in table.file_list(2).collect()}
    assert len(shared) >= table.file_list(1).count() - 2 and len(after) - len(before) <= 3
    diff = table.diff(2, 1)
    assert rows(diff) == [(5, "changed", "v,bucket"), (6, "removed", ""), (9999, "added", "")]
    assert not {f for f in diff.inputFiles() for s in shared if f.endswith(s)}
    assert rows(table.read(1)) == rows(many)


def test_merges_by_brute_force(spark, tmp_path):
    """Null and repeated keys of two columns, several changes, against dictionaries."""
    rnd, schema = random.Random(4), "a long, b string, v int"
    key = lambda: (rnd.choice([None, *range(6)]), rnd.choice([None, "", "x"]))
    base = [(*key(), rnd.randrange(9)) for _ in range(60)]
    table = KeyedTable(spark, str(tmp_path), ["a", "b"], 8)
    table.write(spark.createDataFrame(base, schema))
    for _ in range(3):
        up, gone = [(*key(), rnd.randrange(9)) for _ in range(6)], [key() for _ in range(3)]
        old = table.read()
        table.merge(spark.createDataFrame(up, schema), spark.createDataFrame(gone, "a long, b string"))
        touched = {r[:2] for r in up} | set(gone)
        base = [r for r in base if r[:2] not in touched] + up
        assert rows(table.read()) == sorted(base, key=str) and table.hash() == content_key(table.read())
        n = table.versions()[-1]
        assert rows(table.diff(n, n - 1)) == rows(diff_rows(table.read(), old, ["a", "b"]))


def test_of_two_changes_one_is_refused(spark, tmp_path, many, monkeypatch):
    table, other = KeyedTable(spark, str(tmp_path), ["k"], 4), KeyedTable(spark, str(tmp_path), ["k"], 4)
    table.write(many)
    late = table._commit

    def commit(listed, schema, began):
        other.merge(deletes=spark.createDataFrame([(1,)], "k long"))
        return late(listed, schema, began)

    monkeypatch.setattr(table, "_commit", commit)
    with pytest.raises(Conflict):
        table.merge(deletes=spark.createDataFrame([(2,)], "k long"))
    assert table.read().count() == 1999 and table.read().where("k = 1").count() == 0


def test_empty_tables_and_changes(spark, tmp_path, many):
    table = KeyedTable(spark, str(tmp_path), ["k"], 4)
    with pytest.raises(LookupError):
        table.merge(many)
    table.write(many.limit(0))
    assert table.read().count() == 0 and table.read().dtypes == many.dtypes
    table.merge(many)
    assert rows(table.read()) == rows(many) and table.diff(2, 1).where("change = 'added'").count() == 2000
    table.merge(many.limit(0), many.select("k").limit(0))
    assert table.hash(3) == table.hash(2)
    table.merge(deletes=many.select("k"))
    assert table.read().count() == 0 and table.hash() == "0:0"
    with pytest.raises(ValueError):
        table.merge(many.drop("v"))
    table.clean()
    assert table.versions() == [3, 4] and rows(table.read(3)) == rows(many)


def test_a_hot_key_is_more_than_one_file(spark, tmp_path):
    """A third of the rows have one key: Spark may deal its bucket over several tasks."""
    table = KeyedTable(spark, str(tmp_path), ["k"], 4)
    hot = spark.range(30000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(size, "100k")
    try:
        table.write(hot)
    finally:
        spark.conf.unset(size)
    most = table.file_list().agg(F.max("row_count")).first()[0]
    assert most < 9000 and table.read().count() == 30000


def test_two_tables_of_one_layout(spark, tmp_path, many):
    a, b = KeyedTable(spark, f"{tmp_path}/a", ["k"], 8), KeyedTable(spark, f"{tmp_path}/b", ["k"], 8)
    a.write(many)
    b.write(many.where("k <> 3"))
    assert rows(a.diff(1, 1, b)) == [(3, "added", "")]
    with pytest.raises(ValueError):
        a.changed_buckets(1, 1, KeyedTable(spark, f"{tmp_path}/b", ["k"], 9))


def _below_aggregates(plans):
    """What the optimised plans compute for each row before they aggregate."""
    return "".join(p[p.index("Aggregate") :].partition("\n")[2] for p in plans if "file_path" in p and "Aggregate" in p)


def test_paths_are_taken_apart_once_per_file(spark, tmp_path, many, monkeypatch):
    """Not once per row: neither where files are listed nor where a merge looks for those it touches."""
    seen, store = [], keyed.stored
    monkeypatch.setattr(keyed, "stored", lambda df: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or store(df))
    table = KeyedTable(spark, str(tmp_path), ["k"], 16)
    table.write(many)
    table.merge(deletes=many.select("k").limit(3))
    rows_work = _below_aggregates(seen)
    assert rows_work and "regexp_extract" not in rows_work and "split(" not in rows_work
    assert all(r["file"].startswith("data/") and f"={r['bucket']}/" in r["file"] for r in table.file_list().collect())
