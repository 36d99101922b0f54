import hashlib

import pytest
from pyspark.sql import functions as F

from tablemill import scratch
from tablemill.jobs import incremental
from tablemill.jobs.incremental import Mode, Rebuilder, canonical, file_hashes
from tablemill.jobs.publish import Conflict, Group, Rejected, group_hash
from tablemill.operators.validate import ValidationError, failure_counts, filter_rows, split_audited, validate
from tablemill.sources import files
from tablemill.specs import ColumnRule, TableRules
from tablemill.streaming.ingest import append_new_files


def build(spark, root, df, mode=Mode.NORMAL, **kw):
    r = Rebuilder(spark, root, mode)
    out = r.build("t", lambda x: x.select((F.col("id") * 2).alias("id")), {"x": df}, **kw)
    return sorted(row["id"] for row in out.collect()), r.computed


def test_rebuild_modes(spark, tmp_path):
    root = str(tmp_path)
    assert build(spark, root, spark.range(2)) == ([0, 2], ["t"])
    assert build(spark, root, spark.range(2)) == ([0, 2], [])
    assert build(spark, root, spark.range(3), Mode.IGNORE_FRESH_INPUT) == ([0, 2], [])
    with pytest.raises(RuntimeError):
        build(spark, root, spark.range(3), Mode.ASSERT_NO_FRESH_INPUT)
    assert build(spark, root, spark.range(3)) == ([0, 2, 4], ["t"])
    assert build(spark, root, spark.range(3), Mode.FORCE_FRESH_INPUT)[1] == ["t"]
    assert build(spark, root, spark.range(3), Mode.FORCE_ALL)[1] == ["t"]
    assert build(spark, root, spark.range(3), version="2")[1] == ["t"]


def test_own_fingerprint_decides(spark, tmp_path):
    root = str(tmp_path)
    assert build(spark, root, spark.range(2), fingerprint="monday")[1] == ["t"]
    assert build(spark, root, spark.range(9), fingerprint="monday") == ([0, 2], [])
    assert build(spark, root, spark.range(3), fingerprint="tuesday") == ([0, 2, 4], ["t"])


def test_intermediate_tables_go(spark):
    kept = scratch.stored(spark.range(2))

    def make():
        inner = scratch.stored(spark.range(5))
        return inner.crossJoin(scratch.stored(inner.limit(1).withColumnRenamed("id", "one")))

    before = set(files.names(spark, scratch.scratch_dir(spark)))
    out = scratch.stored_alone(spark, make)
    assert len(set(files.names(spark, scratch.scratch_dir(spark))) - before) == 1
    assert out.count() == 5 and kept.count() == 2


def test_canonical_text():
    assert canonical("SELECT  a -- why\nFROM t /* b\nc */ ;") == "SELECT a FROM t"


def test_publish_flip_reject_and_reuse(spark, tmp_path):
    group = Group(spark, str(tmp_path))
    a, b = spark.range(3), spark.range(5)
    assert group.read() == {}
    assert group.publish({"a": a, "b": b}) and group.pointer()["version"] == 1
    version = group.version()
    assert not group.publish({"a": a, "b": b}) and group.pointer()["version"] == 1

    def refuse(new, old):
        assert new["b"].count() == old["b"].count()

    with pytest.raises(Rejected):
        group.publish({"a": a, "b": spark.range(6)}, refuse)
    assert group.read()["b"].count() == 5 and group.candidate()["b"].count() == 6
    assert group.publish({"a": a, "b": spark.range(6)}) and group.pointer()["version"] == 2
    assert group.read()["b"].count() == 6 and group.read()["a"].count() == 3 and group.version() != version


def test_unchanged_tables_are_not_computed(spark, tmp_path):
    group = Group(spark, str(tmp_path))
    group.publish({"a": spark.range(3), "b": spark.range(2)}, keys={"a": "1", "b": "1"})

    def never():
        raise AssertionError("computed")

    assert group.publish({"a": never, "b": lambda: spark.range(4)}, keys={"a": "1", "b": "2"})
    assert group.read()["a"].count() == 3 and group.read()["b"].count() == 4


def test_unchanged_tables_stay_in_place_and_old_ones_go(spark, tmp_path):
    group, rows = Group(spark, str(tmp_path)), lambda n: spark.range(n).coalesce(1)
    parts = lambda: {str(p.relative_to(tmp_path)) for p in tmp_path.glob("*/*/part-*")}
    group.publish({"a": rows(3), "b": rows(2), "c": rows(1)})
    first = parts()
    group.publish({"a": rows(3), "b": rows(4), "c": rows(1)})
    second = parts()
    assert first < second and len(second - first) == 1 and "even/b.parquet" in next(iter(second - first))
    with pytest.raises(Rejected):
        group.publish({"a": rows(9), "b": rows(4)}, lambda new, old: 1 / 0)
    assert {n: t.count() for n, t in group.read().items()} == {"a": 3, "b": 4, "c": 1} and group.candidate()["a"].count() == 9
    for n in (5, 6, 7):
        group.publish({"a": rows(3), "b": rows(n)})  # c is no longer there
        assert {n: t.count() for n, t in group.read().items()} == {"a": 3, "b": n}
    assert {p.split("/")[1] for p in parts()} == {"a.parquet", "b.parquet"} and len(parts()) == 3


def test_group_hash_order():
    assert group_hash({"a": "1", "b": "2"}) == group_hash({"b": "2", "a": "1"}) != group_hash({"a": "2", "b": "1"})


def test_file_hashes(spark, tmp_path):
    (tmp_path / "x.txt").write_text("abc")
    row = file_hashes(spark, str(tmp_path)).first()
    assert (row["file_name"], row["file_size"], row["sha256"][:8]) == ("x.txt", 3, "ba7816bf")


def test_file_hashes_hold_no_large_file_whole(spark, tmp_path, monkeypatch):
    """A file beyond what one row may hold is hashed all the same."""
    (tmp_path / "x.bin").write_bytes(b"abc" * 100_000)
    (tmp_path / "y.bin").write_bytes(b"abc")
    monkeypatch.setattr(incremental, "WHOLE_FILE", 1000)
    limit = spark.conf.get("spark.sql.sources.binaryFile.maxLength")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")
    try:
        rows = file_hashes(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", limit)
    assert {(r["file_name"], r["file_size"], r["sha256"]) for r in rows} == {(n, len(b), hashlib.sha256(b).hexdigest()) for n, b in (("x.bin", b"abc" * 100_000), ("y.bin", b"abc"))}


def test_new_files_once(spark, tmp_path):
    source, target, checkpoint = (f"{tmp_path}/{n}" for n in ("in", "out", "check"))
    spark.range(3).coalesce(1).write.parquet(source)
    append_new_files(spark, source, spark.range(1).schema, target, checkpoint)
    append_new_files(spark, source, spark.range(1).schema, target, checkpoint)
    assert spark.read.parquet(target).count() == 3
    spark.range(2).coalesce(1).write.mode("append").parquet(source)
    append_new_files(spark, source, spark.range(1).schema, target, checkpoint)
    assert spark.read.parquet(target).count() == 5


# What must not be lost


def test_a_forced_build_that_fails_leaves_the_old_table(spark, tmp_path):
    """The note still names a whole table, and the next build of the same inputs uses it."""
    root = str(tmp_path)
    assert build(spark, root, spark.range(2)) == ([0, 2], ["t"])
    fails = F.raise_error(F.lit("no luck")).cast("long")
    for mode in (Mode.FORCE_ALL, Mode.FORCE_FRESH_INPUT):
        with pytest.raises(Exception, match="no luck"):
            Rebuilder(spark, root, mode).build("t", lambda x: x.select(F.when(F.col("id") > 0, fails).otherwise(F.col("id")).alias("id")), {"x": spark.range(2)})
        assert build(spark, root, spark.range(2)) == ([0, 2], [])
    assert len(list(tmp_path.glob("t-*.parquet"))) == 1


def test_a_table_read_by_its_own_rebuild(spark, tmp_path):
    """A build may read the table that it replaces, and readers of the old one are not cut off by the new one."""
    root = str(tmp_path)
    build(spark, root, spark.range(2))
    r = Rebuilder(spark, root, Mode.FORCE_ALL)
    old = Rebuilder(spark, root).build("t", lambda x: x.select((F.col("id") * 2).alias("id")), {"x": spark.range(2)})
    new = r.build("t", lambda x: x.union(x), {"x": old})
    assert new.count() == 4 and old.count() == 2
    build(spark, root, spark.range(7))
    assert len(list(tmp_path.glob("t-*.parquet"))) == 2


def refuse(new, old):
    raise ValueError("no")


def test_a_rejected_candidate_is_mended_and_published(spark, tmp_path):
    group = Group(spark, str(tmp_path))
    group.publish({"t": spark.range(3), "u": spark.range(2)})
    with pytest.raises(Rejected):
        group.publish({"t": spark.range(10), "u": spark.range(2)}, refuse)
    mended = {n: df.where("id < 5") for n, df in group.candidate().items()}
    with pytest.raises(Rejected):  # a second try may fail as well
        group.publish(mended, refuse)
    assert group.publish({n: df.where("id < 4") for n, df in group.candidate().items()})
    assert group.read()["t"].count() == 4 and group.pointer()["version"] == 2


def test_of_two_publishers_one_is_refused(spark, tmp_path):
    """The second one ends while the first is at its audit: the first finds its version taken."""
    group, other = Group(spark, str(tmp_path)), Group(spark, str(tmp_path))
    group.publish({"t": spark.range(1)})

    def meanwhile(new, old):
        assert other.publish({"t": spark.range(5)})
        assert new["t"].count() == 9 and old["t"].count() == 1  # files of either are still there

    with pytest.raises(Conflict):
        group.publish({"t": spark.range(9)}, meanwhile)
    assert group.read()["t"].count() == 5 and group.pointer()["version"] == 2
    assert group.publish({"t": spark.range(9)}) and group.pointer()["version"] == 3


def test_readers_across_publications(spark, tmp_path):
    group = Group(spark, str(tmp_path))
    group.publish({"t": spark.range(1), "u": spark.range(3)})
    with group.hold() as tables:
        for n in (2, 3, 4, 5):
            group.publish({"t": spark.range(n), "u": spark.range(3)})
        assert tables["t"].count() == 1 and group.versions() == [1, 4, 5]
        assert group.read(4)["t"].count() == 4
    group.publish({"t": spark.range(6), "u": spark.range(3)})
    assert group.versions() == [5, 6] and {n: t.count() for n, t in group.read().items()} == {"t": 6, "u": 3}
    with pytest.raises(LookupError):
        group.read(1)
    assert len(list(tmp_path.glob("0*/t.parquet"))) == 2 and len(list(tmp_path.glob("0*/u.parquet"))) == 1


def evaluations(spark, df):
    """df, and a counter of how many of its rows have been computed since."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    return df.mapInPandas(count, df.schema), seen


def test_a_source_is_evaluated_once(spark, tmp_path):
    """For the write, the hash, counts of failures, samples and the result."""
    group = Group(spark, str(tmp_path))
    rows, seen = evaluations(spark, spark.range(1000))
    group.publish({"t": rows})
    assert seen.value == 1000 and group.pointer()["tables"]["t"] == incremental.content_key(spark.range(1000))
    again, seen = evaluations(spark, spark.range(1000))
    assert not group.publish({"t": again}) and seen.value == 1000
    rules = TableRules((ColumnRule("id", "int", min=10, max=900), ColumnRule("k", "int", nullable=False)), ("k",))
    bad, seen = evaluations(spark, spark.range(1000).withColumn("k", F.when(F.col("id") != 5, F.col("id") % 990)))
    with pytest.raises(ValidationError) as error:
        validate(bad, rules)
    assert seen.value == 1000 and error.value.counts == {"id|min": 10, "id|max": 99, "k|nullability": 1, "_primary_key_": 19}
    assert len(error.value.samples) == 5
    plain = bad.collect()
    assert len(plain) == 1000


@pytest.mark.parametrize("keyed", [True, False])
def test_audited_rows_are_those_of_filter_rows(spark, tmp_path, keyed):
    rows = spark.createDataFrame([("1", 1), ("x", 2), (None, 2), ("50", None), ("7", 3), ("7", 4), ("2", 4)], "a string, failed_rules int")
    rules = TableRules((ColumnRule("a", "int", nullable=False, max=40),), ("failed_rules",) if keyed else ())
    good, bad, said = split_audited(rows, f"{tmp_path}/t", rules)
    g, b = filter_rows(rows, rules)
    key = lambda r: str(tuple(r))
    assert sorted(good.collect(), key=key) == sorted(g.collect(), key=key) and good.dtypes == g.dtypes
    assert sorted(bad.collect(), key=key) == sorted(b.collect(), key=key)
    assert said.failures == {r["rule"]: r["n"] for r in failure_counts(rows, rules).collect()} and said.row_count == 7
