import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemill.functions import scalars
from tablemill.jobs import features, frames, model, sqltext
from tablemill.operators import aggregates, compare, joins, sample, transform, windows
from tablemill.sources import files
from tablemill.sources import tables as store
from tablemill.specs import WriteOptions, mangle_name, table_name

DERBY = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
TYPES = "i8 tinyint, i16 smallint, i32 int, i64 bigint, f32 float, f64 double, s string, b boolean, d date, t timestamp_ntz"


@pytest.fixture
def extremes(spark):
    far = datetime.datetime(9999, 12, 31, 23, 59, 59), datetime.datetime(1, 1, 1)
    rows = [
        (-128, -(2**15), -(2**31), -(2**63), -3e38, -1e300, "", False, far[1].date(), far[1]),
        (127, 2**15 - 1, 2**31 - 1, 2**63 - 1, 3e38, 1e300, "äöüßéç λ \t\\N", True, far[0].date(), far[0]),
        (None,) * 10,
    ]
    return spark.createDataFrame(rows, TYPES)


def test_round_trip(spark, tmp_path, extremes):
    made = store.write_table(extremes, str(tmp_path), "Types/Table")
    assert files.exists(spark, f"{tmp_path}/types_table.parquet")
    assert made.dtypes == extremes.dtypes and compare.tables_equal(made, extremes)


def test_csv_keeps_null_and_empty_apart(spark, tmp_path):
    values = ["", None, "\\N", "null", "a,\"b\"", "ñ", " a\t", " "]
    one = spark.createDataFrame([(v,) for v in values], "s string")
    two = spark.createDataFrame([(v, w) for v in values for w in (None, "", "\\N")], "s string, t string")
    store.write_csv(one, f"{tmp_path}/one.csv.gz")
    store.write_csv(two, f"{tmp_path}/two.csv.gz")
    back = store.read_csv_dir(spark, str(tmp_path), {"one": one.schema, "two": two.schema})
    for name, df in (("one", one), ("two", two)):
        assert sorted(map(tuple, back[name].collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


def test_csv_folder_of_many_files_is_not_dealt_anew(spark, tmp_path):
    store.write_csv(spark.range(100).repartition(spark.sparkContext.defaultParallelism), f"{tmp_path}/many.csv.gz")
    store.write_csv(spark.range(100).coalesce(1), f"{tmp_path}/one.csv.gz")
    said = {n: df._jdf.queryExecution().optimizedPlan().toString() for n, df in store.read_csv_dir(spark, str(tmp_path)).items()}
    assert "Repartition" not in said["many"] and "Repartition" in said["one"]


def test_csv_infers(spark, tmp_path):
    store.write_csv(spark.range(3), f"{tmp_path}/n.csv.gz")
    assert dict(store.read_csv_dir(spark, str(tmp_path))["n"].dtypes) == {"id": "int"}


def test_external_missing(spark):
    with pytest.raises(LookupError):
        store.external_table(spark, "no_such_table")
    with pytest.raises(FileNotFoundError):
        store.external_table(spark, "/no/such/table.parquet")


def test_append_checks_schema(spark, tmp_path):
    store.write_table(spark.range(2), str(tmp_path), "t")
    with pytest.raises(ValueError):
        store.append_table(spark.range(2).withColumn("x", F.lit(1)), str(tmp_path), "t")
    store.append_table(spark.range(2), str(tmp_path), "t")
    assert store.read_table(spark, str(tmp_path), "t", limit=3).count() == 3
    store.drop_table(spark, str(tmp_path), "t")
    assert not files.exists(spark, f"{tmp_path}/t.parquet")


def test_typed_refuses_nulls(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.IntegerType(), False)])
    with pytest.raises(Exception, match="null in a"):
        store.write_typed(spark.createDataFrame([(1,), (None,)], "a bigint"), str(tmp_path), "t", schema)


def test_jdbc_options():
    said = store.jdbc_read_options("jdbc:x", "t", "id", (0, 100), 4)
    assert said["numPartitions"] == "4" and said["lowerBound"] == "0"
    with pytest.raises(ValueError):
        store.jdbc_read_options("jdbc:x", "t", "id")


def test_jdbc_round_trip(spark):
    url = "jdbc:derby:memory:round_trip;create=true"
    rows = spark.createDataFrame([(1, "a"), (2, None), (None, "c"), (900, "d")], "id bigint, s string")
    store.write_jdbc(rows, url, "t", driver=DERBY)
    back = store.read_jdbc(spark, url, "t", '"id"', (1, 3), 3, DERBY)  # rows beyond the bounds are read too
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    assert back.rdd.getNumPartitions() == 2
    store.write_jdbc(rows.limit(1), url, "t", "append", 1, DERBY)
    assert store.read_jdbc(spark, url, "t", driver=DERBY).count() == 5


def test_write_options():
    options = WriteOptions({"__any__": {"compression": "zstd", "partitions": 4}, "small": {"partitions": 1}})
    assert options.resolve("small") == {"compression": "zstd", "partitions": 1}
    assert options.resolve()["partitions"] == 4
    with pytest.raises(KeyError):
        options.resolve("other")


def test_names():
    assert table_name(" A/B ") == "a_b"
    assert mangle_name(None, "Task").startswith("task_") and mangle_name("X%%", "t").startswith("x_")
    assert mangle_name("Plain", "t") == "plain"


def test_join_fixture(spark):
    lazy = spark.createDataFrame([(1, 2)], "x int, y int")
    b = spark.createDataFrame([(2, 1), (1, 1), (0, 2), (1, 2)], "a int, x int")
    left = joins.left_join_pk(lazy, b, "x").select((F.col("x") * 5).alias("x5"), "a")
    assert sorted(map(tuple, left.collect())) == [(5, 1), (5, 2)]
    assert sorted(map(tuple, joins.inner_join(lazy, b, "x").collect())) == [(1, 2, 1), (1, 2, 2)]
    back = joins.enrich_with_aggregate(left, "a", x_sum=F.sum("x5"))
    assert sorted(map(tuple, back.collect())) == [(5, 1, 5), (5, 2, 5)]


def test_versions_fixture(spark):
    now = spark.createDataFrame([(12, 24)], "a int, b int")
    old = spark.createDataFrame([(-5, 1), (12, 2)], "a int, c int")
    assert joins.join_versions(now, old, "a").first()["c_before"] == 2
    assert joins.join_versions(now.withColumn("a", F.lit(-5)), old, "a").first()["c_before"] == 1


def test_cross_join_is_bounded(spark):
    with pytest.raises(ValueError):
        joins.cross_join_small(spark.range(200), spark.range(200))


def test_features_must_not_clash(spark):
    with pytest.raises(ValueError):
        joins.combine_features([spark.range(2).withColumn("x", F.lit(1))] * 2, "id")


def test_column_diff_fixture(spark):
    a = spark.createDataFrame([(0, 9)], "a int, b int")
    rows = compare.diff_columns(spark, {"dfa": a}, {"dfa": a.withColumn("c", F.lit(1))}).collect()
    assert [tuple(r) for r in rows] == [("dfa", "c", "missing", 1)]


def test_table_and_column_diff_count(spark):
    a, b = spark.createDataFrame([(1, None), (2, "x")], "a int, b string"), spark.range(3)
    found = compare.diff_tables(spark, {"a": a, "c": b}, {"a": a, "b": b.limit(0)})
    assert sorted(map(tuple, found.collect())) == [("b", "missing", 0), ("c", "added", 3)]
    found = compare.diff_columns(spark, {"t": a}, {"t": a.drop("b").withColumn("a", F.col("a").cast("long"))})
    assert sorted(map(tuple, found.collect())) == [("t", "a", "bigint to int", 2), ("t", "b", "added", 1)]
    assert compare.diff_tables(spark, {}, {}).count() == compare.diff_columns(spark, {"t": a}, {"t": a}).count() == 0


def test_hash_sees_nulls_repeats_and_not_order(spark):
    key = lambda rows: tuple(aggregates.table_hash(spark.createDataFrame(rows, "a string, b string")).first())
    assert key([("a", None), ("b", "c")]) == key([("b", "c"), ("a", None)])
    assert len({key([("a", None)]), key([("a", "")]), key([("", "a")]), key([(None, "a")]), key([("a", None)] * 2), key([])}) == 6
    alike = [("a\x1fb", "c"), ("a", "b\x1fc"), ("\x00", "c"), (None, "c"), ("n", "c"), ("1:n", "c"), ("", "1:c"), ("1:", "c"), ("ab", "c"), ("a", "bc")]
    assert len({key([r]) for r in alike}) == len(alike)
    assert not compare.tables_equal(spark.createDataFrame(alike[:1], "a string, b string"), spark.createDataFrame(alike[1:2], "a string, b string"))


def test_conflicting_pairs_take_all_rows(spark):
    """Rows that share key and value but not the rest count, in whatever order they come."""
    rows = [(1, "x", 10), (1, "x", 500), (1, "y", 490), (1, "y", 490), (None, "x", 10), (None, "y", 10), (1, None, 10)]
    near = F.abs(F.col("l.v") - F.col("r.v")) < 50
    for order in (rows, rows[::-1]):
        pairs = joins.conflicting_pairs(spark.createDataFrame(order, "k int, c string, v int").coalesce(1), "k", "c", near)
        assert sorted(map(tuple, pairs.select("l.v", "r.v").collect())) == [(490, 500), (500, 490)]


def test_aggregates_of_null_keys_and_clashing_names(spark):
    rows = spark.createDataFrame([(1, None, 5), (1, None, 6), (None, None, 7), (1, 2, 8)], "`a` int, `of_a` int, v int")
    back = joins.enrich_with_aggregate(rows, ["a", "of_a"], total=F.sum("v"))
    window = joins.enrich_with_window(rows, ["a", "of_a"], total=F.sum("v"))
    assert back.columns == window.columns
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, window.collect()), key=str) == sorted([(1, None, 5, 11), (1, None, 6, 11), (None, None, 7, 7), (1, 2, 8, 8)], key=str)


def test_tiny_shares_are_not_empty(spark):
    ids = spark.range(2_000_000)
    n = sample.hash_sample(ids, "id", 5e-6).count()
    assert 1 <= n <= 30 and sample.hash_sample(ids, "id", 5e-5).count() > n


def test_diff_rows_null_safe(spark):
    a = spark.createDataFrame([(1, None), (2, "x")], "k int, v string")
    b = spark.createDataFrame([(1, None), (2, None)], "k int, v string")
    assert [tuple(r) for r in compare.diff_rows(a, b, ["k"]).collect()] == [(2, "changed", "v")]


def test_diff_rows_of_null_and_repeated_keys_and_other_columns(spark):
    same = [(None, "x", 1), (1, "x", 1), (1, "x", 1), (2, "y", 2)]
    made = lambda rows: spark.createDataFrame(rows, "k int, new_v string, in_new int")
    said = lambda a, b: sorted(map(tuple, compare.diff_rows(a, b, ["k"]).collect()), key=str)
    assert said(made(same), made(same[::-1])) == []
    assert said(made(same), made(same[1:])) == [(None, "added", "")] and said(made(same[1:]), made(same)) == [(None, "removed", "")]
    assert said(made(same), made(same[:2] + same[3:])) == [(1, "changed", "new_v,in_new")]  # one row less
    assert said(made(same), made([*same[:3], (2, "z", 2)])) == [(2, "changed", "new_v")]
    swapped = [(1, "a", 1), (1, "b", 2)], [(1, "a", 2), (1, "b", 1)]
    assert said(*map(made, swapped)) == [(1, "changed", "")]  # each column holds the same values, the rows do not
    assert said(made(same), made(same).withColumn("more", F.when(F.col("k") == 2, 5))) == [(2, "changed", "more")]
    assert said(made(same).drop("in_new"), made(same).drop("new_v", "in_new")) == [(1, "changed", "new_v"), (2, "changed", "new_v"), (None, "changed", "new_v")]
    assert said(made(same), made(same).withColumn("in_new", F.col("in_new").cast("string"))) == []


def test_row_number_matches_window_and_empty(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    assert {r["x"]: r["row_number"] for r in windows.global_row_number(df, ["x"]).collect()} == {k: k + 1 for k in range(1000)}
    assert windows.global_row_number(df.limit(0), ["x"]).count() == 0
    ties = spark.range(5000).select(F.lit(None).cast("int").alias("x"), "id", F.create_map(F.lit("a"), "id").alias("m"))
    numbered = windows.global_row_number(ties.repartition(7), ["x"]).collect()
    assert sorted(r["row_number"] for r in numbered) == list(range(1, 5001))
    assert {r["id"]: r["row_number"] for r in windows.global_row_number(ties, ["x"]).collect()} == {r["id"]: r["row_number"] for r in numbered}


def test_running_sums_match_a_window_and_empty(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"), F.when(F.col("id") % 9 > 0, F.col("id")).alias("v"))
    found = windows.global_running_sums(df, ["x"], upto="v", places="x").collect()
    upto = places = 0
    for r in sorted(found, key=lambda r: r["x"]):
        upto, places = upto + (r["v"] or 0), places + r["x"]
        assert (r["upto"], r["places"]) == (upto, places)
    assert len(found) == 1000 and windows.global_running_sums(df.limit(0), ["x"], upto="v").count() == 0


def test_split_sizes(spark):
    train, test = windows.split_by_row_number(spark.range(25), ["id"])
    assert (train.count(), [r["id"] for r in test.orderBy("id").collect()]) == (23, [9, 19])
    assert [r["id"] for r in windows.split_by_row_number(spark.range(25), ["id"], offset=9)[1].orderBy("id").collect()] == [0, 10, 20]


def test_duplicate_null_keys(spark):
    df = spark.createDataFrame([(1,), (None,), (None,)], "a int")
    assert windows.mark_duplicates(df, ["a"]).where("is_duplicate").count() == 2


def test_type_repair(spark):
    df = spark.sql("SELECT CAST(1 AS DECIMAL(19,0)) a, CAST(1 AS DECIMAL(10,0)) b, CAST(1 AS DECIMAL(5,0)) c, CAST(1 AS DECIMAL(4,0)) d, CAST(1.5 AS DECIMAL(4,1)) e")
    assert dict(transform.repair_types(df).dtypes) == {"a": "bigint", "b": "bigint", "c": "int", "d": "smallint", "e": "decimal(4,1)"}


def test_type_map_errors(spark):
    with pytest.raises(ValueError):
        transform.apply_type_map(spark.range(1), {"x": "int"})
    with pytest.raises(Exception, match="CAST"):
        transform.apply_type_map(spark.createDataFrame([("x",)], "a string"), {"a": "int"}).collect()


def test_trim_leaves_tabs_and_others(spark):
    row = transform.trim_all_strings(spark.createDataFrame([(" a ", "\tb ", 1)], "x string, y string, z int")).first()
    assert tuple(row) == ("a", "\tb", 1)


def test_stable_filter_reaches_the_scan(spark, small, capsys):
    orders = spark.read.parquet(f"{small}/orders.parquet").select("o_orderkey", "o_orderdate")
    transform.known_by(orders, datetime.datetime(1998, 1, 1), "o_orderdate").explain()
    said = capsys.readouterr().out
    assert "LessThanOrEqual(o_orderdate" in said and "o_totalprice" not in said


def test_calendar_and_factor(spark):
    assert scalars.calendar(spark, datetime.date(2022, 1, 1), datetime.date(2023, 1, 1)).count() == 366
    names = spark.createDataFrame([("t_m100",), ("t",), ("t_mx",)], "n string")
    assert [r[0] for r in names.select(scalars.sampling_factor(F.col("n"))).collect()] == [100, 1, 1]
    assert [r["nr"] for r in scalars.numbers(spark, 3, 4, 2).orderBy("nr").collect()] == [2, 6, 10]


def test_instances_fixture(spark):
    a = spark.createDataFrame([(0, 9), (1, 8), (2, 7), (4, 6)], "a int, b int")
    assert [r["a"] for r in sample.first_rows({"dfa": a}, {"dfa": ["a"]}, 2)["dfa"].collect()] == [0, 1]
    assert sample.hash_sample(a, "a", 1.0).count() == 4 and sample.hash_sample(a, "a", 0.0).count() == 0


def test_scripts(spark):
    assert len(sqltext.statements("SELECT ';' AS x; -- a; comment\n ; SELECT 2")) == 2
    spark.range(4).createOrReplaceTempView("numbers")
    made = sqltext.run_script(spark, "CREATE OR REPLACE TEMPORARY VIEW v AS SELECT id FROM {{t}} WHERE id > 1", t="numbers")
    assert made["v"].count() == 2
    with pytest.raises(ValueError):
        sqltext.run_script(spark, "SELECT * FROM {{other}}")


def test_hooks(spark, tmp_path):
    hooks = frames.Hooks(on_write=lambda df: df.withColumn("x", F.lit(1)))
    hooks.write(spark.range(2), f"{tmp_path}/t")
    assert hooks.read(spark, f"{tmp_path}/t").columns == ["id", "x"]


def test_constant_target_is_refused(spark):
    with pytest.raises(ValueError):
        model.train_classifier(spark.range(5).withColumn("y", F.lit(1.0)), ["id"], "y")


def test_feature_flow(spark, small):
    train, test, complete = features.train_and_test(spark.read.parquet(f"{small}/customer.parquet"), spark.read.parquet(f"{small}/orders.parquet"))
    assert train.count() == 9 * test.count() and not complete.first()["has_promotions"]


def test_row_diff_of_maps(spark):
    """Maps of equal entries are equal in whatever order, also within structs and arrays."""
    schema = "k int, m map<string, int>, n struct<a: array<map<int, map<string, int>>>>"
    old = spark.createDataFrame([(1, {"a": 1, "b": 2}, ([{1: {"x": 1, "y": 2}}],)), (2, {"a": 1}, None), (3, None, ([None],))], schema)
    new = spark.createDataFrame([(1, {"b": 2, "a": 1}, ([{1: {"y": 2, "x": 1}}],)), (2, {"a": 2}, None), (3, {}, ([{}],))], schema)
    assert sorted(map(tuple, compare.diff_rows(new, old, ["k"]).collect())) == [(2, "changed", "m"), (3, "changed", "m,n")]


def test_a_step_removes_its_own_tables_alone(spark):
    from concurrent.futures import ThreadPoolExecutor

    from tablemill import scratch

    with ThreadPoolExecutor(1) as pool:
        made = {}

        def step():
            made["other"] = pool.submit(scratch.stored, spark.range(4)).result()
            made["own"] = scratch.stored(spark.range(3))
            return made["own"].union(made["own"])

        out = scratch.stored_alone(spark, step)
    assert out.count() == 6 and made["other"].count() == 4
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist|PATH_NOT_FOUND"):
        made["own"].count()


def test_narrowest_types_hold_all_values(spark):
    rows = spark.createDataFrame([(1, 40000, 2**40, None), (-5, None, 1, None)], "a long, b long, c long, d long")
    kinds = dict.fromkeys("abcd", ["smallint", "int"])
    assert transform.narrowest(rows, kinds) == {"a": "smallint", "b": "int", "d": "smallint"}
    assert transform.narrowest(rows.limit(0), {"a": ["smallint"]}) == {"a": "smallint"} and transform.narrowest(rows, {}) == {}


def test_generations_of_large_keys(spark, tmp_path):
    """Keys beyond smallint and int, and null ones, come through the generations of src_generations."""
    from tablemill.queries import QUERIES

    rows = [(1, 77192, "F", 1.0, "a"), (2**40, None, "F", 2.0, "b"), (3, 2**33, "O", 3.0, "c"), (4, 5, "P", 4.0, "d"), (5, 10**12, "P", 5.0, "e")]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    made = sorted(tuple(r) for r in QUERIES["src_generations"](spark, str(tmp_path)).select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority").collect())
    assert made == sorted((k, None if c is None else float(c), None if s == "F" else p, u if s == "P" else None) for k, c, s, p, u in rows)


def test_a_model_errs_no_more_than_a_constant(spark):
    """On noise: the threshold is that with the fewest errors, as the model itself decides, and 0 and 1 are among those tried."""
    rows = spark.createDataFrame([(float(x), float((x * 7919 + x * x * 31) % 11 < 5)) for x in range(300)], "x double, y double")
    fitted = model.train_classifier(rows, ["x"], "y")
    least = rows.groupBy("y").count().agg(F.min("count")).first()[0]
    wrong = lambda t: model.evaluate(rows, fitted.copy({fitted.stages[-1].thresholds: [1 - t, t]}), "y").agg(F.sum("abs_error")).first()[0]
    assert model.evaluate(rows, fitted, "y").agg(F.sum("abs_error")).first()[0] <= min(least, wrong(0.5))


def test_best_threshold_by_hand(spark):
    from pyspark.ml.linalg import Vectors

    def scored(rows):
        return spark.createDataFrame([(Vectors.dense(1 - p, p), y) for p, y in rows], ["probability", "y"])

    assert model.best_threshold(scored([(0.6, 0.0), (0.6, 0.0), (0.7, 1.0), (0.2, 0.0)]), "y") == 0.6
    assert model.best_threshold(scored([(0.6, 1.0), (0.4, 0.0)]), "y") == 0.5
    # Every split but the constant 0 errs more often.
    assert model.best_threshold(scored([(1.0, 0.0), (1.0, 0.0), (1.0, 1.0)]), "y") == 1.0
