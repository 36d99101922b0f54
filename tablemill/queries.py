"""One registered query per operation, over the given tables, each with DuckDB SQL for the same rows.

Sums of doubles are rounded to two digits, and null order is written out, so that engines agree.
"""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemill.functions import scalars
from tablemill.jobs import features, frames, incremental, keyed, model, publish, sqltext
from tablemill.operators import aggregates, compare, joins, sample, transform, validate, views, windows
from tablemill.scratch import new_path, stored
from tablemill.sources import database, layout
from tablemill.sources import tables as store
from tablemill.specs import CollectionRules, ColumnRule, CrossRule, SortKey, TableRules, TableSpec, ViewSpec, WriteOptions
from tablemill.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def query(sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r2(c) -> F.Column:
    return F.round(c, 2)


def one_row(spark: SparkSession, **values) -> DataFrame:
    return spark.range(1).select(*[F.lit(v).alias(n) for n, v in values.items()])


# Sources and sinks


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def src_csv_dir(spark, d):
    root = new_path(spark)
    nation = read(spark, d, "nation")
    store.write_csv(nation, f"{root}/nation.csv.gz")
    return store.read_csv_dir(spark, root, {"nation": nation.schema})["nation"]


@query("SELECT c_custkey, c_name || chr(10) || c_mktsegment || chr(13) || chr(10) || '\"quoted\", ' || chr(13) AS note FROM customer")
def src_csv_lines(spark, d):
    """Texts with line breaks, returns, quotes and commas, written and read back."""
    root = new_path(spark)
    notes = read(spark, d, "customer").select("c_custkey", F.concat("c_name", F.lit("\n"), "c_mktsegment", F.lit('\r\n"quoted", \r')).alias("note"))
    store.write_csv(notes, f"{root}/notes.csv.gz")
    return store.read_csv_dir(spark, root, {"notes": notes.schema})["notes"]


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def src_parquet_columns(spark, d):
    return store.read_table(spark, d, "orders", ["o_orderkey", "o_orderstatus"])


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY ALL")
def src_parquet_many(spark, d):
    root, orders = new_path(spark), read(spark, d, "orders")
    for s in ("F", "O", "P"):
        orders.where(F.col("o_orderstatus") == s).write.parquet(f"{root}/{s}")
    return store.read_union(spark, [f"{root}/{s}" for s in ("F", "O", "P")]).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS o_custkey, CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS o_totalprice,
    CASE WHEN o_orderstatus = 'P' THEN o_orderpriority END AS o_orderpriority FROM orders""")
def src_generations(spark, d):
    """Three generations of a table: types became wider, and columns came in. Each has the narrowest types that hold its values."""
    root, orders = new_path(spark), read(spark, d, "orders")
    price = F.col("o_totalprice").cast("double")
    keys = {"F": {"o_orderkey": ["int"], "o_custkey": ["smallint", "int"]}, "O": {"o_orderkey": ["int"], "o_custkey": ["int"]}, "P": {"o_custkey": ["decimal(12,2)"]}}
    more = {"F": [], "O": [price], "P": [price, F.col("o_orderpriority")]}
    for status, kinds in keys.items():
        rows = orders.where(F.col("o_orderstatus") == status)
        held = transform.narrowest(rows, kinds)
        rows.select(*[F.col(c).cast(held[c]) if c in held else F.col(c) for c in ("o_orderkey", "o_custkey")], *more[status]).write.parquet(f"{root}/{status}")
    return store.read_union(spark, [f"{root}/{s}" for s in keys]).withColumn("o_custkey", F.col("o_custkey").cast("double"))


@query("SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal > 1000")
def src_external(spark, d):
    read(spark, d, "supplier").createOrReplaceTempView("external_supplier")
    return store.external_table(spark, "external_supplier").where("s_acctbal > 1000").select("s_suppkey", "s_acctbal")


@query("SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL")
def sink_ctas(spark, d):
    made = store.write_table(read(spark, d, "orders"), new_path(spark), TableSpec("Orders Copy"))
    return made.groupBy("o_orderpriority").agg(F.count("*").alias("n"), r2(F.sum("o_totalprice")).alias("total"))


@query("SELECT CAST(p_partkey AS INTEGER) AS p_partkey, CAST(p_size AS SMALLINT) AS p_size, p_brand FROM part")
def sink_typed(spark, d):
    schema = T.StructType([T.StructField("p_partkey", T.IntegerType(), False), T.StructField("p_size", T.ShortType()), T.StructField("p_brand", T.StringType())])
    return store.write_typed(read(spark, d, "part"), new_path(spark), "part", schema)


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY ALL")
def sink_append(spark, d):
    root, orders = new_path(spark), read(spark, d, "orders")
    store.write_table(orders.where("o_orderstatus = 'F'"), root, "orders")
    store.append_table(orders.where("o_orderstatus = 'O'"), root, "orders")
    return store.read_table(spark, root, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority = '2-HIGH'")
def sink_overwrite(spark, d):
    root, orders = new_path(spark), read(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    store.write_table(orders.where("o_orderpriority = '1-URGENT'"), root, "orders")
    store.overwrite_table(orders.where("o_orderpriority = '2-HIGH'"), root, "orders")
    return store.read_table(spark, root, "orders")


@query("SELECT (SELECT count(*) FROM customer) AS before, 0::BIGINT AS after, 'c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment' AS columns")
def sink_truncate(spark, d):
    root, customer = new_path(spark), read(spark, d, "customer")
    before = store.write_table(customer, root, "customer").count()
    store.truncate_table(spark, root, "customer")
    after = store.read_table(spark, root, "customer")
    return after.agg(F.lit(before).cast("long").alias("before"), F.count("*").alias("after"), F.lit(",".join(after.columns)).alias("columns"))


@query("SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ALL")
def sink_copy(spark, d):
    store.copy_table(spark, f"{d}/lineitem.parquet", target := new_path(spark))
    return spark.read.parquet(target).groupBy("l_returnflag").agg(F.count("*").alias("n"), r2(F.sum("l_quantity")).alias("quantity"))


DERBY = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


@query("SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, s_name, s_acctbal FROM supplier")
def src_jdbc(spark, d):
    """Through the embedded database that comes with Spark. It lives in one JVM, so this runs on a local master."""
    url = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    supplier = read(spark, d, "supplier").select(F.col("s_suppkey").cast("long"), "s_name", "s_acctbal")
    store.write_jdbc(supplier, url, "supplier", partitions=4, driver=DERBY)
    low, high = supplier.agg(F.min("s_suppkey"), F.max("s_suppkey")).first()
    return store.read_jdbc(spark, url, "supplier", '"s_suppkey"', (low, high), 4, DERBY)


@query("SELECT o_orderkey, o_custkey, CAST(o_orderkey AS BIGINT) * o_orderkey * o_orderkey AS cube FROM orders")
def src_jdbc_even(spark, d):
    """Loaded so that each row is there once, and read in parts of equal size by a key that is spread unevenly."""
    url = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    cube = F.col("o_orderkey") * F.col("o_orderkey") * F.col("o_orderkey")
    database.load_jdbc(read(spark, d, "orders").select("o_orderkey", "o_custkey", cube.alias("cube")), url, "cubes", 4, DERBY)
    return database.read_jdbc_evenly(spark, url, "cubes", '"cube"', 4, DERBY)


@query("SELECT o_orderkey, CAST(o_orderdate AS VARCHAR) AS day FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1997-03-01' AND TIMESTAMP '1997-05-31'")
def filter_range_files(spark, d):
    """Orders stored by date; only files whose dates meet the range are scanned."""
    orders = read(spark, d, "orders").select("o_orderkey", "o_orderdate")
    layout.write_by_range(orders, path := f"{new_path(spark)}/orders.parquet", "o_orderdate", 16)
    found = layout.read_range(spark, path, "o_orderdate", datetime.datetime(1997, 3, 1), datetime.datetime(1997, 5, 31))
    return found.select("o_orderkey", F.col("o_orderdate").cast("string").alias("day"))


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in TABLES))
def sink_dump(spark, d):
    root = new_path(spark)
    names = store.dump_tables({t: read(spark, d, t) for t in TABLES}, root)
    return views.union_all([spark.read.parquet(f"{root}/{n}.parquet").agg(F.lit(n).alias("table_name"), F.count("*").alias("n")) for n in names])


@query("SELECT event_type, count(*) AS n FROM events GROUP BY ALL")
def sink_compression(spark, d):
    options = WriteOptions({"__any__": {"compression": "snappy"}, "archive": {"compression": "zstd", "partitions": 2, "sort_by": ["event_type"]}})
    made = store.write_table(read(spark, d, "events"), new_path(spark), "events", options, "archive")
    return made.groupBy("event_type").agg(F.count("*").alias("n"))


# Projection, filter, typing


@query("SELECT c_name, c_custkey FROM customer")
def proj_subset(spark, d):
    return transform.select_cols(read(spark, d, "customer"), ["c_name", "c_custkey"])


@query("SELECT c_custkey AS id, c_mktsegment AS segment FROM customer")
def proj_rename(spark, d):
    return transform.rename_cols(read(spark, d, "customer"), {"id": "c_custkey", "segment": "c_mktsegment"})


@query("SELECT l_orderkey, l_extendedprice * (1 - l_discount) AS net, 2 * l_quantity * l_extendedprice AS double_gross FROM lineitem")
def proj_transmute(spark, d):
    price = F.col("l_extendedprice")
    return transform.transmute(read(spark, d, "lineitem"), l_orderkey=F.col("l_orderkey"), net=price * (1 - F.col("l_discount")), double_gross=2 * F.col("l_quantity") * price)


@query("SELECT *, 'v1' AS version FROM nation")
def proj_literal(spark, d):
    return transform.add_literal(read(spark, d, "nation"), "version", "v1")


@query("SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def proj_drop(spark, d):
    return read(spark, d, "supplier").drop("s_acctbal")


@query("SELECT c_custkey, trim(c_name) AS c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def clean_trim_all(spark, d):
    padded = read(spark, d, "customer").withColumn("c_name", F.concat(F.lit("  "), "c_name", F.lit(" "))).withColumn("c_mktsegment", F.concat("c_mktsegment", F.lit("   ")))
    return transform.trim_all_strings(padded)


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS INTEGER) AS o_custkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS o_orderdate FROM orders")
def type_map(spark, d):
    orders = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    typed = transform.apply_type_map(orders, {"o_orderkey": "string", "o_custkey": "int", "o_orderdate": "date"})
    return transform.apply_type_map(typed, {"o_orderdate": "string"})


@query("SELECT o_custkey, count(*) AS n, CAST(max(o_orderdate) AS TIMESTAMP) AS latest FROM orders GROUP BY ALL")
def type_repair(spark, d):
    counts = read(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").cast("decimal(19,0)").alias("n"), F.max("o_orderdate").cast("timestamp").alias("latest"))
    return transform.repair_types(counts)


@query("SELECT event_id, TRY_CAST(regexp_extract(props, '[0-9a-z]+', 0) AS INTEGER) AS first_word, TRY_CAST(regexp_extract(props, '[0-9]+', 0) AS INTEGER) AS number FROM events")
def try_cast(spark, d):
    words = read(spark, d, "events").select("event_id", F.regexp_extract("props", "[0-9a-z]+", 0).alias("first_word"), F.regexp_extract("props", "[0-9]+", 0).alias("number"))
    return transform.try_cast(words, {"first_word": "int", "number": "int"})


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45")
def filter_gt(spark, d):
    return read(spark, d, "lineitem").where("l_quantity > 45").select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate <= TIMESTAMP '1998-06-30'")
def filter_stable_date(spark, d):
    return transform.known_by(read(spark, d, "orders").select("o_orderkey", "o_orderdate"), datetime.datetime(1998, 6, 30), "o_orderdate")


def _intervals(spark, d) -> DataFrame:
    """First to last event of each user; open where the last one is an error."""
    events = read(spark, d, "events").groupBy("user_id").agg(F.to_date(F.min("ts")).alias("start_date"), F.max(F.struct("ts", "event_id", "event_type")).alias("last"))
    end = F.when(F.col("last.event_type") == "error", F.lit(transform.OPEN_END)).otherwise(F.to_date("last.ts"))
    return events.select("user_id", "start_date", end.alias("end_date"))


INTERVALS = """(SELECT user_id, CAST(min(ts) AS DATE) AS start_date,
    CASE WHEN arg_max(event_type, (ts, event_id)) = 'error' THEN DATE '9999-01-01' ELSE CAST(max(ts) AS DATE) END AS end_date FROM events GROUP BY user_id)"""


@query(f"SELECT user_id, CAST(start_date AS VARCHAR) AS start_date, CAST(end_date AS VARCHAR) AS end_date FROM {INTERVALS} WHERE end_date = DATE '9999-01-01'")
def filter_open_interval(spark, d):
    return transform.apply_type_map(transform.current_rows(_intervals(spark, d)), {"start_date": "string", "end_date": "string"})


# Joins


def _orders_per_customer(spark, d) -> DataFrame:
    return read(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"))


@query("SELECT c_custkey, c_name, n_orders FROM customer LEFT JOIN (SELECT o_custkey AS c_custkey, count(*) AS n_orders FROM orders GROUP BY ALL) USING (c_custkey)")
def join_left_pk(spark, d):
    return joins.left_join_pk(read(spark, d, "customer").select("c_custkey", "c_name"), _orders_per_customer(spark, d), "c_custkey")


@query("SELECT o_orderkey, o_totalprice * 2 AS twice, upper(c_mktsegment) AS segment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def join_left_expr(spark, d):
    customer = read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    joined = joins.left_join_pk(read(spark, d, "orders"), customer, "o_custkey")
    return joined.select("o_orderkey", (F.col("o_totalprice") * 2).alias("twice"), F.upper("c_mktsegment").alias("segment"))


@query("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def join_inner(spark, d):
    nation = read(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return joins.inner_join(read(spark, d, "supplier"), nation, "s_nationkey").select("s_suppkey", "n_name")


@query("SELECT DISTINCT c_custkey, 'no urgent order' AS reason FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def join_anti_missing(spark, d):
    urgent = read(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return joins.missing_keys(read(spark, d, "customer"), urgent, "c_custkey", "no urgent order")


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50)")
def join_semi(spark, d):
    used = read(spark, d, "lineitem").where("l_quantity >= 50").select(F.col("l_partkey").alias("p_partkey"))
    return joins.rows_with_keys(read(spark, d, "part").select("p_partkey", "p_name"), used, "p_partkey")


def _by_nation(spark, d, table: str, key: str, value: str, low: int) -> DataFrame:
    return read(spark, d, table).where(f"{value} > {low}").groupBy(F.col(key).alias("nation")).agg(F.count("*").alias(f"n_{table}"))


@query("""SELECT coalesce(c.nation, s.nation, r.nation) AS nation, n_customer, n_supplier, r_name FROM (SELECT c_nationkey AS nation, count(*) AS n_customer FROM customer WHERE c_acctbal > 9000 GROUP BY ALL) c
    FULL JOIN (SELECT s_nationkey AS nation, count(*) AS n_supplier FROM supplier WHERE s_acctbal > 9000 GROUP BY ALL) s ON c.nation = s.nation
    FULL JOIN (SELECT r_regionkey AS nation, r_name FROM region) r ON coalesce(c.nation, s.nation) = r.nation""")
def join_full(spark, d):
    both = joins.full_join(_by_nation(spark, d, "customer", "c_nationkey", "c_acctbal", 9000), _by_nation(spark, d, "supplier", "s_nationkey", "s_acctbal", 9000), "nation")
    return joins.full_join(both, read(spark, d, "region").withColumnRenamed("r_regionkey", "nation"), "nation")


@query("""SELECT coalesce(c.nation, s.nation) AS nation, n_customer, n_supplier FROM (SELECT c_nationkey AS nation, count(*) AS n_customer FROM customer GROUP BY ALL) c
    FULL JOIN (SELECT s_nationkey AS nation, count(*) AS n_supplier FROM supplier GROUP BY ALL) s ON c.nation = s.nation AND length(CAST(c.nation AS VARCHAR)) = 2""")
def join_full_cond(spark, d):
    a, b = (_by_nation(spark, d, t, f"{t[0]}_nationkey", f"{t[0]}_acctbal", -10_000) for t in ("customer", "supplier"))
    return joins.full_join(a, b, "nation", F.length(F.col("l.nation").cast("string")) == 2)


@query("""WITH s AS (SELECT s_suppkey, CASE WHEN s_suppkey % 11 <> 0 THEN s_nationkey END AS nation, s_acctbal FROM supplier),
    t AS (SELECT * FROM s UNION SELECT s_suppkey, nation, s_acctbal + 5 FROM s WHERE s_suppkey % 3 = 0)
    SELECT a.s_suppkey AS left_key, b.s_suppkey AS right_key, round(a.s_acctbal - b.s_acctbal, 2) AS gap, a.nation AS nation FROM t a JOIN t b
    ON a.nation = b.nation AND a.s_suppkey <> b.s_suppkey AND abs(a.s_acctbal - b.s_acctbal) < 100""")
def join_theta_self(spark, d):
    """Some nations are missing, some suppliers have two balances, and some rows are there twice."""
    nation = F.when(F.col("s_suppkey") % 11 != 0, F.col("s_nationkey")).alias("nation")
    once = read(spark, d, "supplier").select("s_suppkey", nation, "s_acctbal")
    more = once.where("s_suppkey % 3 = 0").withColumn("s_acctbal", F.col("s_acctbal") + 5)
    rows = views.union_all([once, more, once.where("s_suppkey % 5 = 0")])
    pairs = joins.conflicting_pairs(rows, "nation", "s_suppkey", within=("s_acctbal", 100))
    gap = r2(F.col("l.s_acctbal") - F.col("r.s_acctbal")).alias("gap")
    return pairs.select(F.col("l.s_suppkey").alias("left_key"), F.col("r.s_suppkey").alias("right_key"), gap, F.col("l.nation").alias("nation"))


AGG_BACK = """SELECT order_key, l_linenumber, l_partkey, l_quantity, sum(l_quantity) OVER (PARTITION BY order_key) AS order_quantity
    FROM (SELECT CASE WHEN l_partkey % 50 <> 0 THEN l_orderkey END AS order_key, l_linenumber, l_partkey, l_quantity FROM lineitem)"""


def _items(spark, d) -> DataFrame:
    """Items of which some have lost their order."""
    key = F.when(F.col("l_partkey") % 50 != 0, F.col("l_orderkey")).alias("order_key")
    return read(spark, d, "lineitem").select(key, "l_linenumber", "l_partkey", "l_quantity")


@query(AGG_BACK)
def join_agg_back(spark, d):
    return joins.enrich_with_aggregate(_items(spark, d), "order_key", order_quantity=F.sum("l_quantity"))


@query(AGG_BACK)
def join_agg_window(spark, d):
    return joins.enrich_with_window(_items(spark, d), "order_key", order_quantity=F.sum("l_quantity"))


@query("SELECT r_name, n_name FROM region, nation")
def join_cross(spark, d):
    return joins.cross_join_small(read(spark, d, "region").select("r_name"), read(spark, d, "nation").select("n_name"))


@query("""SELECT c_custkey, n_orders, n_urgent, c_acctbal * 2 AS twice FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY ALL) a ON c_custkey = a.o_custkey
    LEFT JOIN (SELECT o_custkey, count(*) AS n_urgent FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY ALL) b ON c_custkey = b.o_custkey""")
def join_features(spark, d):
    urgent = read(spark, d, "orders").where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_urgent"))
    own = read(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") * 2).alias("twice"))
    return joins.combine_features([own, _orders_per_customer(spark, d), urgent], "c_custkey")


@query("""SELECT c_custkey, n_orders, n_urgent, c_acctbal * 2 AS twice FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY ALL) a ON c_custkey = a.o_custkey
    LEFT JOIN (SELECT o_custkey, count(*) AS n_urgent FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY ALL) b ON c_custkey = b.o_custkey""")
def join_bucketed(spark, d):
    """The same features from three stored tables of one layout: no shuffle to join them, however often."""
    urgent = read(spark, d, "orders").where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_urgent"))
    own = read(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") * 2).alias("twice"))
    tables = {"own": own, "orders": _orders_per_customer(spark, d), "urgent": urgent}
    stem = f"bucketed_{uuid.uuid4().hex[:12]}"
    return joins.combine_features([layout.write_bucketed(df, f"{stem}_{n}", "c_custkey", 8, new_path(spark)) for n, df in tables.items()], "c_custkey")


@query("""SELECT o_orderkey, o_orderstatus, b.o_orderstatus_before FROM orders LEFT JOIN (SELECT o_orderkey, lower(o_orderstatus) AS o_orderstatus_before FROM orders WHERE o_orderstatus <> 'P') b USING (o_orderkey)""")
def join_versions(spark, d):
    orders = read(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    before = stored(orders.where("o_orderstatus <> 'P'").withColumn("o_orderstatus", F.lower("o_orderstatus")))
    return joins.join_versions(orders, before, "o_orderkey")


# Aggregates


@query("SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice), 2) AS price, sum(l_quantity) AS quantity FROM lineitem GROUP BY ALL")
def agg_sum(spark, d):
    return aggregates.group_sum(read(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], price="l_extendedprice", quantity="l_quantity").withColumn("price", r2(F.col("price")))


@query("SELECT true AS has_labels, false AS has_promotions, (SELECT count(*) FROM customer) AS cnt_customer, (SELECT count(*) FROM orders) AS cnt_orders")
def agg_completeness(spark, d):
    return aggregates.completeness({t: read(spark, d, t) for t in ("customer", "orders")}, {"labels": read(spark, d, "labels"), "promotions": None})


@query("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def agg_distinct(spark, d):
    return aggregates.distinct_keys(read(spark, d, "lineitem"), ["l_partkey", "l_suppkey"])


@query(f"SELECT user_id, CAST(max(end_date) AS VARCHAR) AS max_end_date FROM {INTERVALS} GROUP BY user_id HAVING max(end_date) < DATE '9999-01-01'")
def agg_having_max(spark, d):
    return transform.apply_type_map(aggregates.keys_without_open_end(_intervals(spark, d), ["user_id"], "end_date", transform.OPEN_END), {"max_end_date": "string"})


KEYED = {t: k for t, k in zip(TABLES, "r_regionkey n_nationkey c_custkey s_suppkey p_partkey o_orderkey l_orderkey event_id doc_id vec_id page_id item_id doc_id conv_id".split(), strict=True)}
DATED = {"orders": "o_orderdate", "lineitem": "l_shipdate"}


@query(" UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS row_count, CAST(sum(length(CAST({k} AS VARCHAR))) AS BIGINT) AS key_length, " + (f"CAST(max({DATED[t]}) AS VARCHAR)" if t in DATED else "''") + f" AS latest FROM {t}" for t, k in KEYED.items()
))
def agg_fingerprint(spark, d):
    return aggregates.fingerprints({t: (read(spark, d, t), k, [DATED[t]] if t in DATED else []) for t, k in KEYED.items()})


@query("SELECT min(toxic) AS low, max(toxic) AS high, min(toxic) = max(toxic) AS constant FROM labels")
def agg_variance(spark, d):
    return aggregates.is_constant(read(spark, d, "labels"), "toxic")


# Windows, sorts, sets


@query("SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS row_number FROM orders")
def win_row_number(spark, d):
    return windows.global_row_number(read(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_custkey", "o_orderkey"])


@query("SELECT c_custkey, c_name FROM customer QUALIFY row_number() OVER (ORDER BY c_custkey) % 10 <> 0")
def win_split_train(spark, d):
    return windows.split_by_row_number(read(spark, d, "customer").select("c_custkey", "c_name"), ["c_custkey"])[0]


@query("SELECT c_custkey, c_name FROM customer QUALIFY (row_number() OVER (ORDER BY c_custkey) + 9) % 10 = 0")
def win_split_test(spark, d):
    return windows.split_by_row_number(read(spark, d, "customer").select("c_custkey", "c_name"), ["c_custkey"], offset=9)[1]


@query("SELECT l_orderkey, l_linenumber, l_partkey, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1 AS is_duplicate FROM lineitem")
def win_dup_key(spark, d):
    return windows.mark_duplicates(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey", "l_linenumber"])


HIGH = "CASE WHEN c_acctbal > 5000 THEN c_mktsegment END"


@query(f"SELECT c_custkey, {HIGH} AS segment, row_number() OVER (ORDER BY {HIGH} DESC NULLS LAST, c_custkey) AS place FROM customer")
def sort_nulls(spark, d):
    customers = read(spark, d, "customer").select("c_custkey", F.expr(HIGH).alias("segment"))
    keys = [SortKey("segment", descending=True, nulls_first=False), SortKey("c_custkey")]
    return windows.global_row_number(customers, [views.sort_column(k) for k in keys], "place")


@query("SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 25")
def limit_rows(spark, d):
    return views.sort_by(read(spark, d, "part").select("p_partkey", "p_name"), [SortKey("p_partkey")]).limit(25)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def topk(spark, d):
    return views.top_k(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), [SortKey("o_totalprice", True), SortKey("o_orderkey")], 10)


@query("SELECT c_nationkey AS nation, c_acctbal AS balance FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier")
def union_all(spark, d):
    customer = transform.rename_cols(read(spark, d, "customer"), {"nation": "c_nationkey", "balance": "c_acctbal"})
    supplier = transform.rename_cols(read(spark, d, "supplier"), {"balance": "s_acctbal", "nation": "s_nationkey"})
    return views.union_all([customer, supplier])


STATUS_FACTORS = {"F": 1, "O": 2, "P": 3}


@query("SELECT o_orderkey, o_orderstatus, o_custkey * CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS weighed FROM orders")
def split_union(spark, d):
    path = views.split_by_value(read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "o_orderstatus")
    parts = [spark.read.parquet(path).where(F.col("o_orderstatus") == s) for s in STATUS_FACTORS]
    return views.union_all([p.select("o_orderkey", "o_orderstatus", (F.col("o_custkey") * k).alias("weighed")) for p, k in zip(parts, STATUS_FACTORS.values(), strict=True)])


@query("SELECT l_partkey, l_suppkey FROM lineitem EXCEPT ALL SELECT l_partkey, l_suppkey FROM lineitem WHERE l_quantity > 10")
def except_all(spark, d):
    items = read(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_quantity")
    return views.except_all(items.drop("l_quantity"), items.where("l_quantity > 10").drop("l_quantity"))


# Views


@query("SELECT o_orderkey AS id FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 20")
def view_single(spark, d):
    return views.resolve(ViewSpec("orders", {"id": "o_orderkey"}, ["o_orderdate", "o_orderkey"], 20), {"orders": read(spark, d, "orders")})


@query("SELECT k FROM (SELECT c_custkey AS k, c_acctbal AS b FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier) ORDER BY b DESC, k LIMIT 30")
def view_union_sorted(spark, d):
    sources = {t: read(spark, d, t).select(F.col(k).alias("k"), F.col(b).alias("b")) for t, k, b in (("customer", "c_custkey", "c_acctbal"), ("supplier", "s_suppkey", "s_acctbal"))}
    return views.resolve(ViewSpec(["customer", "supplier"], ["k"], [SortKey("b", True), SortKey("k")], 30), sources)


_INNER = ViewSpec("part", {"id": "p_partkey", "price": "p_retailprice"}, [SortKey("p_size", True), SortKey("p_partkey")], 50)


@query("SELECT p_retailprice AS cost FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 40")
def view_fused(spark, d):
    return views.resolve(ViewSpec(_INNER, {"cost": "price"}, [SortKey("price", True), SortKey("id")], 40), {"part": read(spark, d, "part")})


@query("SELECT price AS cost FROM (SELECT p_partkey AS id, p_retailprice AS price FROM part ORDER BY p_size DESC, p_partkey LIMIT 50) ORDER BY price DESC, id LIMIT 40")
def view_nested(spark, d):
    return views.nest(ViewSpec(_INNER, {"cost": "price"}, [SortKey("price", True), SortKey("id")], 40), {"part": read(spark, d, "part")})


@query("SELECT p_partkey AS id, p_retailprice AS price FROM part ORDER BY p_size DESC, p_partkey LIMIT 5")
def view_read_limit(spark, d):
    return views.resolve(_INNER, {"part": read(spark, d, "part")}, limit=5)


# Scalar functions


@query("SELECT l_orderkey, l_linenumber, l_partkey % 7 AS rest, abs(l_quantity - 25) AS distance, l_quantity * 2 + 1 AS affine FROM lineitem")
def fn_math(spark, d):
    q = F.col("l_quantity")
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 7).alias("rest"), F.abs(q - 25).alias("distance"), (q * 2 + 1).alias("affine"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(CAST(o_orderdate AS DATE) + 30 AS VARCHAR) AS due, '9999-01-01' AS valid_to FROM orders")
def fn_dates(spark, d):
    day = F.to_date("o_orderdate")
    return read(spark, d, "orders").select("o_orderkey", day.cast("string").alias("day"), F.date_add(day, 30).cast("string").alias("due"), F.lit(transform.OPEN_END).cast("string").alias("valid_to"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size ELSE 1 END AS factor FROM part")
def fn_sampling_factor(spark, d):
    name = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("part_m"), F.col("p_size").cast("string"))).otherwise("part_mix")
    return read(spark, d, "part").select("p_partkey", scalars.sampling_factor(name).alias("factor"))


@query("SELECT CAST(CAST(unnest(generate_series((SELECT min(o_orderdate) FROM orders), (SELECT max(o_orderdate) FROM orders), INTERVAL 1 DAY)) AS DATE) AS VARCHAR) AS dt")
def gen_calendar(spark, d):
    first, last = read(spark, d, "orders").agg(F.to_date(F.min("o_orderdate")), F.to_date(F.max("o_orderdate"))).first()
    return scalars.calendar(spark, first, last).select(F.col("dt").cast("string"))


@query("SELECT c_custkey * 3 + 5 AS nr FROM customer")
def gen_numbers(spark, d):
    return scalars.numbers(spark, read(spark, d, "customer").count(), 3, 5)


@query("SELECT c_custkey, ('0x' || substr(md5(c_name), 1, 15))::BIGINT AS h FROM customer")
def fn_stable_hash(spark, d):
    return read(spark, d, "customer").select("c_custkey", scalars.stable_hash(F.col("c_name")).alias("h"))


@query("SELECT doc_id, contains(text, 'é') AS has_e, contains(text, 'ñ') AS has_n, length(text) AS chars FROM documents")
def fn_unicode(spark, d):
    return read(spark, d, "documents").select("doc_id", F.contains("text", F.lit("é")).alias("has_e"), F.contains("text", F.lit("ñ")).alias("has_n"), F.length("text").cast("long").alias("chars"))


# Validation

EVENT_RULES = TableRules((
    ColumnRule("event_id", "bigint", nullable=False), ColumnRule("number", "int", nullable=False, min=10, max=90), ColumnRule("event_type", "string", values=("click", "view", "purchase")),
))


def _events(spark, d) -> DataFrame:
    """Events with the number of props as text: now and then a letter (lost by the cast) or null."""
    raw = F.regexp_extract("props", "[0-9]+", 0)
    number = F.when(F.col("event_id") % 7 == 0, F.concat(raw, F.lit("x"))).when(F.col("event_id") % 11 == 0, F.lit(None)).otherwise(raw)
    return read(spark, d, "events").select("event_id", number.alias("number"), "event_type")


EVENTS = """(SELECT *, TRY_CAST(number AS INTEGER) AS v FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN regexp_extract(props, '[0-9]+', 0) || 'x'
    WHEN event_id % 11 = 0 THEN NULL ELSE regexp_extract(props, '[0-9]+', 0) END AS number, event_type FROM events))"""
FAILS = {
    "number|dtype": "number IS NOT NULL AND v IS NULL", "number|nullability": "number IS NULL", "number|min": "coalesce(v < 10, false)",
    "number|max": "coalesce(v > 90, false)", "event_type|enum": "event_type NOT IN ('click', 'view', 'purchase')",
}


def _marked(spark, d, name: str) -> DataFrame:
    checked, failed = validate.check(_events(spark, d), EVENT_RULES)
    return checked.where(F.array_contains(failed, name)).select("event_id", F.lit(name).alias("rule"))


def _one_rule(name: str) -> str:
    return f"SELECT event_id, '{name}' AS rule FROM {EVENTS} WHERE {FAILS[name]}"


@query(_one_rule("number|dtype"))
def val_dtype(spark, d):
    return _marked(spark, d, "number|dtype")


@query(_one_rule("number|nullability"))
def val_nullability(spark, d):
    return _marked(spark, d, "number|nullability")


@query(_one_rule("number|min") + " UNION ALL " + _one_rule("number|max"))
def val_range(spark, d):
    return views.union_all([_marked(spark, d, "number|min"), _marked(spark, d, "number|max")])


@query(_one_rule("event_type|enum"))
def val_enum(spark, d):
    return _marked(spark, d, "event_type|enum")


KEY_RULES = TableRules((ColumnRule("l_quantity", "double", min=5, max=45),), ("l_orderkey", "l_linenumber"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1")
def val_primary_key(spark, d):
    checked, failed = validate.check(read(spark, d, "lineitem"), KEY_RULES)
    return checked.where(F.array_contains(failed, validate.KEY_RULE)).select("l_orderkey", "l_linenumber", "l_partkey")


LINES = "SELECT l_orderkey, l_linenumber, l_quantity, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS c FROM lineitem"


@query(f"SELECT l_orderkey, l_linenumber, l_quantity FROM ({LINES}) WHERE c = 1 AND l_quantity BETWEEN 5 AND 45")
def val_good_rows(spark, d):
    return validate.filter_rows(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), KEY_RULES)[0]


@query(f"""SELECT l_orderkey, l_linenumber, l_quantity, array_to_string(list_filter([CASE WHEN l_quantity < 5 THEN 'l_quantity|min' END,
    CASE WHEN l_quantity > 45 THEN 'l_quantity|max' END, CASE WHEN c > 1 THEN '_primary_key_' END], lambda x: x IS NOT NULL), ',') AS failed FROM ({LINES}) WHERE c > 1 OR l_quantity NOT BETWEEN 5 AND 45""")
def val_bad_rows(spark, d):
    bad = validate.filter_rows(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), KEY_RULES)[1]
    return bad.select("l_orderkey", "l_linenumber", "l_quantity", F.array_join("failed_rules", ",").alias("failed"))


@query(" UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) AS n FROM {EVENTS} WHERE {f} HAVING count(*) > 0" for n, f in FAILS.items()))
def val_counts(spark, d):
    return validate.failure_counts(_events(spark, d), EVENT_RULES)


@query("SELECT 'customer' AS table_name, (SELECT count(*) FROM customer) = (SELECT count(DISTINCT c_custkey) FROM customer) AS valid UNION ALL SELECT 'customer balance', (SELECT min(c_acctbal) >= 0 FROM customer)")
def val_is_valid(spark, d):
    customer = read(spark, d, "customer")
    rules = {"customer": TableRules((ColumnRule("c_name", "string", nullable=False),), ("c_custkey",)), "customer balance": TableRules((ColumnRule("c_acctbal", "double", min=0),))}
    return views.union_all([one_row(spark, table_name=n, valid=validate.is_valid(customer, r)) for n, r in rules.items()])


def _collection(spark, d):
    """Some keys of both members are null, and some of the first are there twice, with another balance."""
    key = lambda c, m: F.when(F.col(c) % m != 0, F.col(c)).alias("k")
    first = read(spark, d, "customer").select(key("c_custkey", 9), F.col("c_acctbal").alias("b"))
    first = views.union_all([first, first.where("k % 5 = 0").withColumn("b", F.col("b") - 3000)])
    second = read(spark, d, "supplier").select(key("s_suppkey", 7), F.col("s_acctbal").alias("b"))
    rule = TableRules((ColumnRule("b", "double", min=0),))
    rules = CollectionRules({"first": rule, "second": rule}, ("k",), equal_keys=True, cross=(CrossRule("greater", "first", "second", "left.b > right.b"),))
    return validate.filter_collection({"first": first, "second": second}, rules)


PASSED = """f AS (SELECT CASE WHEN c_custkey % 9 <> 0 THEN c_custkey END AS k, c_acctbal AS b FROM customer),
    r AS (SELECT * FROM f UNION ALL SELECT k, b - 3000 FROM f WHERE k % 5 = 0), a AS (SELECT * FROM r WHERE b >= 0),
    s AS (SELECT * FROM (SELECT CASE WHEN s_suppkey % 7 <> 0 THEN s_suppkey END AS k, s_acctbal AS b FROM supplier) WHERE b >= 0),
    x AS (SELECT DISTINCT k FROM a JOIN s USING (k) WHERE NOT a.b > s.b)"""


@query(f"WITH {PASSED} SELECT k, b FROM a WHERE k IN (SELECT k FROM s) AND k NOT IN (SELECT k FROM x)")
def val_collection_good(spark, d):
    return _collection(spark, d)[0]["first"]


@query(f"""WITH {PASSED} SELECT 'b|min' AS rule, count(*) AS n FROM r WHERE b < 0 UNION ALL
    SELECT 'equal_primary_keys', count(*) FROM a WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.k = a.k) UNION ALL SELECT 'greater', count(*) FROM a WHERE k IN (SELECT k FROM x)""")
def val_collection_counts(spark, d):
    return _collection(spark, d)[2]["first"]


@query(f"WITH {PASSED} SELECT k FROM s WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.k = s.k)")
def val_equal_keys(spark, d):
    return _collection(spark, d)[1]["second"].where(F.array_contains("failed_rules", "equal_primary_keys")).select("k")


@query(f"WITH {PASSED} SELECT k FROM s WHERE k IN (SELECT k FROM x)")
def val_cross_pred(spark, d):
    return _collection(spark, d)[1]["second"].where(F.array_contains("failed_rules", "greater")).select("k")


@query(f"SELECT event_id, CASE WHEN number IS NULL THEN 'number|nullability' ELSE '' END AS failed FROM {EVENTS}")
def val_non_nullable(spark, d):
    events = _events(spark, d)
    checked, failed = validate.check(events, validate.check_nulls(events, TableSpec("events", ("event_id",), nullable=["event_type"])))
    return checked.select("event_id", F.array_join(failed, ",").alias("failed"))


# Versions


def _versions(spark, d) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    orders = read(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = orders.where("o_orderkey % 13 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus")))
    old = orders.where("o_orderkey % 17 <> 0").withColumn("o_clerk", F.when(F.col("o_orderkey") % 23 == 0, F.lit("")))
    nation = read(spark, d, "nation")
    return {"orders": new, "nation": nation, "region": read(spark, d, "region")}, {"orders": old, "nation": nation, "part": read(spark, d, "part")}


@query("SELECT 'region' AS table_name, 'added' AS value, count(*) AS n_rows FROM region UNION ALL SELECT 'part', 'missing', count(*) FROM part")
def cmp_tables(spark, d):
    return compare.diff_tables(spark, *_versions(spark, d))


@query("SELECT 'orders' AS table_name, 'o_clerk' AS column_name, 'missing' AS value, count(*) AS n_values FROM orders WHERE o_orderkey % 17 <> 0 AND o_orderkey % 23 = 0")
def cmp_columns(spark, d):
    return compare.diff_columns(spark, *_versions(spark, d))


@query("SELECT 'orders' AS table_name, false AS equal UNION ALL SELECT 'orders in another order', true")
def cmp_equal(spark, d):
    new, old = _versions(spark, d)
    same = compare.tables_equal(new["orders"].orderBy("o_totalprice"), new["orders"])
    return views.union_all([one_row(spark, table_name="orders", equal=compare.tables_equal(new["orders"], old["orders"].drop("o_clerk"))), one_row(spark, table_name="orders in another order", equal=same)])


@query("""WITH o AS (SELECT CASE WHEN o_orderkey % 29 <> 0 THEN o_orderkey END AS k, * FROM orders),
    n AS (SELECT k, count(*) AS c, list_sort(list(CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END)) AS s, list_sort(list(o_totalprice)) AS p FROM o WHERE o_orderkey % 13 <> 0 GROUP BY k),
    b AS (SELECT k, count(*) AS c, list_sort(list(o_orderstatus)) AS s, list_sort(list(o_totalprice)) AS p, count(*) FILTER (o_orderkey % 23 = 0) AS clerks FROM o WHERE o_orderkey % 17 <> 0 GROUP BY k)
    SELECT coalesce(n.k, b.k) AS k, CASE WHEN b.c IS NULL THEN 'added' WHEN n.c IS NULL THEN 'removed' ELSE 'changed' END AS change,
        CASE WHEN b.c IS NULL OR n.c IS NULL THEN '' ELSE array_to_string(list_filter([CASE WHEN n.s IS DISTINCT FROM b.s THEN 'o_orderstatus' END,
            CASE WHEN n.p IS DISTINCT FROM b.p THEN 'o_totalprice' END, CASE WHEN clerks > 0 OR n.c <> b.c THEN 'o_clerk' END], lambda x: x IS NOT NULL), ',') END AS columns
    FROM n FULL JOIN b ON n.k IS NOT DISTINCT FROM b.k WHERE n.c IS NULL OR b.c IS NULL OR n.s IS DISTINCT FROM b.s OR n.p IS DISTINCT FROM b.p OR clerks > 0""")
def cmp_rows(spark, d):
    """Some keys are null, and so repeated."""
    key = F.when(F.col("o_orderkey") % 29 != 0, F.col("o_orderkey"))
    new, old = (side["orders"].withColumn("k", key).drop("o_orderkey") for side in _versions(spark, d))
    return compare.diff_rows(new, old, ["k"])


@query("""SELECT 'orders' AS table_name, (SELECT count(*) FROM orders WHERE o_orderkey % 13 <> 0) - (SELECT count(*) FROM orders WHERE o_orderkey % 17 <> 0) AS more_rows
    UNION ALL SELECT 'nation', 0""")
def cmp_report(spark, d):
    def more(name: str, new: DataFrame, old: DataFrame) -> DataFrame:
        counts = new.agg(F.count("*").alias("a")).crossJoin(old.agg(F.count("*").alias("b")))  # one row each
        return counts.select(F.lit(name).alias("table_name"), (F.col("a") - F.col("b")).alias("more_rows"))

    return views.union_all([r for r in compare.compare_versions(*_versions(spark, d), more).values() if isinstance(r, DataFrame)])


# Samples


@query("SELECT 'customer' AS table_name, c_custkey AS k FROM (SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 7) UNION ALL SELECT 'orders', o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7)")
def smp_limit(spark, d):
    keys = {"customer": "c_custkey", "orders": "o_orderkey"}
    few = sample.first_rows({t: read(spark, d, t) for t in keys}, {t: [k] for t, k in keys.items()}, 7)
    return views.union_all([few[t].select(F.lit(t).alias("table_name"), F.col(k).alias("k")) for t, k in keys.items()])


SHARE = 0.0371
HASHED = f"substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 15) < '{round(SHARE * 16**15):015x}'"


@query(f"SELECT o_orderkey, o_custkey FROM orders WHERE {HASHED}")
def smp_hash_orders(spark, d):
    return sample.hash_sample(read(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", SHARE)


@query(f"SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE {HASHED})")
def smp_hash_lineitem(spark, d):
    orders = sample.hash_sample(read(spark, d, "orders").select("o_orderkey"), "o_orderkey", SHARE)
    items = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return sample.follow_keys(orders, {"lineitem": (items, "l_orderkey", "o_orderkey")})["lineitem"]


STAR_KEYS = [
    sample.ForeignKey("nation", "n_regionkey", "region", "r_regionkey"), sample.ForeignKey("customer", "c_nationkey", "nation", "n_nationkey"),
    sample.ForeignKey("supplier", "s_nationkey", "nation", "n_nationkey"), sample.ForeignKey("orders", "o_custkey", "customer", "c_custkey"),
    sample.ForeignKey("lineitem", "l_orderkey", "orders", "o_orderkey"), sample.ForeignKey("lineitem", "l_partkey", "part", "p_partkey"),
    sample.ForeignKey("lineitem", "l_suppkey", "supplier", "s_suppkey"),
]
STAR_SQL = f"""o AS (SELECT * FROM orders WHERE {HASHED}), l AS (SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)),
    c AS (SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM o)), p AS (SELECT * FROM part WHERE p_partkey IN (SELECT l_partkey FROM l)),
    s AS (SELECT * FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM l)),
    n AS (SELECT * FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM c UNION SELECT s_nationkey FROM s)), r AS (SELECT * FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM n))"""


def _star(spark, d) -> dict[str, DataFrame]:
    tables = {t: read(spark, d, t) for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}
    return sample.closure(tables, STAR_KEYS, {"orders": sample.hash_filter(F.col("o_orderkey"), SHARE)})


@query(f"WITH {STAR_SQL} " + " UNION ALL ".join(f"SELECT '{t}' AS table_name, {KEYED[t]} AS k, count(*) AS n FROM {t[0]} GROUP BY ALL" for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")))
def smp_closure(spark, d):
    """Sampled orders, their items, and all rows that these refer to."""
    return views.union_all([df.groupBy(F.lit(t).alias("table_name"), F.col(KEYED[t]).cast("long").alias("k")).agg(F.count("*").alias("n")) for t, df in _star(spark, d).items()])


@query(" UNION ALL ".join(f"SELECT '{k.child}.{k.child_key}' AS foreign_key, 0 AS dangling" for k in STAR_KEYS))
def smp_dangling(spark, d):
    """Keys in the sample that refer to no row of it."""
    few = {t: stored(df) for t, df in _star(spark, d).items()}
    none = [joins.missing_keys(few[k.child].select(F.col(k.child_key).alias("k")), few[k.parent].select(F.col(k.parent_key).alias("k")), "k", f"{k.child}.{k.child_key}") for k in STAR_KEYS]
    names = {f"{k.child}.{k.child_key}": df.where("k is not null") for k, df in zip(STAR_KEYS, none, strict=True)}
    return views.union_all([df.agg(F.lit(n).alias("foreign_key"), F.count("*").alias("dangling")) for n, df in names.items()])


@query("SELECT l_orderkey, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 7)")
def smp_ids(spark, d):
    ids = read(spark, d, "part").where("p_size = 7").select(F.col("p_partkey").alias("l_partkey"))
    return sample.by_ids(read(spark, d, "lineitem").select("l_orderkey", "l_partkey"), ids, "l_partkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey >= 3 AND (c_custkey - 3) % 20 = 0")
def smp_step(spark, d):
    return sample.every_kth(read(spark, d, "customer").select("c_custkey"), "c_custkey", 20, 3)


@query("SELECT 'orders' AS table_name, count(*) AS n FROM orders WHERE o_orderdate <= TIMESTAMP '1999-01-01' UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_shipdate <= TIMESTAMP '1999-01-01' UNION ALL SELECT 'nation', count(*) FROM nation")
def smp_stable_date(spark, d):
    copy = sample.stable_date({t: read(spark, d, t) for t in ("orders", "lineitem", "nation")}, DATED, datetime.datetime(1999, 1, 1))
    return views.union_all([df.agg(F.lit(n).alias("table_name"), F.count("*").alias("n")) for n, df in copy.items()])


@query(f"SELECT o_orderkey, o_orderstatus FROM orders WHERE {HASHED}")
def smp_copy(spark, d):
    few = sample.hash_sample(read(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", SHARE)
    return sample.copy_set({"orders": few}, new_path(spark))["orders"]


# Tables by key

CHANGED_STATUS = "CASE WHEN o_orderkey % 997 = 3 THEN 'X' ELSE o_orderstatus END"


def _orders_by_key(spark, d, buckets: int = 64) -> keyed.KeyedTable:
    table = keyed.KeyedTable(spark, new_path(spark), ["o_orderkey"], buckets)
    table.write(read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"))
    return table


def _two_versions(spark, d) -> keyed.KeyedTable:
    """Orders, and orders of which some changed, some went and some are new, written anew as a whole."""
    table = _orders_by_key(spark, d)
    orders = table.read()
    changed = orders.where("o_orderkey % 1009 <> 5").withColumn("o_orderstatus", F.expr(CHANGED_STATUS))
    new = orders.where("o_orderkey % 991 = 7").withColumn("o_orderkey", -F.col("o_orderkey"))
    table.write(views.union_all([changed, new]))
    return table


def bucket_sql(key: str, buckets: int = 64) -> str:
    return f"CAST(('0x' || substr(md5({hash_text(key)}), 1, 8))::BIGINT % {buckets} AS INTEGER)"


def hash_text(*columns: str) -> str:
    """SQL for null_marked()."""
    return " || ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), 'n')" for c in columns)


@query(f"""WITH n AS (SELECT o_orderkey, {CHANGED_STATUS} AS s FROM orders WHERE o_orderkey % 1009 <> 5 UNION ALL SELECT -o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 991 = 7),
    b AS (SELECT coalesce(n.o_orderkey, o.o_orderkey) AS k, n.s AS s, o.o_orderstatus AS t, n.o_orderkey AS a, o.o_orderkey AS c FROM n FULL JOIN orders o ON n.o_orderkey = o.o_orderkey)
    SELECT {bucket_sql("k")} AS bucket, count(a) AS rows_new, count(c) AS rows_old FROM b GROUP BY ALL HAVING bool_or(s IS DISTINCT FROM t)""")
def key_buckets(spark, d):
    """Buckets that differ, from the hashes beside the two versions: no row is read."""
    return _two_versions(spark, d).changed_buckets(2, 1)


@query("""SELECT o_orderkey, 'removed' AS change, '' AS columns FROM orders WHERE o_orderkey % 1009 = 5 UNION ALL SELECT -o_orderkey, 'added', '' FROM orders WHERE o_orderkey % 991 = 7
    UNION ALL SELECT o_orderkey, 'changed', 'o_orderstatus' FROM orders WHERE o_orderkey % 997 = 3 AND o_orderkey % 1009 <> 5""")
def key_diff(spark, d):
    return _two_versions(spark, d).diff(2, 1)


@query("""SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 50 = 0 THEN 'B' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 70 <> 0 OR o_orderkey % 50 = 0
    UNION ALL SELECT -o_orderkey, o_custkey, 'N' FROM orders WHERE o_orderkey % 90 = 0 AND o_orderkey > 0""")
def key_merge(spark, d):
    """After two merges: some rows are changed, some new, some gone, and some of those back."""
    table, orders = _orders_by_key(spark, d), read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    fresh_rows = orders.where("o_orderkey % 90 = 0 AND o_orderkey > 0").select((-F.col("o_orderkey")).alias("o_orderkey"), "o_custkey", F.lit("N").alias("o_orderstatus"))
    table.merge(views.union_all([orders.where("o_orderkey % 50 = 0").withColumn("o_orderstatus", F.lit("A")), fresh_rows]), orders.where("o_orderkey % 70 = 0").select("o_orderkey"))
    table.merge(orders.where("o_orderkey % 50 = 0").withColumn("o_orderstatus", F.lit("B")), orders.where("o_orderkey % 350 = 0").select("o_orderkey"))
    return table.read()


# Incremental rebuild and publication


def hash_sum(*columns: str) -> str:
    return f"sum(('0x' || substr(md5({hash_text(*columns)}), 1, 15))::BIGINT::HUGEINT)"


@query(f"SELECT count(*) AS row_count, CAST({hash_sum('l_orderkey', 'l_linenumber', 'CAST(round(l_extendedprice * 100) AS BIGINT)', 'l_returnflag')} AS VARCHAR) AS content_hash FROM lineitem")
def inc_table_hash(spark, d):
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    return aggregates.table_hash(read(spark, d, "lineitem"), [F.col("l_orderkey"), F.col("l_linenumber"), cents, F.col("l_returnflag")])


HASHED_FILES = {"customer": ("c_custkey", "c_name"), "supplier": ("s_suppkey", "s_name"), "part": ("p_partkey", "p_name")}


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, CAST(sum(strlen({k} || '|' || {v}) + 1) AS BIGINT) AS file_size, sha256(string_agg({k} || '|' || {v} || chr(10), '' ORDER BY {k})) AS sha256 FROM {t}" for t, (k, v) in HASHED_FILES.items()))
def inc_file_hash(spark, d):
    """A text file for each of some tables, its lines in order of the key."""
    root = new_path(spark)
    for t, (k, v) in HASHED_FILES.items():
        lines = read(spark, d, t).orderBy(k).select(F.concat_ws("|", F.col(k).cast("string"), F.col(v)).alias("value"))
        lines.coalesce(1).write.text(f"{root}/{t}")
    hashes = [incremental.file_hashes(spark, f"{root}/{t}", "part-*").select(F.lit(t).alias("table_name"), "file_size", "sha256") for t in HASHED_FILES]
    return views.union_all(hashes)


MODE_STEPS = [
    ("first", incremental.Mode.NORMAL, "F"), ("again", incremental.Mode.NORMAL, "F"), ("fresh, ignored", incremental.Mode.IGNORE_FRESH_INPUT, "O"),
    ("fresh, refused", incremental.Mode.ASSERT_NO_FRESH_INPUT, "O"), ("fresh", incremental.Mode.NORMAL, "O"), ("not fresh, asserted", incremental.Mode.ASSERT_NO_FRESH_INPUT, "O"),
    ("said to be fresh", incremental.Mode.FORCE_FRESH_INPUT, "O"), ("all", incremental.Mode.FORCE_ALL, "O"),
]
MODE_RESULTS = [(True, "F"), (False, "F"), (False, "F"), (False, None), (True, "O"), (False, "O"), (True, "O"), (True, "O")]


@query(" UNION ALL ".join(f"SELECT '{step}' AS step, {computed} AS computed, {f'(SELECT count(*) FROM orders WHERE o_orderstatus = {status!r})' if status else 'CAST(NULL AS BIGINT)'} AS n" for (step, _, _), (computed, status) in zip(MODE_STEPS, MODE_RESULTS, strict=True)))
def inc_modes(spark, d):
    """What each mode does with inputs that are fresh or not; null where it refuses."""
    root, orders, rows = new_path(spark), read(spark, d, "orders").select("o_orderkey", "o_orderstatus"), []
    for step, mode, status in MODE_STEPS:
        build = incremental.Rebuilder(spark, root, mode)
        try:
            n = build.build("counted", lambda orders: orders.agg(F.count("*").alias("n")), {"orders": orders.where(F.col("o_orderstatus") == status)}).first()["n"]
        except RuntimeError:
            n = None
        rows.append((step, bool(build.computed), n))
    return spark.createDataFrame(rows, "step string, computed boolean, n long")


@query("SELECT o_orderstatus, count(*) AS n, 'computed once' AS note FROM orders GROUP BY o_orderstatus")
def inc_rebuild(spark, d):
    build = incremental.Rebuilder(spark, new_path(spark))
    made = None
    for text in ("SELECT o_orderstatus, count(*) FROM orders -- per status", "SELECT o_orderstatus,  count(*)\nFROM orders"):
        made = build.build("per_status", lambda orders: orders.groupBy("o_orderstatus").agg(F.count("*").alias("n")), {"orders": read(spark, d, "orders").select("o_orderkey", "o_orderstatus")}, query_text=text)
    return made.withColumn("note", F.lit("computed once" if len(build.computed) == 1 else f"computed {len(build.computed)} times"))


def _groups(spark, d) -> tuple[publish.Group, dict[str, DataFrame], dict[str, DataFrame]]:
    """A published group, its tables, and new ones of which one changed."""
    first = {"nation": read(spark, d, "nation"), "orders": read(spark, d, "orders").select("o_orderkey", "o_orderstatus")}
    group = publish.Group(spark, new_path(spark))
    group.publish(first)
    return group, first, {**first, "orders": first["orders"].where("o_orderstatus <> 'P'")}


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL")
def pub_publish(spark, d):
    group, _, second = _groups(spark, d)
    group.publish(second, lambda new, old: validate.validate(new["orders"], TableRules((ColumnRule("o_orderstatus", "string", nullable=False, values=("F", "O")),))))
    return group.read()["orders"].groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT 'published' AS version, count(*) AS n FROM orders UNION ALL SELECT 'candidate', count(*) FROM orders WHERE o_orderstatus <> 'P'")
def pub_rejected(spark, d):
    group, _, second = _groups(spark, d)
    try:
        group.publish(second, lambda new, old: validate.validate(new["orders"], TableRules((ColumnRule("o_orderstatus", "string", values=("F",)),))))
    except publish.Rejected:
        pass
    return views.union_all([df.agg(F.lit(n).alias("version"), F.count("*").alias("n")) for n, df in (("published", group.read()["orders"]), ("candidate", group.candidate()["orders"]))])


@query("""SELECT v AS version, count(*) AS n FROM (SELECT unnest(['held', 'published']) AS v), orders WHERE v = 'held' OR o_orderstatus <> 'P' GROUP BY v UNION ALL
    SELECT 'refused', count(*) FROM orders WHERE o_orderstatus = 'F'""")
def pub_mended(spark, d):
    """A rejected candidate is mended and published while a reader holds the version before, and another publisher is late."""
    group, _, second = _groups(spark, d)
    late = publish.Group(spark, group.root)
    rows = []

    def audit(new, old):
        if new["orders"].where("o_orderstatus = 'Q'").count():
            raise ValueError("a status of its own")

    with group.hold() as held:
        try:
            group.publish({**second, "orders": views.union_all([second["orders"], second["orders"].withColumn("o_orderstatus", F.lit("Q"))])}, audit)
        except publish.Rejected:
            mended = {n: df.where("o_orderstatus <> 'Q'") if n == "orders" else df for n, df in group.candidate().items()}
            try:
                late.publish({"orders": second["orders"].where("o_orderstatus = 'F'")}, lambda new, old: group.publish(mended, audit))
            except publish.Conflict:
                rows.append(("refused", late.candidate()["orders"].where("o_orderstatus = 'F'").count()))
        rows += [("held", held["orders"].count()), ("published", group.read()["orders"].count())]
    return spark.createDataFrame(rows, "version string, n long")


@query("SELECT 'unchanged' AS run, false AS flipped, (SELECT count(*) FROM nation) AS n UNION ALL SELECT 'partly changed', true, (SELECT count(*) FROM orders WHERE o_orderstatus <> 'P')")
def pub_partial(spark, d):
    group, first, second = _groups(spark, d)
    rows = [one_row(spark, run="unchanged", flipped=group.publish(first), n=group.read()["nation"].count())]
    rows.append(one_row(spark, run="partly changed", flipped=group.publish(second), n=group.read()["orders"].count()))
    return views.union_all([r.withColumn("n", F.col("n").cast("long")) for r in rows])


@query(f"""SELECT md5(string_agg(t || '=' || h, chr(10) ORDER BY t)) AS version FROM (SELECT 'customer' AS t, count(*) || ':' || {hash_sum("c_custkey", "c_name")} AS h FROM customer
    UNION ALL SELECT 'nation', count(*) || ':' || {hash_sum("n_nationkey", "n_name")} FROM nation)""")
def pub_group_hash(spark, d):
    group = publish.Group(spark, new_path(spark))
    group.publish({"customer": read(spark, d, "customer").select("c_custkey", "c_name"), "nation": read(spark, d, "nation").select("n_nationkey", "n_name")})
    return one_row(spark, version=group.version())


@query("""WITH s AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT a.n AS n, count(*) AS customers, (SELECT max(n) FROM s) AS most FROM s a GROUP BY a.n""")
def pub_subquery(spark, d):
    per = publish.materialize(read(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")))
    most = per.agg(F.max("n").alias("most"))
    return per.groupBy("n").agg(F.count("*").alias("customers")).crossJoin(F.broadcast(most))  # one row


# SQL text, functions, models


@query("SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY ALL")
def sql_text(spark, d):
    return sqltext.select(spark, "SELECT c_mktsegment, count(*) AS n FROM {customer} WHERE c_acctbal > 0 GROUP BY c_mktsegment", customer=read(spark, d, "customer"))


@query(f"SELECT user_id, 'no open interval' AS reason FROM {INTERVALS} WHERE end_date < DATE '9999-01-01' AND user_id % 2 = 0")
def sql_script(spark, d):
    _intervals(spark, d).createOrReplaceTempView("raw_intervals")
    script = """
        -- entities; of even number
        CREATE OR REPLACE TEMPORARY VIEW even_entities AS SELECT * FROM {{source}} WHERE user_id % 2 = 0;
        CREATE OR REPLACE TEMPORARY VIEW entity_checks AS
            SELECT user_id, 'no open interval' AS reason FROM even_entities GROUP BY user_id HAVING max(end_date) < DATE '9999-01-01';
    """
    return sqltext.run_script(spark, script, source="raw_intervals")["entity_checks"]


@query("""SELECT 'checks' AS name, 'made view' AS fate, count(*) AS n FROM customer WHERE c_acctbal < 0 UNION ALL
    SELECT 'balances', 'made table', count(*) FROM customer UNION ALL SELECT 'big_orders', 'made table', count(*) + 1 FROM orders WHERE o_totalprice > 100000
    UNION ALL SELECT 'segments', 'replaced table', count(DISTINCT c_mktsegment) FROM customer UNION ALL SELECT 'history', 'changed table', 2 * count(*) FROM region
    UNION ALL SELECT 'obsolete', 'dropped table', 0""")
def sql_script_tables(spark, d):
    """Tables, views and functions that a script makes, replaces, changes and drops in a database of its own."""
    db = f"script_{uuid.uuid4().hex[:12]}"
    for name in ("customer", "orders", "region"):
        read(spark, d, name).createOrReplaceTempView(f"{db}_{name}")
    spark.sql(f"CREATE DATABASE {db} LOCATION '{new_path(spark)}'")
    for name in ("segments", "history", "obsolete"):
        spark.sql(f"CREATE TABLE {db}.{name} USING parquet AS SELECT r_name AS value FROM {db}_region")
    script = """
        /* Tables are handed on; -- names may be quoted. */
        CREATE OR REPLACE TEMPORARY FUNCTION {{db}}_twice(x DOUBLE) RETURNS DOUBLE RETURN 2 * x;
        USE {{db}};
        CREATE TABLE balances USING parquet AS SELECT c_custkey, {{db}}_twice(c_acctbal) AS twice FROM {{db}}_customer;
        CREATE TABLE {{db}}.`big_orders` USING parquet AS SELECT o_orderkey FROM {{db}}_orders WHERE o_totalprice > 100000;
        INSERT INTO {{db}}.`big_orders` VALUES (-1);  -- a mark; not an order
        CREATE TABLE passing USING parquet AS SELECT 1 AS x; DROP TABLE passing;
        DROP TABLE IF EXISTS segments;
        CREATE TABLE segments USING parquet AS SELECT DISTINCT c_mktsegment AS value FROM {{db}}_customer;
        WITH again AS (SELECT r_name FROM {{db}}_region) INSERT INTO history SELECT r_name FROM again;
        CREATE VIEW checks AS SELECT c_custkey FROM balances WHERE twice < 0;
        DROP TABLE obsolete;
    """
    ran = sqltext.execute_script(spark, script, db=db)
    fates = {n: f"{fate} {kind}" for fate in ("made", "replaced", "changed", "dropped") for n, kind in getattr(ran, fate).items() if kind != "function"}
    none = spark.range(0)
    return views.union_all([ran.tables.get(n, none).agg(F.lit(n.removeprefix(f"{db}.")).alias("name"), F.lit(fate).alias("fate"), F.count("*").alias("n")) for n, fate in fates.items()])


@query("SELECT l_orderkey, l_linenumber, l_partkey + l_suppkey AS total FROM lineitem")
def udf_sql_scalar(spark, d):
    sqltext.scalar_function(spark, "tablemill_add", "x BIGINT, y BIGINT", "BIGINT", "x + y")
    return sqltext.select(spark, "SELECT l_orderkey, l_linenumber, tablemill_add(l_partkey, l_suppkey) AS total FROM {items}", items=read(spark, d, "lineitem"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 42")
def udf_param_query(spark, d):
    return sqltext.select(spark, "SELECT o_orderkey, o_custkey FROM {orders} WHERE o_custkey = :id", {"id": 42}, orders=read(spark, d, "orders"))


def _doubled(batch):
    batch["s_acctbal"] = batch["s_acctbal"] * 2
    return batch


@query("SELECT s_suppkey, s_acctbal * 2 AS s_acctbal FROM supplier")
def udf_map_pandas(spark, d):
    return frames.map_pandas(read(spark, d, "supplier").select("s_suppkey", "s_acctbal"), _doubled)


@query("SELECT r_regionkey, r_name, 'stored' AS origin, upper(r_name) AS r_upper FROM region")
def udf_transform(spark, d):
    hooks = frames.Hooks(on_read=lambda df: df.withColumn("r_upper", F.upper("r_name")), on_write=lambda df: df.withColumn("origin", F.lit("stored")))
    hooks.write(read(spark, d, "region"), path := new_path(spark))
    return hooks.read(spark, path)


@query("""SELECT part, target, count(*) AS n, true AS fits FROM (SELECT CASE WHEN row_number() OVER (ORDER BY c_custkey) % 10 = 0 THEN 'test' ELSE 'train' END AS part,
    CASE WHEN c_acctbal > 5000 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS target FROM customer) GROUP BY ALL""")
def ml_train_eval(spark, d):
    """Rows scored of each part and target. fits: on the training rows the model errs no more often than the better constant."""
    train, test, _ = features.train_and_test(read(spark, d, "customer"), read(spark, d, "orders"))
    fitted = model.train_classifier(train, ["n_orders", "spent", "n_urgent"], "target")
    scored = views.union_all([model.evaluate(df, fitted, "target").withColumn("part", F.lit(n)) for n, df in (("train", train), ("test", test))])
    per = stored(scored.groupBy("part", "target").agg(F.count("*").alias("n"), F.sum("abs_error").alias("wrong")))
    fit = per.where("part = 'train'").agg((F.sum("wrong") <= F.min("n")).alias("fits"))
    return per.select("part", "target", "n").crossJoin(F.broadcast(fit))  # one row


@query("SELECT c_acctbal AS target, round(0.5 * c_nationkey + 100, 2) AS prediction, round(abs(c_acctbal - round(0.5 * c_nationkey + 100, 2)), 2) AS abs_error FROM customer")
def ml_eval(spark, d):
    out = model.errors(read(spark, d, "customer"), "c_acctbal", r2(0.5 * F.col("c_nationkey") + 100))
    return out.withColumn("abs_error", r2(F.col("abs_error")))


FEATURE_SQL = """SELECT c_custkey, c_mktsegment, coalesce(n_orders, 0) AS n_orders, coalesce(spent, 0.0) AS spent, coalesce(n_urgent, 0) AS n_urgent, CASE WHEN c_acctbal > 5000 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS target
    FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, round(sum(o_totalprice), 2) AS spent FROM orders GROUP BY ALL) a ON c_custkey = a.o_custkey
    LEFT JOIN (SELECT o_custkey, count(*) AS n_urgent FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY ALL) b ON c_custkey = b.o_custkey"""


@query(FEATURE_SQL)
def flow_features(spark, d):
    return features.feature_tables(read(spark, d, "customer"), read(spark, d, "orders"))


@query("SELECT c_custkey, trim(c_name) AS c_name, c_mktsegment, coalesce(n_orders, 0) AS n_orders, coalesce(spent, 0.0) AS spent FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, round(sum(o_totalprice), 2) AS spent FROM orders GROUP BY ALL) a ON c_custkey = a.o_custkey")
def flow_customer_orders(spark, d):
    return store.write_table(features.customer_orders(read(spark, d, "customer"), read(spark, d, "orders")), new_path(spark), "customer_orders")


# Streaming ingest


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def stream_ingest(spark, d):
    events = read(spark, d, "events")
    root = new_path(spark)
    for _ in range(2):  # the second run finds nothing new
        ingest.append_new_files(spark, d, events.schema, f"{root}/events", f"{root}/checkpoint", "events.parquet")
    return spark.read.parquet(f"{root}/events").groupBy("event_type").agg(F.count("*").alias("n"), r2(F.sum("value")).alias("total"))
