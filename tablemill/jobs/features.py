"""From raw tables to a train and a test set: clean, transform, check, features, split. Keys stay the same throughout,
so each join finds its sides by the same column; the result is what train_classifier() takes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.operators.aggregates import completeness
from tablemill.operators.joins import combine_features, left_join_pk
from tablemill.operators.transform import transmute, trim_all_strings
from tablemill.operators.validate import validate
from tablemill.operators.windows import split_by_row_number
from tablemill.specs import ColumnRule, TableRules


def customer_orders(customer: DataFrame, orders: DataFrame) -> DataFrame:
    """Each customer with the number and value of their orders."""
    per = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"), F.sum("o_totalprice").alias("spent"))
    joined = left_join_pk(trim_all_strings(customer), per, "c_custkey")
    return transmute(
        joined, c_custkey=F.col("c_custkey"), c_name=F.col("c_name"), c_mktsegment=F.col("c_mktsegment"),
        n_orders=F.coalesce("n_orders", F.lit(0)), spent=F.round(F.coalesce("spent", F.lit(0.0)), 2),
    )


FEATURE_RULES = TableRules(
    (ColumnRule("c_custkey", "bigint", nullable=False), ColumnRule("n_orders", "bigint", nullable=False, min=0), ColumnRule("spent", "double", min=0)), ("c_custkey",)
)


def feature_tables(customer: DataFrame, orders: DataFrame) -> DataFrame:
    """One validated row of features and target (does the customer's balance exceed 5000?) per customer."""
    base = customer_orders(customer, orders)
    urgent = orders.where(F.col("o_orderpriority") == "1-URGENT").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_urgent"))
    target = customer.select("c_custkey", (F.col("c_acctbal") > 5000).cast("double").alias("target"))
    return validate(combine_features([base.drop("c_name"), urgent, target], "c_custkey").fillna(0, ["n_urgent"]), FEATURE_RULES)


def train_and_test(customer: DataFrame, orders: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(train, test, completeness row)."""
    features = feature_tables(customer, orders)
    train, test = split_by_row_number(features, ["c_custkey"])
    return train, test, completeness({"customer": customer, "orders": orders}, {"promotions": None})
