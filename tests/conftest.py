import os
import sys
from pathlib import Path

import pytest

REPO = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, REPO)
os.environ["PYTHONPATH"] = REPO + os.pathsep + os.environ.get("PYTHONPATH", "")  # for Python workers


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    root = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", f"{root}/checkpoint").config("spark.sql.warehouse.dir", f"{root}/warehouse").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small():
    if not os.path.isdir(SMALL):
        pytest.skip("no test tables")
    return SMALL


@pytest.fixture(scope="session")
def duck(small):
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in os.listdir(small):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{small}/{name}'")
    return con


def _plain(v):
    import pandas as pd

    if pd.isna(v):
        return None
    if isinstance(v, float):
        return str(int(v)) if v == int(v) else str(round(v, 6))
    return str(v)


def same_rows(spark_df, duck_df) -> None:
    """Equal column names, and equal rows in any order."""
    a = spark_df.toPandas()
    assert sorted(a.columns) == sorted(duck_df.columns)
    columns = sorted(a.columns)
    rows = [sorted(([_plain(v) for v in r] for r in df[columns].astype(object).itertuples(index=False)), key=str) for df in (a, duck_df)]
    assert len(rows[0]) == len(rows[1])
    for x, y in zip(*rows, strict=True):
        assert x == y
