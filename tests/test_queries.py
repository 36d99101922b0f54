"""Every registered query against DuckDB on the same tables."""

import pytest

from tablemill.queries import ORACLE_SQL, QUERIES
from tests.conftest import same_rows


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, small, duck, name):
    same_rows(QUERIES[name](spark, small), duck.execute(ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_rows_only(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark, small):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
