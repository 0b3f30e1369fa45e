"""Every query with SQL gives the SQL's rows; every other one runs and gives rows."""

import pytest
from compare import differ, oracle

from marginalia import plans

DIR = "/root/testdata/sf0.001"
QUERIES, SQL = plans.collected()


@pytest.fixture(scope="module")
def con():
    return oracle(DIR)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, con, name):
    assert differ(QUERIES[name](spark, DIR), con, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
