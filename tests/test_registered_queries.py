"""Every registered query against its SQL, over whole tables."""

import pytest

import __spark_entry__ as driver
from tests.oracle import compare, connect

QUERIES, SQL = driver.queries(), driver.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    if name in SQL:
        assert compare(df, con, SQL[name]) is None
    else:
        assert df.count() > 0


def test_entry_has_one_row_per_constraint(spark):
    df = driver.entry(spark)
    assert df.columns == ["table_name", "kind", "constraint_name", "checked", "violations"]
    assert df.count() > 40
