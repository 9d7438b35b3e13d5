"""Every query with SQL gives the SQL's rows; the entry gives rows."""

import pytest

from ledgerloom.plans.registry import QUERIES, SQL
from tests.compare import same


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, sf_dir, name):
    same(QUERIES[name](spark, sf_dir), SQL[name], sf_dir)


def test_all_queries_have_sql():
    assert set(SQL) <= set(QUERIES) and len(QUERIES) - len(SQL) <= 3


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
