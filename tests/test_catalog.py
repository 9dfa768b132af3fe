"""Every registered trend query against its SQL oracle on the smallest tables."""

import pytest

from tests.oracle import assert_same, views
from tidemark.plans import catalog


@pytest.fixture(scope="module")
def con(small):
    return views(small)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, small, con, name):
    got = catalog.QUERIES[name](spark, small).toPandas()
    if name in catalog.ORACLE_SQL:
        assert_same(got, con.execute(catalog.ORACLE_SQL[name]).df())
    else:
        assert len(got)


def test_entry(spark):
    import __spark_entry__

    assert 0 < __spark_entry__.entry(spark).count() <= 20
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
