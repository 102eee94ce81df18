"""Every query with a SQL twin equals it; the others give rows."""

import pytest

import __spark_entry__
from fragmill import catalog
from tests.helpers import duck, rows_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    if name in catalog.ORACLE:
        assert rows_of(df.toPandas()) == rows_of(con.execute(catalog.ORACLE[name]).df())
    else:
        assert df.count() > 0


def test_entry_points(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
