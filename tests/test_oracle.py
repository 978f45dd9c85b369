"""Every registered query against its SQL on the smallest tables, whole results compared."""

from pathlib import Path

import pytest
from compare import database, differences

import __spark_entry__

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    return database(SF_DIR)


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_query_equals_sql(spark, tables, name):
    df = __spark_entry__.queries()[name](spark, SF_DIR)
    assert differences(df, tables, __spark_entry__.oracle_sql()[name]) is None


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["prediction", "total_bugs", "reopened_bugs", "reopening_rate"]
    assert df.count() > 0
