"""Every registered query of the library against DuckDB on the same files."""

import pytest
from compare import database, differences

import __spark_entry__
from plumbline.catalog import ORACLE, QUERIES



@pytest.fixture(scope="module")
def connection(folder):
    return database(folder)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, folder, connection, name):
    result = QUERIES[name](spark, folder)
    assert differences(result, connection, ORACLE[name]) == []


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 5
