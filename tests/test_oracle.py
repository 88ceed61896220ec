import oracle
import pytest

import __spark_entry__ as entry

QUERIES, ORACLE_SQL = entry.QUERIES, entry.ORACLE_SQL


@pytest.fixture(scope="module")
def con(sf):
    return oracle.database(sf)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(name, spark, sf, con):
    assert oracle.differences(QUERIES[name], ORACLE_SQL[name], spark, sf, con) == ""


def test_every_retrieval_query_is_registered():
    assert QUERIES.keys() == ORACLE_SQL.keys() and QUERIES.keys() <= entry.queries().keys()


def test_entry(spark):
    assert entry.entry(spark).count() == 10
