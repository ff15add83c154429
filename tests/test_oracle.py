"""Every registered query against its SQL, on the smallest tables."""

import pytest

from checks.compare import connect, differences
from checks.oracle import ORACLE
from checks.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, connection, name):
    ours = QUERIES[name](spark, SF).toPandas()
    assert len(ours) > 0
    if name in ORACLE:
        assert differences(ours, connection.execute(ORACLE[name]).df()) == []


def test_sql_belongs_to_queries():
    assert set(ORACLE) <= set(QUERIES)
