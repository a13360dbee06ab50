"""Every registered query against its SQL counterpart on the smallest data."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_queries import compare, connect
from conftest import DATA


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, folder, name):
    status, rows, _, detail = compare(spark, con, folder, name, queries()[name], oracle_sql().get(name))
    assert status in ("ok", "rows"), detail
    assert rows > 0


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    df = entry(spark)
    assert df.columns[:3] == ["workload_id", "benchmark", "query_id"]
    assert df.where("ratio < 1").count() == 0
