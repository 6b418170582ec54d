"""Every query that has SQL gives the same rows and types as that SQL."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import differences, duck, duck_rows, spark_rows

ORACLES, QUERIES = oracle_sql(), queries()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, sf, con, name):
    assert differences(spark_rows(QUERIES[name](spark, sf)), duck_rows(con, ORACLES[name])) is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_gives_the_known_days(spark):
    status = [r["status"] for r in entry(spark).collect()]
    assert (status.count("equal"), status.count("differ")) == (45, 5)
