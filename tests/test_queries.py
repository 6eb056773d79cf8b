"""Every registered query on the smallest tables, against its oracle where it has one."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, oracle_connection

# The corpus queries have tests of their own.
OWN = set(entry.queries()) - set(entry.CORPUS_QUERIES)
WITH_ORACLE = sorted(set(entry.oracle_sql()) & OWN)
ROWS_ONLY = sorted(OWN - set(WITH_ORACLE))


@pytest.fixture(scope="module")
def con(small):
    return oracle_connection(small)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", WITH_ORACLE)
def test_same_as_oracle(spark, small, con, name):
    assert compare(spark, con, small, name) == ""


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_has_rows(spark, small, name):
    assert entry.queries()[name](spark, small).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
