"""Every registered query against its SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")


@pytest.fixture(scope="module")
def connection():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, connection, name):
    problem, _ = compare(spark, connection, name, entry.queries()[name], entry.oracle_sql().get(name), SF)
    assert problem is None


def test_entry(spark):
    row = entry.entry(spark).first()
    assert row["message"].startswith("CSV quality ") and row["rows"] > 0


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
