"""Every registered query against its checking SQL on the smallest data set."""

import pytest

import __spark_entry__ as entry_module
from tests.compare import compare, duck
from weirspan.plans import registry

SF = "0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, con, name):
    problem = compare(spark, con, name, SF)
    assert problem in ("", "both sides empty"), problem


def test_entry_returns_rows(spark):
    df = entry_module.entry(spark)
    assert df.columns[0] == "incident_id" and df.limit(1).count() == 1


def test_every_check_belongs_to_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
