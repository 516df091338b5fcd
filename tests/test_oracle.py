"""Every registered query with SQL gives the same rows in DuckDB."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from compare import database, spark_rows, sql_rows  # noqa: E402

from refillspark.plans import catalogue  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    return database(SF)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, tables, name):
    columns, rows = spark_rows(catalogue.queries()[name](spark, SF))
    names, expected = sql_rows(tables, catalogue.oracle_sql()[name])
    assert columns == names
    assert rows == expected
    assert rows


def test_flagship_and_contract(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
