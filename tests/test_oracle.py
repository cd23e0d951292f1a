"""Every registered query next to its SQL on the driver tables."""

import pytest

import __spark_entry__ as entry
import compare
from gearledger import catalog, oracle


@pytest.fixture(scope="module")
def con(folder):
    return compare.connect(folder)


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(oracle.oracle_sql())
    assert set(catalog.queries()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query_equals_sql(spark, con, folder, name):
    answer = compare.compare(spark, con, folder, name)
    assert answer in ("", "EMPTY on both sides"), answer


def test_entry_has_rows_and_stable_schema(spark):
    first, second = entry.entry(spark), entry.entry(spark)
    assert first.schema == second.schema
    assert first.limit(1).count() == 1
