"""The registered queries next to their SQL on the driver tables."""

import pytest

import __spark_entry__ as entry
import compare
from gearledger.llm import queries


@pytest.fixture(scope="module")
def con(folder):
    return compare.connect(folder)


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query_equals_sql(spark, con, folder, name):
    assert compare.compare(spark, con, folder, name) == ""


def test_every_operator_is_registered():
    numbers = {int(name[2:].split("_")[0]) for name in queries.queries()}
    assert numbers == set(range(1, 14))
    assert set(queries.queries()) | {"pipeline"} <= set(entry.queries())
