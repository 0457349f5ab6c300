"""Every registered query against its DuckDB oracle (sf0.001, all queries;
the driver repeats this at sf0.01)."""
import pytest

import __spark_entry__ as E
from qamill.plans.catalog import QUERIES
from qamill.plans.oracle import ORACLE
from tests.conftest import SF_SMALL
from tools.oracle_check import compare

NAMES = sorted(QUERIES)


def test_every_query_has_an_oracle():
    assert set(ORACLE) == set(QUERIES) <= set(E.queries())
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.fixture(scope="module")
def results(spark):
    return compare(spark, SF_SMALL, NAMES, verbose=False)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(results, name):
    assert results[name] == "OK", results[name]


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "accuracy" in df.columns
