"""Every registered query against its DuckDB oracle."""

import pytest
from oracle import compare, connect

from sheetlake.plans import all_oracles, all_queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("key", list(all_queries()))
def test_query_matches_oracle(spark, duck, key):
    assert key in all_oracles()
    assert compare(spark, duck, all_queries()[key], all_oracles()[key], FOLDER) is None


def test_entry_has_rows(spark):
    import __spark_entry__ as contract

    result = contract.entry(spark)
    assert result.columns == ["segment", "orders", "spend"]
    assert result.count() == 5
    assert set(contract.oracle_sql()) <= set(contract.queries())
