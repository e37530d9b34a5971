"""Every driver query against its SQL text in DuckDB, over whole tables."""

import re

import pytest

import __spark_entry__ as entry
from conftest import TESTDATA
from oracle_check import differences, duck

NO_SQL = {
    "model_report", "pca_components", "model_grid_linear", "best_model_linear", "forest_grid", "boosting_grid", "best_model",
    "forest_fit", "boosting_fit",
}
# The training-data operators have their own tests, in a folder that can be left out.
SQL = {name: sql for name, sql in entry.oracle_sql().items() if not re.match(r"op\d+_|pipeline$", name)}
QUERIES = {name for name in entry.queries() if not re.match(r"op\d+_|pipeline$", name)}


@pytest.fixture(scope="module")
def connection():
    return duck(TESTDATA)


def test_every_query_has_sql_but_the_model_fits():
    assert QUERIES - set(SQL) == NO_SQL
    assert set(SQL) <= QUERIES


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, connection, name):
    assert differences(entry.queries()[name](spark, TESTDATA), connection, SQL[name]) == []


def test_entry(spark):
    result = entry.entry(spark)
    assert result.columns[:2] == ["hotel_id", "segment"] and result.count() > 0
