from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from lodgelens.schema import clean_schema  # noqa: E402
from lodgelens.session import local_session  # noqa: E402
from lodgelens.tables import HotelTables  # noqa: E402

TESTDATA = os.environ.get("TESTDATA_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_table(spark):
    """Rows given as dicts → one of the eleven tables; ``hotel_id`` defaults to 1, other columns to NULL."""

    def make(name, rows):
        schema = clean_schema(name)
        data = [tuple({"hotel_id": 1, **row}.get(f.name) for f in schema) for row in rows]
        return spark.createDataFrame(data, schema)

    return make


@pytest.fixture(scope="session")
def make_tables(make_table):
    def make(**tables):
        return HotelTables.of({name: make_table(name, rows) for name, rows in tables.items()})

    return make
