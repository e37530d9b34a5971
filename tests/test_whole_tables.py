"""Queries that must cover every order, customer and day, on rows of their own."""

from datetime import datetime, timedelta

import pytest

import __spark_entry__ as entry
from oracle_check import differences

N = 360  # orders, one a day per property for 120 days, each by a visitor of its own
FIRST = datetime(1995, 1, 1)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Blocks of a hundred orders belong to properties 1, 2 and 3; every order is a booking with one room."""
    place = tmp_path_factory.mktemp("whole")
    keys = [(block * 100 + i) for block in range(6) for i in range(60)]
    tables = {
        "customer": ("c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
                     [(2 * k, f"c{k}", k % 25, 0.0, "BUILDING") for k in keys]),
        "orders": ("o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
                   [(k, 2 * k, "F", 1000.0 + k, FIRST + timedelta(days=k % 100 + 60 * (k // 300)), f"{k % 5 + 1}-X") for k in keys]),
        "lineitem": ("l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string",
                     [(k, k, 1, 20.0, 100.0, "N") for k in keys]),
        "events": ("event_id long, ts timestamp_ntz, user_id long, event_type string",
                   [(k, FIRST, k, "view") for k in range(3)]),
    }
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{place}/{name}.parquet")
    return str(place)


@pytest.fixture(scope="module")
def rows_of(spark, folder):
    def run(name):
        import duckdb

        query = entry.queries()[name](spark, folder)
        connection = duckdb.connect()
        for table in ("customer", "orders", "lineitem", "events"):
            connection.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
        assert differences(query, connection, entry.oracle_sql()[name]) == []
        return [r.asDict() for r in query.collect()]

    return run


def test_campaigns_count_every_booking(rows_of):
    found = rows_of("campaign_by_segment")
    assert sum(r["bookings"] for r in found) == N
    assert "(not set)" not in {r["utm_campaign"] for r in found}


def test_rooms_by_source_count_every_paid_booking(rows_of):
    keys = [(block * 100 + i, block % 3 + 1) for block in range(6) for i in range(60)]
    paid = sum((2 * key + hotel) % 4 != 0 for key, hotel in keys)  # the others came by an organic search
    assert sum(r["room_rows"] for r in rows_of("room_choice_by_source")) == paid


def test_spend_of_every_day(rows_of):
    found = rows_of("ppc_daily_spend")
    assert len(found) == 3 * N and len({r["date"] for r in found}) == 120


def test_visits_of_every_booker(rows_of):
    keys = [(block * 100 + i, block % 3 + 1) for block in range(6) for i in range(60)]
    bookers = {(hotel, f"u{2 * key}") for key, hotel in keys}
    found = rows_of("visits_before_booking")
    assert {(r["hotel_id"], r["uuid"]) for r in found} == bookers and len(found) == N


def test_daily_figures_of_every_day(rows_of):
    found = [r for r in rows_of("daily_metrics") if r["bookings"]]
    assert sum(r["bookings"] for r in found) == N
    assert sum(r["occupancy_rate"] == 100 for r in found) == N


def test_metrics_over_every_day_with_a_prediction(rows_of):
    assert {r["hotel_id"]: r["n"] for r in rows_of("model_metrics")} == dict.fromkeys((1, 2, 3), 120 - 7)
