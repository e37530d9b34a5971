"""The sample views hold the cases that analyses must cope with, already at the smallest scale."""

import pytest
from pyspark.sql import functions as F

from conftest import TESTDATA
from lodgelens.plans import daily
from lodgelens.schema import CURRENCIES
from lodgelens.sources.sample_views import load_views


@pytest.fixture(scope="module")
def t(spark):
    return load_views(spark, TESTDATA)


def some(df):
    return df.limit(1).count() == 1


def test_misses_on_both_sides_of_every_join(t):
    session = t.search_log_session.withColumnRenamed("id", "search_log_session_id")
    search = t.search_log.withColumnRenamed("id", "search_log_id")
    key = ["hotel_id", "search_log_id"]
    assert some(t.search_log.join(session, ["hotel_id", "search_log_session_id"], "left_anti"))
    for other in (t.booking_data, t.search_log_room, t.upsell_data):
        assert some(other.join(search, key, "left_anti"))
    assert some(search.where("conversion = 1").join(t.booking_data, key, "left_anti"))
    assert some(t.booking_data.groupBy(*key).count().where("count > 1"))


def test_missing_values_pairs_and_currencies(t):
    assert some(t.search_log_session.where("uuid IS NULL"))
    assert some(t.search_log.where(~F.col("currency").isin(*CURRENCIES)))
    pairs = {r[0] for r in t.datepicker_daily_visitors.select("utm_source_and_medium").distinct().collect()}
    assert {"direct", "0"} <= pairs
    assert some(t.datepicker_daily_visitors.where("utm_source = 'unknown' AND utm_medium = 'unknown'"))


def test_days_without_users_spend_or_occupancy(t):
    days = daily.daily_series(t)
    assert some(days.where("user_count = 0")) and some(days.where("total_ppc_spend IS NULL")) and some(days.where("fill_rate IS NULL"))
    assert some(daily.daily_features(t).where("user_count = 0 AND ppc_per_user IS NOT NULL"))


def test_products_unsold_in_a_currency_and_equal_revenues(t):
    sold = t.upsell_data.join(t.search_log.select("hotel_id", F.col("id").alias("search_log_id"), "currency"), ["hotel_id", "search_log_id"])
    revenue = sold.groupBy("hotel_id", "currency", "name").agg(F.sum("sum_price").alias("revenue"))
    assert not some(revenue.where("currency = 'HUF' AND name = 'Brand#9'")) and some(revenue.where("currency = 'EUR' AND name = 'Brand#9'"))
    cells = revenue.groupBy("hotel_id", "currency").agg(F.count_if(F.col("revenue") == 0).alias("zero"), F.count(F.lit(1)).alias("n"))
    assert all(3 * r["zero"] > r["n"] for r in cells.where(F.col("currency").isin(*CURRENCIES)).collect())  # the first two edges merge


def test_repeated_rows(t):
    assert some(t.booking_data.groupBy(*t.booking_data.columns).count().where("count > 1"))


def test_files_are_opened_once_per_session(spark, monkeypatch):
    from lodgelens.sources import sample_views

    first = sample_views._opened_file(spark, f"{TESTDATA}/orders.parquet")
    assert sample_views._opened_file(spark, f"{TESTDATA}/orders.parquet") is first
    assert sample_views._opened_file(spark.newSession(), f"{TESTDATA}/orders.parquet") is not first
