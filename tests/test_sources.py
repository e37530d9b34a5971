"""Rows that must not get lost on the way in and out."""

import pytest

from lodgelens.plans import ppc
from lodgelens.schema import TABLE_NAMES
from lodgelens.session import shared_folder
from lodgelens.sources import raw_csv, store
from lodgelens.sources.sample_views import load_views

from conftest import TESTDATA


def test_surplus_fields_are_an_error_and_short_lines_are_filled(spark, tmp_path):
    (tmp_path / "good.csv").write_text("a;b\n1;x\n2\n")
    (tmp_path / "bad.csv").write_text("a;b\n1;x\n2;y;LOST\n")
    rows = raw_csv.scan_csv(spark, str(tmp_path / "good.csv")).collect()
    assert [tuple(r) for r in rows] == [("1", "x"), ("2", None)]
    with pytest.raises(Exception, match="more fields than the header"):
        raw_csv.scan_csv(spark, str(tmp_path / "bad.csv")).select("a").collect()


def test_writing_one_property_keeps_the_others(make_tables, spark, tmp_path):
    for hotel in (1, 2):
        store.write_store(make_tables(**{name: [{"hotel_id": hotel}] for name in TABLE_NAMES}), str(tmp_path))
    kept = store.read_store(spark, str(tmp_path)).search_log.select("hotel_id").collect()
    assert sorted(r[0] for r in kept) == [1, 2]


def test_missing_pairs_stay_unknown(make_tables):
    visit = {"utm_source_and_medium": "0", "utm_source": "unknown", "utm_medium": "unknown", "user_count": 1, "session_count": 1}
    split = ppc.utm_split(make_tables(datepicker_daily_visitors=[visit])).first()
    assert (split["utm_source"], split["utm_medium"]) == ("unknown", "unknown")


def test_views_belong_to_the_session_that_asks(spark):
    assert load_views(spark.newSession(), TESTDATA).search_log.count() == load_views(spark, TESTDATA).search_log.count()


def test_local_sessions_share_one_folder(spark):
    assert shared_folder(spark) == shared_folder(spark)
