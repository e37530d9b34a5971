"""Exports of many properties: scans by kind of file, lines set aside with their reason, the same rows as one by one."""

import re

import pytest

from lodgelens.schema import TABLE_NAMES, TABLES
from lodgelens.sources import many_csv, raw_csv

from test_loader import write_hotel


def folders(tmp_path, hotels, overrides=None, encoding=None):
    out = {}
    for h in hotels:
        (tmp_path / f"h{h}").mkdir()
        out[h] = write_hotel(tmp_path / f"h{h}", h, (overrides or {}).get(h), (encoding or {}).get(h))
    return out


def scans(df):
    return len(re.findall(r"FileScan csv", df._jdf.queryExecution().executedPlan().toString()))


def test_scans_do_not_grow_with_properties(spark, tmp_path):
    few, many = (many_csv.ManyHotels(spark, folders(tmp_path / name, hotels)) for name, hotels in _made(tmp_path))
    for table in ("search_log", "daily_ppc_budget", "website_daily_users"):
        assert scans(few.tables[table]) == scans(many.tables[table])
    assert sorted(r[0] for r in many.tables.search_log.select("hotel_id").collect()) == list(range(1, 51))


def _made(tmp_path):
    for name, hotels in (("few", (1, 2, 3)), ("many", range(1, 51))):
        (tmp_path / name).mkdir()
        yield name, hotels


def test_rows_are_those_of_the_single_loader(spark, tmp_path):
    """Another column order, an extra column and another encoding are groups of their own."""
    order = list(TABLES["search_log_session"])
    text = "hírlevél / őszi"
    over = {
        2: {"search_log_session": [";".join(reversed(order)), "c;m;s;5;u-2;9"], "upsell_data": [";".join([*TABLES["upsell_data"], "colour"]), "1;2;NA;5.00;1;;red"]},
        3: {"website_daily_users": ["date;utm_source_and_medium;utm_campaign;user_count;session_count", f"2024-01-01;{text};;1;2.0"]},
    }
    made = folders(tmp_path, (1, 2, 3), over, {3: {"website_daily_users": "iso-8859-2"}})
    many, single = many_csv.ManyHotels(spark, made), raw_csv.load_hotels(spark, made)
    for table in TABLE_NAMES:
        columns = [c for c in single[table].columns]
        assert sorted(many.tables[table].columns) == sorted(columns)
        rows = lambda df: sorted(map(str, df.select(*columns).collect()))
        assert rows(many.tables[table]) == rows(single[table])
        assert [f.dataType for f in many.tables[table].select(*columns).schema] == [f.dataType for f in single[table].schema]
    assert many.rejected().count() == 0
    assert scans(many.tables.website_daily_users) == 2 and scans(many.tables.booking_data) == 1


def test_bad_lines_are_set_aside_with_file_and_reason(spark, tmp_path):
    names = ";".join(TABLES["upsell_data"])
    over = {
        1: {"upsell_data": [names, "1;2;wine;5.00;1;5.00", "2;2;wine;5.00;;5.00", "3;2;wine;five;1;5.00", "4;2;wine;5.00;x;5.00"]},
        2: {"upsell_data": [names, "5;2;wine;5.00;1;5.00;6.00", "6;2", "7;2;wine;;3.0;"]},
    }
    many = many_csv.ManyHotels(spark, folders(tmp_path, (1, 2), over))
    good = sorted((r["hotel_id"], r["search_log_id"], r["pieces"], float(r["unit_price"])) for r in many.tables.upsell_data.collect())
    assert good == [(1, 1, 1, 5.0), (2, 7, 3, 0.0)]
    bad = sorted(tuple(r) for r in many.rejected(("upsell_data",)).collect())
    assert [(h, t, f, reason) for h, t, f, reason, _ in bad] == [
        (1, "upsell_data", "upsell_data_hotel_1.csv", "pieces: missing value in an integer column"),
        (1, "upsell_data", "upsell_data_hotel_1.csv", "pieces: not an integer"),
        (1, "upsell_data", "upsell_data_hotel_1.csv", "unit_price: not a money"),
        (2, "upsell_data", "upsell_data_hotel_2.csv", "more fields than the header"),
        (2, "upsell_data", "upsell_data_hotel_2.csv", "pieces: missing value in an integer column"),
    ]
    assert {line.split(";")[0] for *_, line in bad} == {"2", "3", "4", "5", "6"}
    assert spark.createDataFrame([], many_csv.REJECTED).schema.simpleString() == many.rejected(("upsell_data",)).schema.simpleString()


def test_absent_columns_and_files_are_named(spark, tmp_path):
    made = folders(tmp_path, (1, 2), {2: {"daily_occupancy": ["recording_date;subject_date", "2024-01-01;2024-01-01"]}})
    with pytest.raises(ValueError, match="daily_occupancy of hotel 2"):
        many_csv.ManyHotels(spark, made).tables.daily_occupancy
    (tmp_path / "h1" / "upsell_data_hotel_1.csv").unlink()
    with pytest.raises(RuntimeError, match="upsell_data"):
        many_csv.ManyHotels(spark, made).tables.upsell_data
