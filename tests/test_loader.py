from datetime import date, datetime
from decimal import Decimal

import pytest

from lodgelens.schema import TABLE_NAMES, TABLES, clean_schema
from lodgelens.sources import raw_csv, store

SAMPLE = {"id": "7", "int": "3", "money": "10.50", "rate": "1.0", "label": "x", "text": "u-1", "date": "2024-03-01",
          "instant": "2024-03-01 10:30:00"}


def write_hotel(folder, hotel_id, overrides=None, encoding=None):
    """One row per table; ``overrides`` maps a table to its lines (header first)."""
    overrides = overrides or {}
    for table, kinds in TABLES.items():
        sep = "," if table == "daily_ppc_budget" else ";"
        header = ["" if table == "daily_ppc_budget" and c == "date" else c for c in kinds]
        lines = overrides.get(table) or [sep.join(header), sep.join(SAMPLE[k] for k in kinds.values())]
        code = (encoding or {}).get(table, "utf-8")
        (folder / f"{table}_hotel_{hotel_id}.csv").write_bytes(("\n".join(lines) + "\n").encode(code))
    return str(folder)


def test_types_of_all_tables(spark, tmp_path):
    t = raw_csv.load_hotel(spark, write_hotel(tmp_path, 1), 1)
    for name in TABLE_NAMES:
        assert [(f.name, f.dataType) for f in t[name].schema] == [(f.name, f.dataType) for f in clean_schema(name)]
        assert t[name].count() == 1
    search = t.search_log.first()
    assert search["hotel_id"] == 1 and search["total_price_final"] == Decimal("10.50")
    assert search["utc_datetime"] == datetime(2024, 3, 1, 10, 30)
    assert t.daily_ppc_budget.first()["date"] == date(2024, 3, 1)  # its header is empty in the file
    assert raw_csv.validate(t) == dict.fromkeys(TABLE_NAMES, 1)


def test_fills_and_missing_texts(spark, tmp_path):
    lines = {
        "search_log_session": [
            "id;uuid;session_id;utm_source;utm_medium;utm_campaign;browser",
            "1;;5;;NaN;NULL;firefox",
        ],
        "booking_data": [
            ";".join(TABLES["booking_data"]),
            "9;;12.345;;3.0;N/A;0",
        ],
        "daily_occupancy": ["recording_date;subject_date;fill_rate", ";2024-01-02;"],
    }
    t = raw_csv.load_hotel(spark, write_hotel(tmp_path, 1, lines), 1)
    session = t.search_log_session.first()
    assert session["uuid"] is None  # free text keeps its null
    assert (session["utm_source"], session["utm_medium"], session["utm_campaign"]) == ("0", "0", "0")
    assert session["browser"] == "firefox"  # an extra column passes through
    booking = t.booking_data.first()
    assert booking["total_price_final"] == 0 and booking["rooms_total_price"] == Decimal("12.35")
    assert booking["vouchers_total_price"] == 3
    occupancy = t.daily_occupancy.first()
    assert occupancy["recording_date"] is None and occupancy["fill_rate"] == 0.0


@pytest.mark.parametrize("bad", ["", "abc"])
def test_bad_integer_fails(spark, tmp_path, bad):
    lines = {"search_log_room_child": ["id;search_log_room_id;age;baby_bed", f"1;2;{bad};0"]}
    t = raw_csv.load_hotel(spark, write_hotel(tmp_path, 1, lines), 1)
    with pytest.raises(Exception, match="age|abc"):
        t.search_log_room_child.select("age").collect()
    with pytest.raises(Exception, match="age|abc"):
        raw_csv.validate(t)


def test_missing_file_and_column_are_named(spark, tmp_path):
    t = raw_csv.load_hotel(spark, str(tmp_path), 1)
    with pytest.raises(RuntimeError, match="upsell_data of hotel 1"):
        t.upsell_data
    lines = {"daily_occupancy": ["recording_date;subject_date", "2024-01-01;2024-01-01"]}
    t = raw_csv.load_hotel(spark, write_hotel(tmp_path, 1, lines), 1)
    with pytest.raises(ValueError, match="fill_rate"):
        t.daily_occupancy


def test_utm_columns_on_load(spark, tmp_path):
    def lines(*pairs):
        return ["date;utm_source_and_medium;utm_campaign;user_count;session_count"] + [
            f"2024-01-0{i};{p};c;1;2" for i, p in enumerate(pairs, 1)
        ]

    pairs = ("google / cpc", "direct", "", "a/b/c")
    over = {"datepicker_daily_visitors": lines(*pairs), "website_daily_users": lines(*pairs)}
    t = raw_csv.load_hotel(spark, write_hotel(tmp_path, 1, over), 1)
    got = [tuple(r) for r in t.datepicker_daily_visitors.orderBy("date").select("utm_source", "utm_medium").collect()]
    assert got == [("google", "cpc"), ("direct", "unknown"), ("unknown", "unknown"), ("a", "b/c")]
    raw = [tuple(r) for r in t.website_daily_users.orderBy("date").select("utm_source", "utm_medium").collect()]
    assert raw[0] == ("google ", " cpc")
    assert t.datepicker_daily_visitors.where("utm_source_and_medium = '0'").count() == 1


def test_central_european_encoding(spark, tmp_path):
    text = "hírlevél / őszi űrlap ŐŰ łąž"
    lines = {
        "website_daily_users": [
            "date;utm_source_and_medium;utm_campaign;user_count;session_count",
            f"2024-01-01;{text};árvíztűrő;1;2",
        ]
    }
    folder = write_hotel(tmp_path, 3, lines, {"website_daily_users": "iso-8859-2"})
    row = raw_csv.load_hotel(spark, folder, 3).website_daily_users.first()
    assert row["utm_source_and_medium"] == text and row["utm_campaign"] == "árvíztűrő"


def test_quotes(spark, tmp_path):
    lines = {"upsell_data": [";".join(TABLES["upsell_data"]), '1;2;"Wine; ""red""";5.00;1;5.00']}
    t = raw_csv.load_hotel(spark, write_hotel(tmp_path, 1, lines), 1)
    assert t.upsell_data.first()["name"] == 'Wine; "red"'


def test_many_hotels_store_and_exports(spark, tmp_path):
    folders = {}
    for h in (1, 2):
        (tmp_path / f"in{h}").mkdir()
        folders[h] = write_hotel(tmp_path / f"in{h}", h)
    t = raw_csv.load_hotels(spark, folders)
    assert sorted(r["hotel_id"] for r in t.search_log.collect()) == [1, 2]

    store.write_store(t, str(tmp_path / "store"))
    back = store.read_store(spark, str(tmp_path / "store"))
    for name in TABLE_NAMES:
        columns = t[name].columns
        assert sorted(map(str, back[name].select(columns).collect())) == sorted(map(str, t[name].collect()))
    one = store.read_store(spark, str(tmp_path / "store"), [2])
    assert [r["hotel_id"] for r in one.search_log.collect()] == [2]
    assert "PartitionFilters: [isnotnull(hotel_id" in one.search_log._jdf.queryExecution().toString()

    plain = store.export_csv(t, str(tmp_path / "csv"))
    again = spark.read.csv(f"{plain}/search_log", header=True)
    assert again.count() == 2 and "currency" in again.columns
    packed = store.export_compressed(t, str(tmp_path / "zip"), datetime(2024, 5, 6, 7, 8, 9))
    assert packed.endswith("export_ts=20240506_070809")
    assert list((tmp_path / "zip" / "export_ts=20240506_070809" / "search_log").glob("*.csv.gz"))


def test_only_needed_tables_are_opened(spark, tmp_path):
    write_hotel(tmp_path, 1)
    (tmp_path / "upsell_data_hotel_1.csv").unlink()
    t = raw_csv.load_hotel(spark, str(tmp_path), 1)
    assert t.search_log.count() == 1
