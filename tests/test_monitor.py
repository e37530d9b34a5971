from datetime import date, datetime

import pytest

from lodgelens.plans import monitor
from lodgelens.schema import TABLE_NAMES
from lodgelens.sources import store


@pytest.fixture(scope="module")
def predictions(spark):
    pairs = zip([60.0, 65.0, 70.0, 75.0], [62.0, 63.0, 71.0, 73.0])
    return spark.createDataFrame([(1, p, a) for p, a in pairs], "hotel_id long, prediction double, label double")


def test_worked_example(predictions):
    row = monitor.model_metrics(predictions).first()
    assert (round(row["rmse"], 3), round(row["mae"], 3), round(row["r2"], 3)) == (1.803, 1.75, 0.86)
    assert row["rmse_vs_baseline"] == pytest.approx(row["rmse"] - 8.35)


def test_residuals(predictions):
    assert sorted(r["residual"] for r in monitor.with_residual(predictions).collect()) == [-2, -2, 1, 2]
    counts = {r["bin"]: r["n"] for r in monitor.residual_histogram(predictions).collect()}
    assert counts == {0: 2, 15: 1, 19: 1}


@pytest.fixture(scope="module")
def tables(make_tables):
    day = date(2024, 5, 1)
    at = datetime(2024, 5, 1, 9)
    return make_tables(
        **{
            **dict.fromkeys(TABLE_NAMES, []),
            "search_log": [{"id": 1, "utc_datetime": at, "conversion": 1.0}, {"id": 2, "utc_datetime": at, "conversion": 0.0}],
            "daily_occupancy": [
                {"recording_date": day, "subject_date": day, "fill_rate": 40.0},
                {"recording_date": day, "subject_date": date(2024, 5, 2), "fill_rate": 90.0},
            ],
            "website_daily_users": [{"date": date(2024, 4, 30), "user_count": 7}, {"date": day, "user_count": 5}] * 2,
        }
    )


def test_daily_metrics_keep_every_day(tables):
    got = monitor.daily_metrics(tables).orderBy("date").collect()
    assert [(r["bookings"], r["occupancy_rate"], r["website_visitors"]) for r in got] == [(0, None, 14), (1, 40.0, 10)]


def test_reports_are_kept_and_read_back(spark, tables, predictions, tmp_path):
    path = str(tmp_path / "reports")
    for hour in (8, 7):
        report = monitor.model_report(predictions, tables, "linear", datetime(2024, 5, 1, hour))
        store.append_report(report, path)
    history = store.read_reports(spark, path, report)
    assert history.count() == 2
    row = history.first()
    assert row["daily_metrics"]["website_visitors"] == 10
    quality = {q["table_name"]: q for q in row["data_quality"]}
    assert quality["website_daily_users"]["duplicate_rows"] == 2 and quality["search_log"]["row_count"] == 2
    trend = monitor.metric_history(history).collect()
    assert [r["timestamp"][11:13] for r in trend] == ["07", "08"] and round(trend[0]["rmse"], 3) == 1.803
