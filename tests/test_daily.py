from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodgelens.plans import daily

START = date(2024, 1, 1)


def days(make_tables, fill, users=None, spend=None, hotel_id=1):
    n = len(fill)
    users = users or [10] * n
    spend = spend or [30] * n
    dates = [START + timedelta(days=i) for i in range(n)]
    return make_tables(
        datepicker_daily_visitors=[
            {"hotel_id": hotel_id, "date": d, "user_count": u, "session_count": 2 * u} for d, u in zip(dates, users)
        ],
        daily_occupancy=[
            {"hotel_id": hotel_id, "recording_date": d - timedelta(days=lead), "subject_date": d, "fill_rate": f + 50 * lead}
            for d, f in zip(dates, fill) if f is not None for lead in (0, 1)
        ],
        daily_ppc_budget=[
            {"hotel_id": hotel_id, "date": d, "daily_google_spend": s, "daily_microsoft_spend": 1, "daily_meta_spend": 2}
            for d, s in zip(dates, spend)
        ],
    )


def test_feature_list():
    assert len(daily.FEATURES) == 29 and len(daily.SCALED) == 27


def test_moving_figures_skip_nulls(make_tables):
    got = daily.daily_features(days(make_tables, [1.0, 3.0, None])).orderBy("date").collect()
    assert [r["fill_rate_ma3"] for r in got] == [1, 2, 2]
    assert got[0]["fill_rate_std3"] is None
    assert [r["fill_rate_std3"] for r in got[1:]] == pytest.approx([np.sqrt(2)] * 2)
    assert got[0]["total_ppc_spend"] == 33 and got[0]["ppc_per_user"] == 3.3


def test_features_equal_pandas(make_tables):
    rng = np.random.default_rng(1)
    fill = [float(x) for x in rng.uniform(0, 100, 40)]
    users = [int(x) for x in rng.integers(0, 5, 40)]
    got = daily.daily_features(days(make_tables, fill, users)).orderBy("date").toPandas()
    frame = pd.DataFrame({"fill_rate": fill, "user_count": users})
    for w in daily.WINDOWS:
        np.testing.assert_allclose(got[f"fill_rate_ma{w}"], frame.fill_rate.rolling(w, min_periods=1).mean())
        np.testing.assert_allclose(got[f"fill_rate_std{w}"], frame.fill_rate.rolling(w, min_periods=1).std())
        np.testing.assert_allclose(got[f"user_count_ma{w}"], frame.user_count.rolling(w, min_periods=1).mean())
    for k in daily.LAGS:
        np.testing.assert_allclose(got[f"fill_rate_lag{k}"].astype(float), frame.fill_rate.shift(k))
    np.testing.assert_allclose(got["conversion_rate"], [2.0 if u else 0.0 for u in users])
    dates = pd.to_datetime(got["date"])
    np.testing.assert_allclose(got["weekday"], dates.dt.dayofweek)
    np.testing.assert_allclose(got["month_cos"], np.cos(2 * np.pi * dates.dt.month / 12))


def test_no_leak_frame_ends_the_day_before(make_tables):
    got = daily.daily_features(days(make_tables, [1.0, 3.0, 8.0]), include_current=False).orderBy("date").collect()
    assert [r["fill_rate_ma3"] for r in got] == [None, 1, 2]
    assert [r["user_count_ma3"] for r in got] == [10, 10, 10]


def test_scaling_uses_the_population_deviation(make_tables):
    rng = np.random.default_rng(2)
    fill = [float(x) for x in rng.uniform(0, 100, 30)]
    users = [int(x) for x in rng.integers(1, 9, 30)]
    t = days(make_tables, fill, users)
    got = daily.scaled_features(t).orderBy("date").toPandas()
    raw = daily.daily_features(t).orderBy("date").toPandas()
    expected = (raw.user_count - raw.user_count.mean()) / raw.user_count.std(ddof=0)
    np.testing.assert_allclose(got["user_count"], expected[14:])  # the first 14 days lack their lags
    assert got["total_ppc_spend"].eq(0).all()  # constant: no spread, divided by one
    np.testing.assert_allclose(got["weekday"], raw["weekday"][14:])


def test_noisy_twins(make_tables):
    t = days(make_tables, [float(i) for i in range(20)])
    rows = daily.daily_features(t)
    twins = daily.with_noisy_twins(rows, seed=3)
    again = daily.with_noisy_twins(rows.repartition(5), seed=3)
    assert sorted(map(str, twins.collect())) == sorted(map(str, again.collect()))
    pairs = twins.groupBy("date").agg((F.max_by("fill_rate", "copy") - F.min_by("fill_rate", "copy")).alias("d")).collect()
    noise = [r["d"] for r in pairs]
    assert len(noise) == 20 and 0.03 < np.std(noise) < 0.25
    assert twins.where("copy = 0").select("fill_rate").orderBy("date").first()[0] == 0.0
    assert twins.where("copy = 1 and fill_rate_lag7 is null").count() == 7


@pytest.mark.parametrize("n, test_rows", [(10, 2), (11, 3), (4, 1), (1, 1)])
def test_split_takes_the_last_fifth(make_tables, n, test_rows):
    rows = daily.daily_series(days(make_tables, [1.0] * n))
    split = daily.chronological_split(rows).orderBy("date").collect()
    assert [r["role"] for r in split] == ["train"] * (n - test_rows) + ["test"] * test_rows


@pytest.mark.parametrize("n", [12, 17, 23])
def test_growing_folds(make_tables, n):
    rows = daily.daily_series(days(make_tables, [1.0] * n))
    roles = daily.fold_roles(daily.fold_blocks(rows)).orderBy("fold", "date").toPandas()
    size = n // 6
    for fold in range(5):
        start = n - (5 - fold) * size
        part = roles[roles.fold == fold]
        assert part.role.tolist() == ["train"] * start + ["test"] * size
