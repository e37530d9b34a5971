"""Quantiles by running counts, duplicate rows in two phases, mergeable sketches, reports that are written again."""

from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodgelens.operators import sketches
from lodgelens.operators.ranks import quantile_edges
from lodgelens.operators.tiers import add_tier
from lodgelens.plans import monitor, profile, trends, upsell, visits
from lodgelens.schema import TABLE_NAMES
from lodgelens.session import StoredTables
from lodgelens.sources import store
from lodgelens.sources.sample_views import load_views

from conftest import TESTDATA


@pytest.mark.parametrize("ranges", [1, 2, 7, 256])
def test_quantiles_equal_numpy_whatever_the_ranges(spark, ranges):
    rng = np.random.default_rng(ranges)
    groups = {
        1: rng.normal(size=500).round(2).tolist(),
        2: [5.0] * 40,
        3: [1.0, 2.0],
        4: [7.5],
        None: rng.integers(-3, 3, size=100).astype(float).tolist(),
    }
    rows = [(g, v) for g, values in groups.items() for v in values] + [(1, None), (6, None)]
    fractions = [0.0, 0.1, 1 / 3, 0.5, 2 / 3, 0.999, 1.0]
    items = spark.createDataFrame(rows, "g long, v double")
    got = {r["g"]: r["edges"] for r in quantile_edges(items, ["g"], "v", fractions, ranges).collect()}
    assert got.keys() == groups.keys()
    for g, values in groups.items():
        np.testing.assert_allclose(got[g], np.quantile(values, fractions), atol=1e-12)


def test_quantiles_keep_no_values_in_an_aggregate(spark):
    """No percentile over all values: aggregates hold counts, sums, or a sketch of fixed size."""
    items = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("v"))
    plan = quantile_edges(items, ["g"], "v", [0.5])._jdf.queryExecution().executedPlan().toString()
    assert "percentile_approx" in plan and "percentile(" not in plan


def test_tiers_with_equal_values_on_a_cut(spark):
    """Equal revenues on both cuts: the edges merge, and the first labels are used."""
    rows = [(1, f"p{n}", v) for n, v in enumerate([1.0, 5.0, 5.0, 5.0, 5.0, 9.0])]
    tiers = add_tier(spark.createDataFrame(rows, "g long, name string, v double"), ["g"], "v")
    assert sorted((r["v"], r["tier"]) for r in tiers.collect()) == [(1.0, "low")] + [(5.0, "low")] * 4 + [(9.0, "medium")]


def _with_repeats(make_tables):
    day = date(2024, 5, 1)
    rows = [
        {"hotel_id": 1, "date": day, "utm_campaign": "a", "user_count": 1},
        {"hotel_id": 1, "date": day, "utm_campaign": "a", "user_count": 1},
        {"hotel_id": 1, "date": day, "utm_campaign": None, "user_count": None},
        {"hotel_id": 1, "date": day, "utm_campaign": None, "user_count": None},
        {"hotel_id": 1, "date": day, "utm_campaign": None, "user_count": None},
        {"hotel_id": 2, "date": day, "utm_campaign": "a", "user_count": 1},
        {"hotel_id": 2, "date": None, "utm_campaign": "a", "user_count": 2},
    ]
    return make_tables(**{**dict.fromkeys(TABLE_NAMES, []), "website_daily_users": rows})


@pytest.mark.parametrize("few", [0, 1000])
@pytest.mark.parametrize("constant", [False, True])
def test_duplicates_are_exact_even_where_all_fingerprints_collide(make_tables, monkeypatch, constant, few):
    monkeypatch.setattr(profile, "FEW_FINGERPRINTS", few)
    hashed = (lambda columns: F.lit(7).cast("long")) if constant else profile.fingerprint
    got = {r["hotel_id"]: r.asDict() for r in profile.data_quality(_with_repeats(make_tables), hashed=hashed).collect()}
    assert {h: (r["row_count"], r["duplicate_rows"]) for h, r in got.items()} == {1: (5, 3), 2: (2, 0)}
    assert got[1]["missing_values"] == 5 * 4 + 3 * 2 and got[2]["missing_values"] == 2 * 4 + 1


def test_without_repeated_fingerprints_no_row_is_fetched(make_tables):
    t = make_tables(daily_occupancy=[{"fill_rate": 1.0}, {"fill_rate": 2.0}])
    quality = profile.data_quality(t, ("daily_occupancy",))
    assert quality.first()["duplicate_rows"] == 0
    assert "fill_rate" not in quality._jdf.queryExecution().executedPlan().toString()


def test_sketches_of_days_merge_to_what_all_rows_give(spark):
    t = load_views(spark, TESTDATA)
    daily = StoredTables(spark, "test-sketches").put(trends.daily_sketches(t), "daily")
    checked = trends.monthly_check(t, daily).collect()
    assert checked and all(r["visitors_within"] and r["median_within"] for r in checked)
    whole = sketches.merged(daily, ["hotel_id"]).select("hotel_id", sketches.distinct_count().alias("n"))
    exact = trends._searches(t).groupBy("hotel_id").agg(F.count_distinct("uuid").alias("exact"))
    for r in whole.join(exact, "hotel_id").collect():
        assert abs(r["n"] - r["exact"]) <= sketches.DISTINCT_BOUND * r["exact"]


def test_sketch_bounds_hold_on_many_values_and_empty_sketches_have_no_quantile(spark):
    rows = spark.range(300_000).select(
        F.lit(1).alias("k"), (F.col("id") % 100).alias("day"), (F.col("id") % 90_000).alias("who"), F.sqrt("id").alias("v")
    )
    merged = sketches.merged(sketches.sketch_rows(rows, ["k", "day"], "who", "v"), ["k"])
    n, median = merged.select(sketches.distinct_count(), sketches.approximate_quantile(0.5)).first()
    assert abs(n - 90_000) <= sketches.DISTINCT_BOUND * 90_000
    assert abs(median**2 / 300_000 - 0.5) <= sketches.RANK_BOUND
    none = spark.createDataFrame([(1, 1, None, None)], "k int, day int, who string, v double")
    empty = sketches.merged(sketches.sketch_rows(none, ["k", "day"], "who", "v"), ["k"])
    assert tuple(empty.select(sketches.distinct_count(), sketches.approximate_quantile(0.5)).first()) == (0, None)


def test_levels_agree_with_the_separate_plans(spark):
    t = load_views(spark, TESTDATA)
    levels = visits.visits_levels(t).collect()
    overall = {r["hotel_id"]: r.asDict() for r in visits.visits_overall(t).collect()}
    for r in levels:
        if r["level"] == 1:
            assert r["currency"] is None and {k: r[k] for k in overall[r["hotel_id"]]} == overall[r["hotel_id"]]
    products = upsell.upsell_levels(t).collect()
    cells = sum(r["sold"] for r in products if r["level"] == 0)
    assert [sum(r["sold"] for r in products if r["level"] == k) for k in (1, 2, 3)] == [cells] * 3


def test_levels_read_the_cells_once(spark):
    t = load_views(spark, TESTDATA)
    count = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Scan parquet")
    assert count(upsell.upsell_levels(t)) == count(upsell.upsell_revenue(t))


def test_a_repeated_report_replaces_its_own_rows_only(spark, make_tables, tmp_path):
    t = make_tables(**dict.fromkeys(TABLE_NAMES, []))
    told = lambda shift: spark.createDataFrame(
        [(h, 60.0 + shift, 61.0 + n) for h in (1, 2) for n in range(3)], "hotel_id long, prediction double, label double"
    )
    path = str(tmp_path / "reports")
    for hour, shift in ((8, 0.0), (9, 1.0), (9, 2.0)):
        store.append_report(monitor.model_report(told(shift), t, "linear", datetime(2024, 5, 1, hour)), path)
    one = monitor.model_report(told(3.0).where("hotel_id = 2"), t, "linear", datetime(2024, 5, 1, 9))
    store.append_report(one, path)
    history = monitor.metric_history(store.read_reports(spark, path, one)).collect()
    assert [(r["hotel_id"], r["timestamp"][11:13]) for r in history] == [(1, "08"), (1, "09"), (2, "08"), (2, "09")]
    assert history[0]["mae_change"] is None
    assert [round(r["mae"], 6) for r in history] == [2.0, round(2 / 3, 6), 2.0, 1.0]
    assert history[1]["mae_change"] == pytest.approx(history[1]["mae"] - history[0]["mae"])
