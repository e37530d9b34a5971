import numpy as np
import pytest
from pyspark.sql import functions as F

from lodgelens.operators import cells, distribution, tiers


@pytest.fixture(scope="module")
def sales(spark):
    rows = [("HUF", "a", "x", 1.0)] * 3 + [("HUF", "a", "y", 2.0)] + [("HUF", "b", "x", 5.0), ("EUR", "a", "y", 0.0)]
    return spark.createDataFrame(rows, "currency string, r string, c string, v double")


def as_dict(df, keys, value):
    return {tuple(row[k] for k in keys): row[value] for row in df.collect()}


def test_counts_and_both_shares_agree(sales):
    counted = cells.count_cells(sales, ["currency", "r", "c"])
    assert as_dict(counted, ["currency", "r", "c"], "n") == {
        ("HUF", "a", "x"): 3, ("HUF", "a", "y"): 1, ("HUF", "b", "x"): 1, ("EUR", "a", "y"): 1,
    }
    closed = as_dict(cells.add_share(counted, "n", ["currency", "r"]), ["currency", "r", "c"], "share_pct")
    opened = as_dict(cells.add_open_share(counted, "n", ["currency", "r"]), ["currency", "r", "c"], "share_pct")
    assert closed == opened == {
        ("HUF", "a", "x"): 75.0, ("HUF", "a", "y"): 25.0, ("HUF", "b", "x"): 100.0, ("EUR", "a", "y"): 100.0,
    }


def test_open_share_keeps_null_groups(spark):
    df = spark.createDataFrame([(None, "x", 1), (None, "y", 3)], "g string, c string, n int")
    assert as_dict(cells.add_open_share(df, "n", ["g"]), ["c"], "share_pct") == {("x",): 25.0, ("y",): 75.0}


def test_spread_fills_or_keeps_nulls(sales):
    wide = cells.spread(sales, ["currency", "r"], "c", ["x", "y"], {"n": F.count(F.lit(1))}, fill=0)
    assert as_dict(wide, ["currency", "r"], "y") == {("HUF", "a"): 1, ("HUF", "b"): 0, ("EUR", "a"): 1}
    means = cells.spread(sales, ["currency", "r"], "c", ["x", "y"], {"m": F.avg("v")})
    assert as_dict(means, ["currency", "r"], "y")[("HUF", "b")] is None


def test_zero_columns_go_per_table(sales):
    summed = sales.groupBy("currency", "r", "c").agg(F.sum("v").alias("v"))
    left = cells.drop_zero_columns(summed, ["currency", "c"], "v")
    assert {(r["currency"], r["c"]) for r in left.collect()} == {("HUF", "x"), ("HUF", "y")}


def test_value_counts_with_levels(sales):
    only_x = sales.where("c = 'x'")
    assert as_dict(cells.value_counts(only_x, "c", by=["currency"]), ["currency", "c"], "n") == {("HUF", "x"): 4}
    levels = cells.value_counts(only_x, "c", by=["currency"], levels=sales)
    assert as_dict(levels, ["currency", "c"], "n") == {("HUF", "x"): 4, ("HUF", "y"): 0, ("EUR", "y"): 0}
    listed = cells.by_count(cells.value_counts(sales, "c", by=[]), "c").collect()
    assert [(r["c"], r["n"]) for r in listed] == [("x", 4), ("y", 2)]
    assert [r["c"] for r in cells.distinct_sorted(sales, "c").collect()] == ["x", "y"]


def test_top_k_breaks_ties_by_key(spark):
    df = spark.createDataFrame([("g", i, v) for i, v in enumerate([5, 9, 9, 1, 9])], "g string, id int, v int")
    top = cells.top_k(df, ["g"], [F.desc("v"), F.asc("id")], 2)
    assert sorted((r["rank"], r["id"]) for r in top.collect()) == [(1, 1), (2, 2)]


@pytest.mark.parametrize("seed", range(3))
def test_weighted_statistics_equal_numpy(spark, seed):
    rng = np.random.default_rng(seed)
    values = rng.integers(-3, 60, size=501)
    df = spark.createDataFrame([(1, int(v)) for v in values], "g int, v int").repartition(7)
    histogram = distribution.value_histogram(df, ["g"], "v")
    row = distribution.summarise(histogram, ["g"], "v").first()
    assert row["bookings"] == len(values)
    assert row["mean"] == pytest.approx(values.mean())
    assert row["median"] == np.median(values)
    assert row["std"] == pytest.approx(values.std(ddof=1), rel=1e-12)
    q = distribution.quartiles(histogram, ["g"], "v").first()
    assert [q["p25"], q["p50"], q["p75"]] == pytest.approx(np.percentile(values, [25, 50, 75]))


def test_deviation_of_one_row_is_null(spark):
    df = spark.createDataFrame([(1, 4)], "g int, v int")
    row = distribution.summarise(distribution.value_histogram(df, ["g"], "v"), ["g"], "v").first()
    assert row["std"] is None and row["median"] == 4


def test_box_hides_outliers(spark):
    values = [1, 2, 3, 4, 5, 6, 7, 8, 100]
    df = spark.createDataFrame([(1, v) for v in values], "g int, v int")
    box = distribution.box_statistics(distribution.value_histogram(df, ["g"], "v"), ["g"], "v").first()
    assert (box["p25"], box["p50"], box["p75"]) == (3, 5, 7)
    assert (box["whisker_low"], box["whisker_high"]) == (1, 8)


def test_histogram_equals_numpy(spark):
    rng = np.random.default_rng(5)
    values = rng.normal(size=400)
    df = spark.createDataFrame([(1, float(v)) for v in values], "g int, v double")
    got = as_dict(distribution.equal_width_histogram(df, ["g"], "v"), ["bin"], "n")
    expected, _ = np.histogram(values, bins=20)
    assert [got.get((i,), 0) for i in range(20)] == expected.tolist()


def test_histogram_of_equal_values(spark):
    df = spark.createDataFrame([(1, 3.0), (1, 3.0)], "g int, v double")
    assert as_dict(distribution.equal_width_histogram(df, ["g"], "v"), ["bin"], "n") == {(0,): 2}


@pytest.mark.parametrize(
    "revenues, expected",
    [
        ([1, 2, 4, 8], ["low", "low", "medium", "high"]),
        ([5, 5, 5, 9], ["low", "low", "low", "low"]),
        ([3, 3, 3], ["low", "low", "low"]),
    ],
)
def test_tiers(spark, revenues, expected):
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(revenues)], "g int, id int, v double")
    labelled = tiers.add_tier(df, ["g"], "v").orderBy("id").collect()
    assert [r["tier"] for r in labelled] == expected


def test_tiers_equal_numpy_cut(spark):
    rng = np.random.default_rng(8)
    values = np.round(rng.gamma(2, 100, size=200), 2)
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(values)], "g int, id int, v double")
    edges = np.round(np.quantile(values, [0, 1 / 3, 2 / 3, 1]), 6)
    expected = np.array(["low", "medium", "high"])[np.searchsorted(edges[1:3], values, side="left")]
    got = [r["tier"] for r in tiers.add_tier(df, ["g"], "v").orderBy("id").collect()]
    assert got == expected.tolist()
