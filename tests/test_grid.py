"""Model grids from moments and from shared tree fits, against refitting, Spark ML, numpy and plain recursion."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from conftest import TESTDATA
from lodgelens.operators import trees
from lodgelens.plans import grid, occupancy
from lodgelens.plans.daily import FEATURES, TARGET
from lodgelens.session import cut_lineage
from lodgelens.sources.sample_views import load_views


@pytest.fixture(scope="module")
def rows(spark):
    return cut_lineage(grid.model_rows(load_views(spark, TESTDATA)))


@pytest.fixture(scope="module")
def linear(rows):
    return cut_lineage(grid.linear_grid(rows))


@pytest.fixture(scope="module")
def frame(rows):
    return rows.toPandas().sort_values(["hotel_id", "date", "copy"])


def test_rows_are_those_of_the_single_fits(spark, frame):
    """Same days, blocks and target as the rows that the single property's fit prepares, in both modes."""
    t = load_views(spark, TESTDATA)
    for compatible in (True, False):
        want = occupancy.model_rows(t, 2, reference_compatible=compatible)[0].toPandas()
        got = grid.model_rows(t, compatible).where("hotel_id = 2").toPandas()
        key = ["date", "copy"]
        both = got.merge(want, on=key, suffixes=("", "_w"))
        assert len(both) == len(got) == len(want)
        assert (both.block == both.block_w.fillna(grid.TEST_BLOCK)).all()
        np.testing.assert_allclose(both[TARGET], both[f"{TARGET}_w"])
        scaled = want[FEATURES].copy()
        np.testing.assert_allclose(np.corrcoef(both.user_count, both.user_count_w)[0, 1], 1.0)
        assert scaled.shape[1] == 29


def test_folds_errors_equal_refitting_on_rows(frame, linear):
    """Every point of the linear families, both branches: errors of the folds from plain matrices of the fold's rows."""
    found = {(r["method"], r["model"], r["params"]): r for r in linear.where("hotel_id = 1").collect()}
    assert len(found) == 2 * 13
    mine = frame[frame.hotel_id == 1]
    train = mine[mine.block < grid.TEST_BLOCK]
    x, y = train[FEATURES].to_numpy(float), train[TARGET].to_numpy(float)
    n = len(x)
    r = np.array([np.corrcoef(x[:, i], y)[0, 1] for i in range(x.shape[1])])
    best = sorted(range(len(FEATURES)), key=lambda i: (-(r[i] ** 2 / (1 - r[i] ** 2)), FEATURES[i]))[:20]
    _, sizes, axes = np.linalg.svd(x - x.mean(0), full_matrices=False)
    kept = int(np.searchsorted(np.cumsum(sizes**2) / (sizes**2).sum(), 0.95, side="right")) + 1
    branches = {"selected": x[:, best], "pca": (x - x.mean(0)) @ axes[:kept].T}
    for (method, model, text), row in found.items():
        point, z, errors = json.loads(text), branches[method], []
        for fold in range(5):
            a, b = (train.block < fold).to_numpy(), (train.block == fold).to_numpy()
            zc, yc, m = z[a] - z[a].mean(0), y[a] - y[a].mean(), int(a.sum())
            if model == "elastic_net":
                w = np.zeros(z.shape[1])
                for _ in range(4000):
                    before = w.copy()
                    for j in range(len(w)):
                        rho = zc[:, j] @ (yc - zc @ w + zc[:, j] * w[j]) / m
                        soft = max(abs(rho) - point["alpha"] * point["l1_ratio"], 0)
                        w[j] = np.sign(rho) * soft / (zc[:, j] @ zc[:, j] / m + point["alpha"] * (1 - point["l1_ratio"]))
                    if np.abs(w - before).max() < 1e-13:
                        break
            else:
                w = np.linalg.solve(zc.T @ zc + point.get("alpha", 0) * np.eye(z.shape[1]), zc.T @ yc)
            errors.append(((y[b] - y[a].mean() - (z[b] - z[a].mean(0)) @ w) ** 2).mean())
        np.testing.assert_allclose(row["fold_mse"], errors, rtol=1e-9)
        assert row["cv_mse"] == pytest.approx(np.mean(errors), rel=1e-9)
    assert n == len(train)


def test_best_points_predict_what_spark_ml_predicts(rows, linear):
    """The chosen ridge and linear models of a property, refitted by Spark ML on its selected features."""
    results = {(r["method"], r["model"]): r for r in grid.linear_results(rows, linear).where("hotel_id = 3").collect()}
    assert len(results) == 6
    mine = rows.where("hotel_id = 3").withColumn("method", F.lit("x"))
    train, test = mine.where(F.col("block") < grid.TEST_BLOCK), mine.where(F.col("block") == grid.TEST_BLOCK)
    names = [r["feature"] for r in occupancy.select_features(train).orderBy("rank").collect()]
    vector = VectorAssembler(inputCols=names, outputCol="features")
    n, spread = train.select(F.count("*"), F.stddev_pop(TARGET)).first()
    for model in ("linear_regression", "ridge", "elastic_net"):
        row = results["selected", model]
        fitted = occupancy.MODELS[model].build(json.loads(row["best_params"]), n, spread).fit(vector.transform(train))
        scored = fitted.transform(vector.transform(test))
        rmse, mae = scored.select(F.sqrt(F.avg((F.col("prediction") - F.col(TARGET)) ** 2)), F.avg(F.abs(F.col("prediction") - F.col(TARGET)))).first()
        assert (row["rmse"], row["mae"]) == (pytest.approx(rmse, rel=1e-6), pytest.approx(mae, rel=1e-6))


def test_selection_equals_the_query_and_components_equal_numpy(rows, frame):
    train = rows.where(F.col("block") < grid.TEST_BLOCK)
    ranked = occupancy.select_features(train).collect()
    for hotel in (1, 2, 3):
        own = frame[(frame.hotel_id == hotel) & (frame.block < grid.TEST_BLOCK)]
        v = np.column_stack([np.ones(len(own)), own[[TARGET, *FEATURES]].to_numpy(float)])
        assert [grid.COLUMNS[i] for i in grid.selected(v.T @ v)] == [r["feature"] for r in sorted(ranked, key=lambda r: r["rank"]) if r["hotel_id"] == hotel]
        got = sorted((r for r in grid.principal_components(rows).where(F.col("hotel_id") == hotel).collect()), key=lambda r: r["component"])
        want = np.linalg.svd(own[FEATURES].to_numpy(float) - own[FEATURES].to_numpy(float).mean(0))
        np.testing.assert_allclose([r["variance"] for r in got], want[1] ** 2 / (len(own) - 1), rtol=1e-8, atol=1e-9)
        for r, axis in list(zip(got, want[2]))[:5]:
            assert abs(np.dot(r["axis"], axis)) == pytest.approx(1.0, abs=1e-6)
            assert max(r["axis"], key=abs) > 0
        assert sum(r["kept"] for r in got) == occupancy.components_kept([r["variance_share"] for r in got])


def plain_tree(x, y, rows, depth, min_split, min_leaf):
    if depth == 0 or len(rows) < max(min_split, 2 * min_leaf) or y[rows].var() <= 1e-12:
        return y[rows].mean()
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[rows, f])
        for cut in (values[:-1] + values[1:]) / 2:
            left, right = rows[x[rows, f] <= cut], rows[x[rows, f] > cut]
            if min(len(left), len(right)) < min_leaf:
                continue
            gain = len(left) * (y[left].mean() - y[rows].mean()) ** 2 + len(right) * (y[right].mean() - y[rows].mean()) ** 2
            if best is None or gain > best[0] * (1 + 1e-9):
                best = gain, f, cut, left, right
    if best is None:
        return y[rows].mean()
    return best[1], best[2], *(plain_tree(x, y, part, depth - 1, min_split, min_leaf) for part in best[3:])


def walk(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


@pytest.mark.parametrize("seed", range(6))
def test_trees_equal_plain_recursion_and_their_cuts_equal_smaller_trees(seed):
    rng = np.random.default_rng(seed)
    x, y = rng.integers(0, 9, size=(60, 3)).astype(float), rng.normal(size=60) + 40
    order, new = trees.sorted_rows(x), rng.integers(0, 9, size=(40, 3)).astype(float)
    weight = np.bincount(rng.integers(60, size=60), minlength=60)
    drawn = np.repeat(np.arange(60), weight)
    whole = {leaf: trees.grow(x, order, y, weight, None, 2, leaf) for leaf in (1, 3)}
    for leaf, tree in whole.items():
        cuts = tree.cuts(new, [2, 4, None], [2, 5])
        for d, depth in enumerate((2, 4, None)):
            for s, split in enumerate((2, 5)):
                single = trees.grow(x, order, y, weight, depth, split, leaf).cuts(new, [None], [0])[0, 0]
                np.testing.assert_allclose(cuts[d, s], single)
    plain = plain_tree(x, y, np.arange(60), 4, 2, 3)
    grown = trees.grow(x, order, y, None, 4, 2, 3).cuts(new, [None], [0])[0, 0]
    np.testing.assert_allclose(grown, [walk(plain, row) for row in new])
    assert len(drawn) == 60


POINTS = {
    "random_forest": [
        {"depth": d, "min_leaf": leaf, "min_split": s, "trees": n} for d in (2, 0) for leaf in (1, 2) for s in (2, 5) for n in (3, 6)
    ],
    "gradient_boosting": [{"depth": 2, "min_split": s, "rate": 0.1, "trees": n} for s in (2, 5) for n in (4, 8)],
}


def test_shared_fits_equal_separate_ones(rows):
    """Every point read from a shared fit has the errors of a grid of that point alone."""
    branched = cut_lineage(grid.branch_rows(rows.where("hotel_id = 2")))
    shared = {(r["method"], r["model"], r["params"], r["fold"]): r["mse"] for r in grid.tree_errors(branched, POINTS).collect()}
    assert len(shared) == 2 * 6 * (16 + 4)
    for model, listed in POINTS.items():
        for point in (listed[0], listed[-1], listed[len(listed) // 2]):
            for r in grid.tree_errors(branched, {model: [point]}).collect():
                assert r["mse"] == pytest.approx(shared[r["method"], model, r["params"], r["fold"]], rel=1e-9)


def test_grid_has_every_point_and_the_choice_is_the_least(rows, linear):
    branched = cut_lineage(grid.branch_rows(rows))
    found = cut_lineage(grid.tree_grid(grid.tree_errors(branched, POINTS)))
    assert found.count() == 3 * 2 * 20
    results = grid.linear_results(rows, linear).unionByName(grid.tree_results(found))
    assert results.count() == 3 * 2 * 5 and results.columns == list(grid.RESULT)
    least = {(r["hotel_id"], r["method"], r["model"]): r["m"] for r in found.groupBy("hotel_id", "method", "model").agg(F.min("cv_mse").alias("m")).collect()}
    for r in results.where(F.col("model").isin(*POINTS)).collect():
        assert r["cv_mse"] == least[r["hotel_id"], r["method"], r["model"]]
    best = {r["hotel_id"]: r["rmse"] for r in grid.best_models(results).collect()}
    assert best == {r["hotel_id"]: r["m"] for r in results.groupBy("hotel_id").agg(F.min("rmse").alias("m")).collect()}


def test_a_family_that_fails_is_one_row_and_the_others_go_on(rows):
    families = {**grid.LINEAR, "ridge": (lambda *a, **k: 1 / 0, ({"alpha": 1.0}, {"alpha": 2.0}))}
    few = rows.where("hotel_id = 1")
    results = grid.linear_results(few, cut_lineage(grid.linear_grid(few, families))).collect()
    assert sorted((r["method"], r["model"], r["status"]) for r in results) == sorted(
        (m, f, "failed" if f == "ridge" else "ok") for m in grid.METHODS for f in grid.LINEAR
    )
    bad = {"gradient_boosting": [{"depth": 2, "min_split": 2, "rate": 0.1, "wrong": 1, "trees": 2}], "random_forest": POINTS["random_forest"][:1]}
    branched = cut_lineage(grid.branch_rows(few))
    trees_of = grid.tree_results(grid.tree_grid(grid.tree_errors(branched, bad))).collect()
    assert {(r["model"], r["status"]) for r in trees_of} == {("gradient_boosting", "failed"), ("random_forest", "ok")}
    assert len(trees_of) == 4 and all(r["error"] for r in trees_of if r["status"] == "failed")


def test_too_few_days_fail_and_do_not_end_the_query(spark, rows):
    few = rows.where("hotel_id = 1").orderBy("date", "copy").limit(3).unionByName(rows.where("hotel_id = 2"))
    found = {(r["hotel_id"], r["status"]) for r in grid.linear_grid(few).collect()}
    assert found == {(1, "failed"), (2, "ok")}
    none = rows.limit(0)
    assert grid.linear_grid(none).count() == 0 and grid.tree_errors(grid.branch_rows(none), POINTS).count() == 0


def test_jobs_do_not_grow_with_properties(spark, rows):
    """Ten times as many properties: the same number of jobs for the linear grid."""

    def jobs(df) -> int:
        group = f"grid-{df.count()}"
        spark.sparkContext.setJobGroup(group, group)
        try:
            grid.linear_grid(df).collect()
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    many = cut_lineage(rows.withColumn("hotel_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.col("hotel_id") + 3 * k))))
    assert jobs(rows) == jobs(many)


def test_moments_are_sums_of_products(spark):
    rng = np.random.default_rng(8)
    data = pd.DataFrame(rng.normal(size=(30, 30)), columns=[TARGET, *FEATURES])
    data.insert(0, "block", [0] * 20 + [1] * 10)
    data.insert(0, "hotel_id", 1)
    got = {r["block"]: grid.matrix(r["moments"]) for r in grid.moments(spark.createDataFrame(data)).collect()}
    for block, m in got.items():
        v = np.column_stack([np.ones((data.block == block).sum()), data[data.block == block][[TARGET, *FEATURES]]])
        np.testing.assert_allclose(m, v.T @ v)
