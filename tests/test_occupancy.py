import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from conftest import TESTDATA
from lodgelens.plans import occupancy
from lodgelens.plans.daily import TARGET
from lodgelens.sources.sample_views import load_views


@pytest.fixture(scope="module")
def problem(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 4))
    y = x @ [3.0, -2.0, 0.0, 0.5] + 7 + rng.normal(scale=0.5, size=120)
    names = list("abcd")
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], names + [TARGET])
    return x, y, VectorAssembler(inputCols=names, outputCol="features").transform(df)


@pytest.mark.parametrize("alpha", [0.1, 1.0, 10.0])
def test_ridge_equals_the_closed_form(problem, alpha):
    x, y, df = problem
    fitted = occupancy.MODELS["ridge"].build({"alpha": alpha}, len(y), float(y.std())).fit(df)
    xc, yc = x - x.mean(0), y - y.mean()
    expected = np.linalg.solve(xc.T @ xc + alpha * np.eye(4), xc.T @ yc)
    np.testing.assert_allclose(fitted.coefficients.toArray(), expected, rtol=1e-8)
    assert fitted.intercept == pytest.approx(y.mean() - x.mean(0) @ expected)


@pytest.mark.parametrize("alpha, l1_ratio", [(0.1, 0.1), (0.5, 0.5), (1.0, 0.9)])
def test_elastic_net_equals_coordinate_descent(problem, alpha, l1_ratio):
    x, y, df = problem
    n = len(y)
    fitted = occupancy.MODELS["elastic_net"].build({"alpha": alpha, "l1_ratio": l1_ratio}, n, float(y.std())).fit(df)
    xc, yc, w = x - x.mean(0), y - y.mean(), np.zeros(4)
    for _ in range(3000):
        for j in range(4):
            rho = xc[:, j] @ (yc - xc @ w + xc[:, j] * w[j]) / n
            w[j] = np.sign(rho) * max(abs(rho) - alpha * l1_ratio, 0) / (xc[:, j] @ xc[:, j] / n + alpha * (1 - l1_ratio))
    np.testing.assert_allclose(fitted.coefficients.toArray(), w, atol=1e-6)


def test_grids():
    sizes = {name: len(model.points()) for name, model in occupancy.MODELS.items()}
    assert sizes == {"linear_regression": 1, "ridge": 3, "elastic_net": 9, "random_forest": 12, "gradient_boosting": 8}


def test_scores_equal_numpy_and_skip_constants(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(50, 2))
    y = x[:, 0] * 2 + rng.normal(size=50)
    df = spark.createDataFrame([(1, float(a), float(b), 5.0, float(v)) for (a, b), v in zip(x, y)], "hotel_id int, a double, b double, k double, fill_rate double")
    got = {r["feature"]: r["f_score"] for r in occupancy.regression_scores(df, features=["a", "b", "k"]).collect()}
    r = [np.corrcoef(x[:, i], y)[0, 1] for i in (0, 1)]
    assert got == pytest.approx({"a": r[0] ** 2 / (1 - r[0] ** 2) * 48, "b": r[1] ** 2 / (1 - r[1] ** 2) * 48})


def test_components_kept():
    assert occupancy.components_kept([0.6, 0.3, 0.06, 0.04]) == 3
    assert occupancy.components_kept([0.96, 0.04]) == 1
    assert occupancy.components_kept([0.5, 0.5], 1.0) == 2


@pytest.fixture(scope="module")
def fit(spark):
    models = {
        "linear_regression": occupancy.MODELS["linear_regression"],
        "ridge": occupancy.with_grid("ridge", alpha=(1.0, 1000.0)),
        "gradient_boosting": occupancy.with_grid("gradient_boosting", trees=(3,), rate=(0.1,), depth=(2,)),
        "random_forest": occupancy.with_grid("random_forest", trees=(2,), depth=(99,), min_leaf=(1,)),  # refused
    }
    return occupancy.fit_occupancy(load_views(spark, TESTDATA), hotel_id=1, models=models, best_features=8)


def test_results_and_failures(fit):
    rows = {(r["method"], r["model"]): r for r in fit.results.collect()}
    assert len(rows) == 8 and len(fit.features) == 8 and 1 <= fit.components <= 29
    for (method, model), row in rows.items():
        assert row["status"] == ("failed" if model == "random_forest" else "ok")
        assert (row["rmse"] is None) == (model == "random_forest")
    assert occupancy.result_table(fit.results).columns == ["method", "model", "rmse", "r2", "mae"]


def test_best_is_saved_and_scores_again(spark, fit, tmp_path):
    method, model = fit.best()
    best = fit.results.where((F.col("method") == method) & (F.col("model") == model)).first()
    assert best["rmse"] == fit.results.agg(F.min("rmse")).first()[0]
    predicted = fit.predictions()
    rmse = predicted.select(F.sqrt(F.avg(F.col("residual") ** 2))).first()[0]
    assert rmse == pytest.approx(best["rmse"])
    fit.save_best(str(tmp_path / "best"))
    test = fit.rows.where("role = 'test'")
    again = PipelineModel.load(str(tmp_path / "best")).transform(test).orderBy("date", "copy").select("prediction").collect()
    assert again == predicted.orderBy("date", "copy").select("prediction").collect()


def test_components_that_fail_leave_the_selected_features(spark, monkeypatch):
    def fails(*_):
        raise ValueError("no convergence")

    monkeypatch.setattr(occupancy, "component_variance", fails)
    models = {"linear_regression": occupancy.MODELS["linear_regression"]}
    fit = occupancy.fit_occupancy(load_views(spark, TESTDATA), hotel_id=1, models=models, best_features=3, folds=2)
    rows = {r["method"]: (r["status"], r["error"]) for r in fit.results.collect()}
    assert rows == {"pca": ("failed", "no convergence"), "selected": ("ok", None)}


def test_a_tie_goes_to_components(spark):
    rows = [("selected", "ridge", 2.0, "ok"), ("pca", "ridge", 2.0, "ok"), ("pca", "lr", None, "failed")]
    results = spark.createDataFrame(rows, "method string, model string, rmse double, status string")
    assert occupancy.best_model(results).first()["method"] == "pca"


def test_preparation_modes(spark):
    t = load_views(spark, TESTDATA)
    kept, _ = occupancy.model_rows(t, hotel_id=2, reference_compatible=True)
    clean, _ = occupancy.model_rows(t, hotel_id=2)
    count = lambda df, role: df.where(F.col("role") == role).groupBy("copy").count().collect()
    assert {r["copy"] for r in count(kept, "test")} == {0, 1}  # twins in the test part, as in the original
    assert {r["copy"] for r in count(clean, "test")} == {0}
    train = {r["copy"]: r["count"] for r in count(clean, "train")}
    assert train[0] == train[1]
