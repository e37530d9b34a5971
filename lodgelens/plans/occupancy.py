"""Occupancy forecast: feature selection, principal components, model grid with growing folds, best model.

One fit covers one property (``hotel_id=...``) or pools all of them; rows are split and folded per property and
in time order either way, so no window ever spans more than one property's days.  Fits are ordinary Spark ML
jobs over the daily frame, a few of them at a time.

Two ways to prepare the rows:

* ``reference_compatible=True`` keeps three known weaknesses of the original procedure: the scaling is fitted
  before the split, noisy twins are made before the split (a pair can straddle it), and the moving figures of
  the target include the current day.
* ``reference_compatible=False`` (default) splits first, fits the scaling on the train rows only, gives twins
  to train rows only, and ends the moving figures of the target at the day before.
"""

from __future__ import annotations

import functools
import json
import threading
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import product
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import PCA, SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodgelens.functions.columns import rounded
from lodgelens.operators.cells import top_k
from lodgelens.plans.daily import (
    FEATURES,
    SCALED,
    TARGET,
    chronological_split,
    daily_features,
    fold_blocks,
    scaling_statistics,
    with_noisy_twins,
)
from lodgelens.plans.monitor import model_metrics, with_residual
from lodgelens.session import cut_lineage
from lodgelens.tables import HotelTables

Params = dict[str, float]
SELECTED, COMPONENTS = "selected", "pca"
FOLDS = 5
BEST_FEATURES = 20
KEPT_VARIANCE = 0.95
SEED = 42
UNLIMITED_DEPTH = 30  # the deepest tree Spark grows


# -- feature selection -------------------------------------------------------------------------------------


def regression_scores(
    train: DataFrame, by: Sequence[str] = ("hotel_id",), features: Sequence[str] = FEATURES, label: str = TARGET
) -> DataFrame:
    """F statistic of a one-variable regression of the label on each feature, all in one aggregate.

    ``r² / (1 − r²) × (n − 2)``; a constant feature has no correlation and gets no row.
    """
    # corr() raises on a constant feature in ANSI mode; this form gives NULL.
    r = "try_divide(covar_pop({f}, {y}), stddev_pop({f}) * stddev_pop({y})) AS {f}"
    correlations = train.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), *[F.expr(r.format(f=f, y=label)) for f in features]
    )
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("_r")) for f in features])
    square = F.col("_r") * F.col("_r")
    score = F.coalesce(F.try_divide(square, 1 - square) * (F.col("_n") - 2), F.lit(float("inf")))
    return (
        correlations.select(*by, "_n", F.inline(pairs))
        .where(F.col("_r").isNotNull())
        .select(*by, "feature", score.alias("f_score"))
    )


def select_features(train: DataFrame, k: int = BEST_FEATURES, by: Sequence[str] = ("hotel_id",)) -> DataFrame:
    """The ``k`` features with the highest F statistic of each property."""
    return top_k(regression_scores(train, by), by, [F.desc("f_score"), F.asc("feature")], k)


# -- model rows --------------------------------------------------------------------------------------------


def model_rows(
    t: HotelTables,
    hotel_id: int | None = None,
    reference_compatible: bool = False,
    augment: bool = True,
    seed: int = SEED,
    folds: int = FOLDS,
) -> tuple[DataFrame, DataFrame]:
    """Rows with ``role`` and fold ``block``, and the rows the scaling is to be fitted on."""
    days = daily_features(t, include_current=reference_compatible)
    if hotel_id is not None:
        days = days.where(F.col("hotel_id") == hotel_id)
    days = cut_lineage(days)  # read by the scaling and by the rows; one row per day
    order = ("date", "copy")

    def doubled(rows: DataFrame) -> DataFrame:
        return with_noisy_twins(rows, seed) if augment else rows.withColumn("copy", F.lit(0))

    complete = days.na.drop("any")  # a twin lacks exactly the values its original lacks
    if reference_compatible:
        split = chronological_split(doubled(complete), order)
        train = split.where(F.col("role") == "train")
        scaled_on = doubled(days)
    else:
        split = chronological_split(complete.withColumn("copy", F.lit(0)), order)
        train = split.where(F.col("role") == "train")
        if augment:
            train = with_noisy_twins(train.drop("copy", "role"), seed).withColumn("role", F.lit("train"))
        scaled_on = train
    test = split.where(F.col("role") == "test").withColumn("block", F.lit(None).cast("int"))
    columns = ["hotel_id", "date", "copy", "role", "block"]
    numbers = [F.col(c).cast("double").alias(c) for c in (TARGET, *FEATURES)]
    blocked = fold_blocks(train, order, folds)
    return blocked.select(*columns, *numbers).unionByName(test.select(*columns, *numbers)), scaled_on


def scaling_stage(fitted_on: DataFrame) -> SQLTransformer:
    """The standardisation as a stage that is saved with the model: its constants are part of the text.

    The statistics are one row of two numbers per feature.
    """
    row = scaling_statistics(fitted_on).first()
    scaled = [f"(`{f}` - {row[f'{f}__mean']!r}D) / {row[f'{f}__std']!r}D AS `{_stage_name(f)}`" for f in SCALED]
    return SQLTransformer(statement=f"SELECT *, {', '.join(scaled)} FROM __THIS__")


def _stage_name(feature: str) -> str:
    return f"{feature}__z" if feature in SCALED else feature


def _vector(features: Sequence[str], output: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=[_stage_name(f) for f in features], outputCol=output)


def _centred() -> list:
    """All features as one vector with the train mean taken off (Spark's PCA does not centre)."""
    return [
        _vector(FEATURES, "raw_features"),
        StandardScaler(inputCol="raw_features", outputCol="centred", withMean=True, withStd=False),
    ]


_first_decomposition = threading.Lock()


@functools.cache
def _linear_algebra_ready(application: str) -> bool:
    """Run one small decomposition alone: its first use by several threads of a session at once can fail to converge."""
    spark = SparkSession.active()
    rows = spark.createDataFrame([(Vectors.dense(1.0, 2.0),), (Vectors.dense(3.0, 1.0),), (Vectors.dense(0.0, 5.0),)], ["v"])
    PCA(k=2, inputCol="v", outputCol="w").fit(rows)
    return True


def component_variance(train: DataFrame, scaling: SQLTransformer) -> list[float]:
    """Share of variance of every principal component, largest first."""
    with _first_decomposition:
        _linear_algebra_ready(train.sparkSession.sparkContext.applicationId)
    full = PCA(k=len(FEATURES), inputCol="centred", outputCol="features")
    fitted = Pipeline(stages=[scaling, *_centred(), full]).fit(train)
    return [float(v) for v in fitted.stages[-1].explainedVariance]


def components_kept(variance: Sequence[float], share: float = KEPT_VARIANCE) -> int:
    """The least number of components whose variance adds up to more than ``share``."""
    total = 0.0
    for k, v in enumerate(variance, start=1):
        total += v
        if total > share:
            return k
    return len(variance)


def pca_components(t: HotelTables, hotel_id: int | None = None, **options: object) -> DataFrame:
    """Share and running share of variance per component, with those kept; of one property, or of all pooled."""
    rows, scaled_on = model_rows(t, hotel_id, **options)
    rows = cut_lineage(rows)
    variance = component_variance(rows.where(F.col("role") == "train"), scaling_stage(scaled_on))
    kept = components_kept(variance)
    listed = [(k, v, sum(variance[:k]), k <= kept) for k, v in enumerate(variance, start=1)]
    return rows.sparkSession.createDataFrame(
        listed, "component int, variance_share double, running_share double, kept boolean"
    )


# -- models ------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    """A model family: its grid, and how a grid point becomes a Spark ML estimator.

    ``build(point, n, spread)`` gets the number of train rows and the population standard deviation of the
    label, because Spark's penalties are per row and relative to the label's spread.
    """

    build: Callable[[Params, int, float], object]
    grid: Mapping[str, Sequence[float]] = field(default_factory=dict)

    def points(self) -> list[Params]:
        return [dict(zip(self.grid, values)) for values in product(*self.grid.values())]


def _linear(point: Params, n: int, spread: float) -> LinearRegression:
    return LinearRegression(labelCol=TARGET, regParam=0.0)


def _ridge(point: Params, n: int, spread: float) -> LinearRegression:
    return LinearRegression(
        labelCol=TARGET, elasticNetParam=0.0, standardization=False, regParam=point["alpha"] / n * spread
    )


def _elastic_net(point: Params, n: int, spread: float) -> LinearRegression:
    absolute = point["alpha"] * point["l1_ratio"]
    squared = spread * point["alpha"] * (1 - point["l1_ratio"])
    return LinearRegression(
        labelCol=TARGET,
        regParam=absolute + squared,
        elasticNetParam=absolute / (absolute + squared),
        standardization=False,
        maxIter=10000,
        tol=1e-9,
    )


def _forest(point: Params, n: int, spread: float) -> RandomForestRegressor:
    return RandomForestRegressor(
        labelCol=TARGET,
        numTrees=int(point["trees"]),
        maxDepth=int(point["depth"]),
        minInstancesPerNode=int(point["min_leaf"]),
        featureSubsetStrategy="all",
        seed=SEED,
    )


def _boosting(point: Params, n: int, spread: float) -> GBTRegressor:
    return GBTRegressor(
        labelCol=TARGET,
        maxIter=int(point["trees"]),
        stepSize=point["rate"],
        maxDepth=int(point["depth"]),
        seed=SEED,
    )


# The model families and their grids.
MODELS: dict[str, Model] = {
    "linear_regression": Model(_linear),
    "ridge": Model(_ridge, {"alpha": (0.1, 1.0, 10.0)}),
    "elastic_net": Model(_elastic_net, {"alpha": (0.1, 0.5, 1.0), "l1_ratio": (0.1, 0.5, 0.9)}),
    "random_forest": Model(
        _forest, {"trees": (100, 200), "depth": (10, 20, UNLIMITED_DEPTH), "min_leaf": (1, 2)}
    ),
    "gradient_boosting": Model(_boosting, {"trees": (100, 200), "rate": (0.01, 0.1), "depth": (3, 5)}),
}


def with_grid(name: str, **grid: Sequence[float]) -> Model:
    """A family with another grid, e.g. a smaller one."""
    return Model(MODELS[name].build, grid)


RESULT_SCHEMA = T.StructType(
    [
        T.StructField("method", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("rmse", T.DoubleType()),
        T.StructField("r2", T.DoubleType()),
        T.StructField("mae", T.DoubleType()),
        T.StructField("cv_mse", T.DoubleType()),
        T.StructField("best_params", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)


@dataclass
class OccupancyFit:
    """Outcome of :func:`fit_occupancy`."""

    rows: DataFrame
    results: DataFrame
    features: list[str]
    components: int
    pipelines: dict[tuple[str, str], PipelineModel]

    def best(self) -> tuple[str, str]:
        """Method and model with the least error; selected features win only if strictly better."""
        row = best_model(self.results).first()
        return row["method"], row["model"]

    def predictions(self, method: str | None = None, model: str | None = None, role: str = "test") -> DataFrame:
        """``prediction``, ``label`` and ``residual`` of a model on the rows of a role; the best by default."""
        key = self.best() if method is None else (method, model)
        scored = self.pipelines[key].transform(self.rows.where(F.col("role") == role))
        return with_residual(scored.select("hotel_id", "date", "copy", "prediction", F.col(TARGET).alias("label")))

    def save_best(self, path: str) -> None:
        """Save the best model with its scaling and its feature choice or components, ready to score new days."""
        self.pipelines[self.best()].write().overwrite().save(path)


def best_model(results: DataFrame) -> DataFrame:
    usable = results.where(F.col("status") == "ok")
    return usable.orderBy("rmse", F.when(F.col("method") == COMPONENTS, 0).otherwise(1), "model").limit(1)


def result_table(results: DataFrame, decimals: int = 3) -> DataFrame:
    """The metrics as shown in reports."""
    return results.select("method", "model", *[rounded(m, decimals).alias(m) for m in ("rmse", "r2", "mae")])


def per_hotel(t: HotelTables, run: Callable[[int], DataFrame], parallelism: int = 3) -> DataFrame:
    """The union of ``run(hotel_id)`` over all properties with daily visitors, with ``hotel_id`` as first column.

    Every property has its own scaling, features, components and models; a few are fitted at a time.
    """
    ids = [r["hotel_id"] for r in t.datepicker_daily_visitors.select("hotel_id").distinct().orderBy("hotel_id").collect()]

    def one(hotel_id: int) -> DataFrame:
        frame = run(hotel_id)
        return frame.select(F.lit(hotel_id).alias("hotel_id"), *frame.columns)

    spark = t.datepicker_daily_visitors.sparkSession
    parts = _run_parallel(spark, [lambda i=i: one(i) for i in ids], parallelism)
    return reduce(DataFrame.unionByName, parts)


def _run_parallel(spark, tasks: Sequence[Callable[[], object]], parallelism: int) -> list:
    """Run a few independent Spark jobs at a time, each under the caller's job properties."""
    pool = ThreadPool(processes=max(1, min(parallelism, len(tasks))))
    try:
        return pool.map(inheritable_thread_target(spark)(lambda task: task()), tasks)
    finally:
        pool.close()


def _grid_search(
    model: Model, train: DataFrame, sizes: Mapping[int, tuple[int, float]], folds: int, parallelism: int
) -> tuple[Params, float]:
    """Grid point with the least mean squared error over growing folds: fold i trains below block i."""
    points = model.points()
    evaluator = RegressionEvaluator(labelCol=TARGET, metricName="mse")

    def score(point: Params, fold: int) -> float:
        fitted = model.build(point, *sizes[fold]).fit(train.where(F.col("block") < fold))
        return evaluator.evaluate(fitted.transform(train.where(F.col("block") == fold)))

    tasks = [lambda p=p, i=i: score(p, i) for p in points for i in range(folds)]
    errors = _run_parallel(train.sparkSession, tasks, parallelism)
    means = [sum(errors[i * folds : (i + 1) * folds]) / folds for i in range(len(points))]
    best = min(range(len(points)), key=means.__getitem__)
    return points[best], means[best]


def _train_sizes(train: DataFrame, folds: int) -> dict[int, tuple[int, float]]:
    """Rows and label spread of each fold's train part, and under ``folds`` of all train rows; one small job."""
    upto = [F.when(F.col("block") < i, F.col(TARGET)) for i in range(folds + 1)]
    row = train.agg(
        *[F.count(c).alias(f"n{i}") for i, c in enumerate(upto)],
        *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(upto)],
    ).first()
    return {i: (row[f"n{i}"], row[f"s{i}"]) for i in range(folds + 1)}


def fit_occupancy(
    t: HotelTables,
    hotel_id: int | None = None,
    models: Mapping[str, Model] = MODELS,
    reference_compatible: bool = False,
    augment: bool = True,
    folds: int = FOLDS,
    best_features: int = BEST_FEATURES,
    kept_variance: float = KEPT_VARIANCE,
    seed: int = SEED,
    parallelism: int = 4,
    methods: Sequence[str] = (SELECTED, COMPONENTS),
    search: bool = True,
) -> OccupancyFit:
    """Fit every model family on selected features and on principal components, and score them on the test rows.

    The rows are written once to the checkpoint folder; all fits read them from there.  A family that fails is
    reported in its result row and the others go on.  ``search=False`` fits families of a single grid point at that
    point, without folds (``cv_mse`` is NULL).
    """
    if not search and any(len(model.points()) != 1 for model in models.values()):
        raise ValueError("without a search, every family needs exactly one grid point")
    planned, scaled_on = model_rows(t, hotel_id, reference_compatible, augment, seed, folds)
    rows = cut_lineage(planned)
    train = rows.where(F.col("role") == "train")
    test = rows.where(F.col("role") == "test")
    scaling = scaling_stage(scaled_on)
    sizes = _train_sizes(train, folds)

    features = [r["feature"] for r in select_features(train, best_features, by=()).orderBy("rank").collect()]
    branches, components = {SELECTED: [scaling, _vector(features)]}, 0
    results, pipelines = [], {}
    if COMPONENTS in methods:
        try:
            components = components_kept(component_variance(train, scaling), kept_variance)
            branches[COMPONENTS] = [scaling, *_centred(), PCA(k=components, inputCol="centred", outputCol="features")]
        except Exception as failure:  # the other features must not suffer from it
            results += [(COMPONENTS, name, None, None, None, None, None, "failed", str(failure)) for name in models]

    for method in [m for m in methods if m in branches]:
        prepared = Pipeline(stages=branches[method]).fit(train)
        columns = ["hotel_id", "block", TARGET, "features"]
        vectors = prepared.transform(train).select(*columns).persist()
        try:
            for name, model in models.items():
                try:
                    if search:
                        point, error = _grid_search(model, vectors, sizes, folds, parallelism)
                    else:
                        point, error = model.points()[0], None
                    fitted = model.build(point, *sizes[folds]).fit(vectors)
                    pipelines[method, name] = PipelineModel(stages=[*prepared.stages, fitted])
                    scored = fitted.transform(prepared.transform(test))
                    metrics = model_metrics(scored.withColumnRenamed(TARGET, "label"), by=()).first()
                    shown = json.dumps(point, sort_keys=True)
                    results.append(
                        (method, name, metrics["rmse"], metrics["r2"], metrics["mae"], error, shown, "ok", None)
                    )
                except Exception as failure:  # one family must not end the others
                    results.append((method, name, None, None, None, None, None, "failed", str(failure)))
        finally:
            vectors.unpersist()
    frame = rows.sparkSession.createDataFrame(results, RESULT_SCHEMA)
    return OccupancyFit(rows, frame, features, components, pipelines)
