"""Model choice for all properties in one go: every grid point, fold, feature branch and property of the occupancy model.

The number of Spark jobs does not grow with properties, grid points or folds.

* Linear families come from ``moments``: the sums of products of every pair of columns, per property and fold block, in
  one aggregate.  Running sums over blocks are the train sides of all growing folds, and a feature branch (selected
  features, principal components) is a linear map of the moments, so no row is read again for a fit or an error.
* Trees see rows.  A task has the days of one property, one branch, one fold and one setting that cannot be shared
  (``operators.trees``); the other settings are read from the same fit.

One result row per property, branch, family and grid point tells the folds' mean squared error; the best point's errors
on the test days stand in ``chosen``.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodgelens.operators import trees
from lodgelens.operators.cells import top_k
from lodgelens.plans.daily import (
    FEATURES,
    TARGET,
    chronological_split,
    daily_features,
    fold_blocks,
    standardised,
    with_noisy_twins,
)
from lodgelens.plans.monitor import model_metrics
from lodgelens.session import cut_lineage
from lodgelens.tables import HotelTables

SELECTED, COMPONENTS = "selected", "pca"
METHODS = (SELECTED, COMPONENTS)
FOLDS = 5
BEST_FEATURES = 20
KEPT_VARIANCE = 0.95
SEED = 42
MOST_TASKS = 20_000
TEST_BLOCK = FOLDS  # block number of the test days; below are the growing folds' blocks, from -1 on

# The grids.  A depth of 0 has no limit.
RIDGE = (0.1, 1.0, 10.0)
ELASTIC_NET = tuple(product((0.1, 0.5, 1.0), (0.1, 0.5, 0.9)))
TREES = (100, 200)
FOREST_DEPTHS, MIN_LEAVES = (10, 20, None), (1, 2)
RATES, BOOST_DEPTHS = (0.01, 0.1), (3, 5)
MIN_SPLITS = (2, 5)

COLUMNS = ("one", TARGET, *FEATURES)  # what moments are taken of
PAIRS = [(i, j) for i in range(len(COLUMNS)) for j in range(i, len(COLUMNS))]


# -- rows and moments ----------------------------------------------------------------------------------------


def model_rows(t: HotelTables, reference_compatible: bool = True, augment: bool = True, seed: int = SEED) -> DataFrame:
    """Scaled rows of all properties: ``hotel_id``, ``date``, ``copy``, ``block``, the target and the features.

    ``reference_compatible`` scales and adds noisy twins before the split, and lets the target's moving figures include
    the day; otherwise the split comes first, twins and scaling belong to the train days, and moving figures end the day
    before.  Days with a missing figure are left out.  Every window is one property's days.
    """
    order = ("date", "copy")
    doubled = lambda rows: with_noisy_twins(rows, seed) if augment else rows.withColumn("copy", F.lit(0))
    days = daily_features(t, include_current=reference_compatible)
    complete = " AND ".join(f"{c} IS NOT NULL" for c in (TARGET, *FEATURES))
    if reference_compatible:
        rows = standardised(doubled(days).withColumn("complete", F.expr(complete))).where("complete").drop("complete")
        split = chronological_split(rows, order)
    else:
        single = chronological_split(days.where(complete))
        train = doubled(single.where(F.col("role") == "train").drop("role")).withColumn("role", F.lit("train"))
        test = single.where(F.col("role") == "test").withColumn("copy", F.lit(0))
        split = standardised(train.unionByName(test), "role = 'train'")
    blocked = fold_blocks(split.where(F.col("role") == "train"), order, FOLDS)
    tested = split.where(F.col("role") == "test").withColumn("block", F.lit(TEST_BLOCK))
    numbers = [F.col(c).cast("double").alias(c) for c in (TARGET, *FEATURES)]
    columns = ["hotel_id", "date", "copy", F.col("block").cast("int").alias("block"), *numbers]
    return blocked.select(*columns).unionByName(tested.select(*columns))


def moments(rows: DataFrame) -> DataFrame:
    """Per property and block, the sums of products of all pairs of ``COLUMNS`` as one array, in one aggregate."""
    name = lambda i: "1D" if i == 0 else f"`{COLUMNS[i]}`"
    sums = ", ".join(f"sum({name(i)} * {name(j)})" for i, j in PAIRS)
    return rows.groupBy("hotel_id", "block").agg(F.expr(f"array({sums})").alias("moments"))


def moment_list(moments_: DataFrame) -> DataFrame:
    """One row per property, block and pair of columns, with the sum of their products over the block's rows."""
    names = F.array(*[F.struct(F.lit(COLUMNS[i]).alias("a"), F.lit(COLUMNS[j]).alias("b")) for i, j in PAIRS])
    listed = moments_.select("hotel_id", "block", F.posexplode("moments").alias("place", "value"))
    return listed.withColumn("pair", F.element_at(names, F.col("place") + 1)).select(
        "hotel_id", "block", "pair.a", "pair.b", "value"
    )


def covariances(rows: DataFrame) -> DataFrame:
    """Sample covariance of every pair of features over each property's train days, from the moments.

    Sums of blocks are sums over the train days; ``(Sab - Sa Sb / n) / (n - 1)``.
    """
    summed = moments(rows.where(F.col("block") < TEST_BLOCK)).select("hotel_id", F.posexplode("moments").alias("place", "value"))
    totals = summed.groupBy("hotel_id", "place").agg(F.sum("value").alias("value"))
    arrays = totals.groupBy("hotel_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("m")
    )  # one entry per pair of columns
    at = {pair: n for n, pair in enumerate(PAIRS)}
    pairs = F.array(
        *[
            F.struct(
                F.lit(COLUMNS[i]).alias("a"), F.lit(COLUMNS[j]).alias("b"),
                F.lit(at[0, i]).alias("sum_a"), F.lit(at[0, j]).alias("sum_b"), F.lit(at[i, j]).alias("products"),
            )
            for i, j in PAIRS
            if i >= 2
        ]
    )
    n = F.get("m", F.lit(0))
    cells = F.transform(
        pairs,
        lambda p: F.struct(
            p.a.alias("a"),
            p.b.alias("b"),
            F.try_divide(F.get("m", p.products) - F.get("m", p.sum_a) * F.get("m", p.sum_b) / n, n - 1).alias("covariance"),
        ),
    )
    return arrays.select("hotel_id", F.inline(cells))


# -- linear families -------------------------------------------------------------------------------------------


def matrix(values: Sequence[float]) -> np.ndarray:
    out = np.zeros((len(COLUMNS), len(COLUMNS)))
    out[tuple(np.array(PAIRS).T)] = values
    return out + np.triu(out, 1).T


def scores(m: np.ndarray) -> np.ndarray:
    """F statistic of the regression of the target on each feature; NaN for a constant one."""
    n, s = m[0, 0], m[0]
    c = m - np.outer(s, s) / n
    with np.errstate(divide="ignore", invalid="ignore"):
        square = c[1, 2:] ** 2 / (c[1, 1] * np.where(np.diag(c)[2:] > 1e-9 * np.diag(m)[2:], np.diag(c)[2:], np.nan))
        return square / (1 - square) * (n - 2)


def selected(m: np.ndarray, best: int = BEST_FEATURES) -> list[int]:
    """Positions in ``COLUMNS`` of the features with the highest scores, ties by name."""
    score = scores(m)
    ranked = sorted((-score[i], name, i + 2) for i, name in enumerate(FEATURES) if not np.isnan(score[i]))
    return [i for _, _, i in ranked[:best]]


def components(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean of the features, all principal axes as columns, and their variances, largest first.

    The largest entry of an axis (of equal ones the first) is positive.
    """
    n, mean = m[0, 0], m[0, 2:] / m[0, 0]
    variance, axes = np.linalg.eigh((m[2:, 2:] - n * np.outer(mean, mean)) / (n - 1))
    axes, variance = axes[:, ::-1], np.maximum(variance[::-1], 0.0)
    size = np.abs(axes)
    first = (size >= size.max(0) * (1 - 1e-9)).argmax(0)
    return mean, axes * np.where(axes[first, np.arange(len(first))] < 0, -1.0, 1.0), variance


def components_kept(variance: np.ndarray, share: float = KEPT_VARIANCE) -> int:
    """The least number of components whose variance adds up to more than ``share``."""
    running = np.cumsum(variance) / variance.sum()
    return min(int(np.searchsorted(running, share, side="right")) + 1, len(variance))


def branch(m: np.ndarray, method: str) -> np.ndarray:
    """The linear map from ``COLUMNS`` to (one, target, model features), fitted on the train moments ``m``."""
    if method == SELECTED:
        rows = [0, 1, *selected(m)]
        return np.eye(len(COLUMNS))[rows]
    mean, axes, variance = components(m)
    axes = axes[:, : components_kept(variance)]
    out = np.zeros((2 + axes.shape[1], len(COLUMNS)))
    out[0, 0] = out[1, 1] = 1.0
    out[2:, 2:], out[2:, 0] = axes.T, -mean @ axes
    return out


def least_squares(xx: np.ndarray, xy: np.ndarray, n: float) -> np.ndarray:
    try:
        low = np.linalg.cholesky(xx)
        if np.diag(low).min() > 1e-6 * np.diag(low).max():
            return np.linalg.solve(low.T, np.linalg.solve(low, xy))
    except np.linalg.LinAlgError:
        pass
    return np.linalg.lstsq(xx, xy, rcond=1e-12)[0]  # columns that depend on each other: the shortest solution


def ridge(xx: np.ndarray, xy: np.ndarray, n: float, alpha: float) -> np.ndarray:
    low = np.linalg.cholesky(xx + alpha * np.eye(len(xx)))
    return np.linalg.solve(low.T, np.linalg.solve(low, xy))


def elastic_net(xx: np.ndarray, xy: np.ndarray, n: float, alpha: float, l1_ratio: float, tol: float = 1e-12) -> np.ndarray:
    """Coordinate descent on the covariances, for |y - Xb|² / 2n + alpha (l1_ratio |b|₁ + (1 - l1_ratio) |b|² / 2)."""
    b, pull = np.zeros(len(xy)), xy / n
    gram, soft = xx / n, alpha * l1_ratio
    scale = np.diag(gram) + alpha * (1 - l1_ratio)
    for _ in range(10_000):
        most = 0.0
        for j in range(len(b)):
            if scale[j] <= 0:
                continue
            rho = pull[j] + gram[j, j] * b[j]
            step = np.sign(rho) * max(abs(rho) - soft, 0.0) / scale[j] - b[j]
            if step:
                b[j] += step
                pull = pull - gram[j] * step
                most = max(most, abs(step))
        if most < tol * max(1.0, np.abs(b).max(initial=0.0)):
            break
    return b


Families = Mapping[str, tuple[Callable[..., np.ndarray], Sequence[dict]]]
LINEAR: Families = {
    "linear_regression": (least_squares, ({},)),
    "ridge": (ridge, tuple({"alpha": a} for a in RIDGE)),
    "elastic_net": (elastic_net, tuple({"alpha": a, "l1_ratio": r} for a, r in ELASTIC_NET)),
}


def fitted(m: np.ndarray, fit: Callable[..., np.ndarray], point: dict) -> np.ndarray:
    """Intercept, 0 for the target, and coefficients, from moments of (one, target, features)."""
    n, s = m[0, 0], m[0, 1:]
    c = m[1:, 1:] - np.outer(s, s) / n
    b = fit(c[1:, 1:], c[1:, 0], n, **point)
    return np.concatenate([[(s[0] - b @ s[1:]) / n, 0.0], b])


def mean_square(m: np.ndarray, b: np.ndarray) -> float:
    residual = -b
    residual[1] = 1.0
    return float(residual @ m @ residual / m[0, 0])


def shown(point: dict) -> str:
    return json.dumps(point, sort_keys=True)


def names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def dealt(df: DataFrame, keys: Sequence[str], tasks: int) -> DataFrame:
    """Rows by keys in as many partitions as there are groups to work on: they are small, and the work in them is not."""
    return df.repartition(max(1, min(tasks, MOST_TASKS)), *keys)


def _properties(rows: DataFrame) -> int:
    return rows.select("hotel_id").distinct().count()


LINEAR_GRID = (
    "hotel_id long, method string, model string, place int, params string, cv_mse double, fold_mse array<double>, "
    "coefficients array<double>, status string, error string"
)


def _linear_rows(group: pd.DataFrame, families: Families) -> Iterator[tuple]:
    by_block = {row.block: matrix(row.moments) for row in group.itertuples() if row.block < TEST_BLOCK}
    upto = [sum((m for b, m in by_block.items() if b < fold), np.zeros((len(COLUMNS),) * 2)) for fold in range(FOLDS + 1)]
    for method in METHODS:
        for model, (fit, points) in families.items():
            for place, point in enumerate(points):
                head = (method, model, place, shown(point))
                try:
                    to = branch(upto[FOLDS], method)
                    train = [to @ m @ to.T for m in upto]
                    tests = [to @ by_block[fold] @ to.T for fold in range(FOLDS)]
                    errors = [mean_square(tests[i], fitted(train[i], fit, point)) for i in range(FOLDS)]
                    b = fitted(train[FOLDS], fit, point) @ to
                    yield *head, float(np.mean(errors)), errors, b.tolist(), "ok", None
                except Exception as error:  # a family that fails must not end the others
                    yield *head, None, None, None, "failed", str(error) or type(error).__name__


def linear_grid(rows: DataFrame, families: Families = LINEAR) -> DataFrame:
    """``LINEAR_GRID``: all points of the linear families per property and branch, with the errors of the growing folds.

    ``coefficients`` (of ``COLUMNS``; the first is the intercept, the target's is 0) are those of a fit on all train days.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        hotel_id = group.hotel_id.iloc[0]
        return pd.DataFrame([(hotel_id, *row) for row in _linear_rows(group, families)], columns=names(LINEAR_GRID))

    return dealt(moments(rows), ["hotel_id"], _properties(rows)).groupBy("hotel_id").applyInPandas(run, LINEAR_GRID)


def principal_components(rows: DataFrame) -> DataFrame:
    """Variance, its share and running share per property and component, whether it is kept, and its axis."""
    schema = (
        "hotel_id long, component int, variance double, variance_share double, running_share double, kept boolean, "
        "axis array<double>"
    )

    def run(group: pd.DataFrame) -> pd.DataFrame:
        _, axes, variance = components(sum(matrix(m) for m in group.moments))
        share = variance / variance.sum()
        out = pd.DataFrame({"component": np.arange(1, len(share) + 1), "variance": variance, "variance_share": share})
        out["running_share"] = share.cumsum()
        out["kept"] = out.component <= components_kept(variance)
        out["axis"] = list(axes.T)
        out.insert(0, "hotel_id", group.hotel_id.iloc[0])
        return out

    return moments(rows.where(F.col("block") < TEST_BLOCK)).groupBy("hotel_id").applyInPandas(run, schema)


# -- trees -----------------------------------------------------------------------------------------------------


BRANCHES = "hotel_id long, method string, map array<array<double>>"


def branch_rows(rows: DataFrame) -> DataFrame:
    """Every row once per branch with its model features: ``hotel_id``, ``date``, ``copy``, ``block``, ``method``, ``label``,
    ``features``.  The branches are fitted on the moments of all train days."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(matrix(m) for m in group.moments)
        maps = [branch(total, method)[2:].tolist() for method in METHODS]
        return pd.DataFrame({"hotel_id": group.hotel_id.iloc[0], "method": METHODS, "map": maps})

    fitted_on = moments(rows.where(F.col("block") < TEST_BLOCK))
    maps = fitted_on.groupBy("hotel_id").applyInPandas(run, BRANCHES)
    values = F.array(F.lit(1.0), *[F.col(c) for c in COLUMNS[1:]])
    placed = rows.select("hotel_id", "date", "copy", "block", F.col(TARGET).alias("label"), values.alias("values")).join(maps, "hotel_id")
    product_of = lambda weights: F.aggregate(
        F.zip_with(weights, "values", lambda a, b: a * b), F.lit(0.0), lambda total, x: total + x
    )
    return placed.select(
        "hotel_id", "date", "copy", "block", "method", "label", F.transform("map", product_of).alias("features")
    )


TREE_GRID = (
    "hotel_id long, method string, model string, fold int, place int, params string, mse double, mae double, r2 double, "
    "status string, error string"
)
FOREST_POINTS = [
    {"depth": d or 0, "min_leaf": leaf, "min_split": split, "trees": n}
    for d, leaf, split, n in product(FOREST_DEPTHS, MIN_LEAVES, MIN_SPLITS, TREES)
]
BOOSTING_POINTS = [
    {"depth": d, "min_split": split, "rate": r, "trees": n} for r, d, split, n in product(RATES, BOOST_DEPTHS, MIN_SPLITS, TREES)
]
TREE_POINTS = {"random_forest": FOREST_POINTS, "gradient_boosting": BOOSTING_POINTS}
SHARED = {"random_forest": ("depth", "min_split", "trees"), "gradient_boosting": ("trees",)}  # read from one fit


def _settings(model: str, points: Sequence[dict]) -> list[dict]:
    """What the fits of a family differ in."""
    kept = [{k: v for k, v in point.items() if k not in SHARED[model]} for point in points]
    return [setting for n, setting in enumerate(kept) if setting not in kept[:n]]


def _predictions(model: str, setting: dict, points: Sequence[dict], x: np.ndarray, y: np.ndarray, test: np.ndarray):
    """Grid point and predictions of all ``points`` that share a setting."""
    counts = sorted({p["trees"] for p in points})
    if model == "random_forest":
        depths = sorted({p["depth"] or None for p in points}, key=lambda d: d or float("inf"))
        splits = sorted({p["min_split"] for p in points})
        return trees.forest_scores(x, y, test, counts, depths, splits, seed=SEED, **setting)
    return trees.boosting_scores(x, y, test, counts, **setting)


def tree_errors(branched: DataFrame, points: Mapping[str, Sequence[dict]] = TREE_POINTS) -> DataFrame:
    """``TREE_GRID``: errors of every grid point per property, branch, family and fold, from :func:`branch_rows`.

    Fold ``FOLDS`` trains on all train days and is tested on the test days.  A task of the cluster has one property's
    days for one branch, fold and setting, and grows as many trees as the largest point asks for.
    """
    keys = ["hotel_id", "method", "fold", "model", "setting"]
    tasks = [
        F.struct(F.lit(fold).alias("fold"), F.lit(model).alias("model"), F.lit(shown(setting)).alias("setting"))
        for fold in range(FOLDS + 1)
        for model, listed in points.items()
        for setting in _settings(model, listed)
    ]
    copies = branched.select("*", F.inline(F.array(*tasks))).where(F.col("block") <= F.col("fold"))

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        hotel_id, method, fold, model, text = key
        places = {shown(point): place for place, point in enumerate(points[model])}
        head, out = (hotel_id, method, model, fold), []
        try:
            data = group.sort_values(["date", "copy"])
            x, y, tests = np.stack(data.features), data.label.to_numpy(float), (data.block == fold).to_numpy()
            if tests.all() or not tests.any():
                raise ValueError("too few days for this fold")
            setting = json.loads(text)
            mine = [p for p in points[model] if setting.items() <= p.items()]
            spread = y[tests].var()
            for point, told in _predictions(model, setting, mine, x[~tests], y[~tests], x[tests]):
                off = y[tests] - told
                square = float((off**2).mean())
                r2 = 1 - square / spread if spread > 0 else None
                if shown(point) in places:
                    out.append((*head, places[shown(point)], shown(point), square, float(np.abs(off).mean()), r2, "ok", None))
        except Exception as error:  # a family that fails must not end the others
            out = [(*head, None, text, None, None, None, "failed", str(error) or type(error).__name__)]
        return pd.DataFrame(out, columns=names(TREE_GRID))

    groups = _properties(branched) * len(METHODS) * len(tasks)
    return dealt(copies, keys, groups).groupBy(*keys).applyInPandas(run, TREE_GRID)


def tree_grid(errors: DataFrame) -> DataFrame:
    """One row per property, branch, family and grid point: ``cv_mse`` over the folds, and ``rmse``, ``mae``, ``r2`` of the
    test days after a fit on all train days.  A family of which any task failed is there once, as failed."""
    keys = ["hotel_id", "method", "model"]
    failed = errors.where("status = 'failed'").groupBy(*keys).agg(F.min("error").alias("error"))
    final = F.col("fold") == FOLDS
    good = errors.join(failed, keys, "left_anti").groupBy(*keys, "place", "params").agg(
        F.avg(F.when(~final, F.col("mse"))).alias("cv_mse"),
        F.sqrt(F.max(F.when(final, F.col("mse")))).alias("rmse"),
        F.max(F.when(final, F.col("mae"))).alias("mae"),
        F.max(F.when(final, F.col("r2"))).alias("r2"),
    )
    none = F.lit(None)
    listed = good.select(*keys, "place", "params", "cv_mse", "rmse", "mae", "r2", F.lit("ok").alias("status"), none.cast("string").alias("error"))
    numbers = [none.cast("double").alias(c) for c in ("cv_mse", "rmse", "mae", "r2")]
    return listed.unionByName(
        failed.select(*keys, none.cast("int").alias("place"), none.cast("string").alias("params"), *numbers, F.lit("failed").alias("status"), "error")
    )


# -- choice ----------------------------------------------------------------------------------------------------


def linear_predictions(rows: DataFrame, grid: DataFrame) -> DataFrame:
    """Predictions for the test days by the rows of :func:`linear_grid` that fitted: the grid's keys with ``date``,
    ``copy``, ``prediction``, ``label``."""
    values = F.array(F.lit(1.0), F.lit(0.0), *[F.col(c) for c in FEATURES])
    tested = rows.where(F.col("block") == TEST_BLOCK).select("hotel_id", "date", "copy", F.col(TARGET).alias("label"), values.alias("values"))
    told = F.aggregate(F.zip_with("coefficients", "values", lambda a, b: a * b), F.lit(0.0), lambda total, x: total + x)
    fits = grid.where("status = 'ok'").select("hotel_id", "method", "model", "place", "coefficients")
    return tested.join(fits, "hotel_id").select(
        "hotel_id", "method", "model", "place", "date", "copy", told.alias("prediction"), "label"
    )


def best_points(grid: DataFrame) -> DataFrame:
    """The point with the least ``cv_mse`` per property, branch and family (the first of equal ones); failed families stay."""
    order = Window.partitionBy("hotel_id", "method", "model").orderBy(F.asc_nulls_last("cv_mse"), "place")
    return grid.withColumn("choice", F.row_number().over(order)).where("choice = 1").drop("choice")


RESULT = ("hotel_id", "method", "model", "rmse", "r2", "mae", "cv_mse", "best_params", "status", "error")


def linear_results(rows: DataFrame, grid: DataFrame) -> DataFrame:
    """``RESULT`` of the linear families: their best points and the errors of those on the test days."""
    best = best_points(grid)
    keys = ["hotel_id", "method", "model"]
    metrics = model_metrics(linear_predictions(rows, best), keys).select(*keys, "rmse", "r2", "mae")
    return best.withColumnRenamed("params", "best_params").join(metrics, keys, "left").select(*RESULT)


def tree_results(grid: DataFrame) -> DataFrame:
    return best_points(grid).withColumnRenamed("params", "best_params").select(*RESULT)


def best_models(results: DataFrame) -> DataFrame:
    """The result with the least error of each property; selected features win only if strictly better."""
    order = [F.asc("rmse"), F.when(F.col("method") == COMPONENTS, 0).otherwise(1), F.asc("model")]
    return top_k(results.where("status = 'ok' AND rmse IS NOT NULL"), ["hotel_id"], order, 1).drop("rank")


def model_choice(
    t: HotelTables, reference_compatible: bool = True, points: Mapping[str, Sequence[dict]] = TREE_POINTS
) -> DataFrame:
    """``RESULT`` of all five families on both branches for every property."""
    rows = cut_lineage(model_rows(t, reference_compatible))
    linear = linear_results(rows, cut_lineage(linear_grid(rows)))
    errors = tree_errors(cut_lineage(branch_rows(rows)), points)
    return linear.unionByName(tree_results(tree_grid(cut_lineage(errors))))
