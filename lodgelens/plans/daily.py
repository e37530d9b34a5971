"""Daily features for the occupancy model.

Windows are partitioned by property and run on one row per day, after all aggregation: a partition is as long
as the property's history in days, whatever the number of visits behind it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodgelens.functions.columns import is_weekend, keyed_normal, on_circle, ratio_zero_as_one, total_spend
from lodgelens.tables import HotelTables

WINDOWS = (3, 7, 14)
LAGS = (7, 14)
TARGET = "fill_rate"
SERIES = {"fill_rate": "fill_rate", "user_count": "user_count", "ppc": "total_ppc_spend"}

FEATURES = (
    ["user_count", "session_count", "total_ppc_spend", "weekday", "is_weekend", "ppc_per_user", "conversion_rate"]
    + [f"{s}_ma{w}" for s in SERIES for w in WINDOWS]
    + [f"fill_rate_std{w}" for w in WINDOWS]
    + [f"{s}_lag{k}" for s in SERIES for k in LAGS]
    + ["weekday_sin", "weekday_cos", "month_sin", "month_cos"]
)
UNSCALED = (TARGET, "weekday", "is_weekend")
SCALED = [f for f in FEATURES if f not in UNSCALED]
NOISE = 0.1


def same_day_occupancy(t: HotelTables) -> DataFrame:
    """Fill rates recorded on the day they are about."""
    return t.daily_occupancy.where(F.col("recording_date") == F.col("subject_date")).select(
        "hotel_id", F.col("subject_date").alias("date"), "fill_rate"
    )


def daily_series(t: HotelTables) -> DataFrame:
    """Users and sessions per day with that day's fill rate and advertising spend."""
    visits = t.datepicker_daily_visitors.groupBy("hotel_id", "date").agg(
        F.sum("user_count").alias("user_count"), F.sum("session_count").alias("session_count")
    )
    spend = t.daily_ppc_budget.select("hotel_id", "date", total_spend().alias("total_ppc_spend"))
    key = ["hotel_id", "date"]
    return visits.join(same_day_occupancy(t), key, "left").join(spend, key, "left")


def daily_features(t: HotelTables, include_current: bool = True) -> DataFrame:
    """Target and 29 features per property and day.

    Averages and lags count rows, not calendar days.  With ``include_current`` the moving figures of the
    target end at the current row; without it they end at the row before, so the target does not leak.
    """
    days = Window.partitionBy("hotel_id").orderBy("date")
    weekday_sin, weekday_cos = on_circle("weekday", 7)
    month_sin, month_cos = on_circle(F.month("date"), 12)

    moving = {}
    for short, column in SERIES.items():
        end = 0 if include_current or column != TARGET else -1
        for w in WINDOWS:
            frame = days.rowsBetween(end - (w - 1), end)
            moving[f"{short}_ma{w}"] = F.avg(column).over(frame)
            if column == TARGET:
                moving[f"{short}_std{w}"] = F.stddev_samp(column).over(frame)
        for k in LAGS:
            moving[f"{short}_lag{k}"] = F.lag(column, k).over(days).cast("double")

    plain = {
        "is_weekend": is_weekend("date"),
        "ppc_per_user": ratio_zero_as_one("total_ppc_spend", "user_count"),
        "conversion_rate": ratio_zero_as_one("session_count", "user_count"),
        "weekday_sin": weekday_sin,
        "weekday_cos": weekday_cos,
        "month_sin": month_sin,
        "month_cos": month_cos,
    }
    series = daily_series(t).withColumn("weekday", F.weekday("date"))
    return series.withColumns({**plain, **moving}).select("hotel_id", "date", TARGET, *FEATURES)


def with_noisy_twins(rows: DataFrame, seed: int, noise: float = NOISE) -> DataFrame:
    """Each row followed by a twin (``copy`` 1) with normal noise on every column, target included.

    The noise is drawn once per day and column, before a day becomes two rows.
    """
    columns = (TARGET, *FEATURES)
    drawn = [f"{noise}D * {keyed_normal(seed, c, 'hotel_id', 'date')} AS {c}__noise" for c in columns]
    doubled = rows.selectExpr("*", *drawn).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    shaken = [f"CAST({c} AS DOUBLE) + CASE WHEN copy = 0 THEN 0D ELSE {c}__noise END AS {c}" for c in columns]
    return doubled.selectExpr("hotel_id", "date", "copy", *shaken)


def scaling_statistics(rows: DataFrame) -> DataFrame:
    """One row with the mean and population standard deviation of every scaled feature; nulls are skipped, zero
    spread counts 1."""
    return rows.agg(
        *[F.expr(f"avg({f}) AS {f}__mean") for f in SCALED],
        *[F.expr(f"if(stddev_pop({f}) = 0, 1D, stddev_pop({f})) AS {f}__std") for f in SCALED],
    )


def standardised(rows: DataFrame, fitted_on: str = "true") -> DataFrame:
    """Scale the features of each property by its own mean and population deviation, zero spread counting 1.

    The statistics are windows over the property's days, those that meet ``fitted_on``.  The daily features are
    partitioned by property already, so this adds no exchange.
    """
    over = "OVER (PARTITION BY hotel_id)"
    told = lambda f: f if fitted_on == "true" else f"if({fitted_on}, {f}, NULL)"
    means = [f"avg({told(f)}) {over} AS {f}__mean" for f in SCALED]
    spreads = [f"stddev_pop({told(f)}) {over} AS {f}__std" for f in SCALED]
    scaled = {f: f"({f} - {f}__mean) / if({f}__std = 0, 1D, {f}__std) AS {f}" for f in SCALED}
    return rows.selectExpr("*", *means, *spreads).selectExpr(*[scaled.get(c, c) for c in rows.columns])


def scaled_features(t: HotelTables, seed: int | None = None) -> DataFrame:
    """Standardised daily features of complete days; with a ``seed`` each day has its noisy twin.

    The statistics are those of all days, incomplete ones included.
    """
    days = daily_features(t)
    present = " AND ".join(f"{c} IS NOT NULL" for c in (TARGET, *FEATURES))
    rows = days if seed is None else with_noisy_twins(days, seed)
    flagged = rows.withColumn("_complete", F.expr(present))
    return standardised(flagged).where("_complete").drop("_complete")


# -- chronological numbering -------------------------------------------------------------------------------


def chronological_split(rows: DataFrame, order: tuple[str, ...] = ("date",), test_share: float = 0.2) -> DataFrame:
    """Mark the last ``ceil(test_share × n)`` rows of each property as ``test``, the rest as ``train``."""
    group = Window.partitionBy("hotel_id")
    position = F.row_number().over(group.orderBy(*order))
    total = F.count(F.lit(1)).over(group)
    test_rows = F.ceil(total * F.lit(test_share) - F.lit(1e-9))
    return rows.withColumn("role", F.when(position <= total - test_rows, "train").otherwise("test"))


def fold_blocks(train: DataFrame, order: tuple[str, ...] = ("date",), folds: int = 5) -> DataFrame:
    """Number the blocks of a growing cross-validation: fold ``i`` trains on blocks below ``i``, tests on ``i``.

    Each test block has ``n div (folds + 1)`` rows and the last one ends at the last row; the rows before the
    first block have number −1.
    """
    group = Window.partitionBy("hotel_id")
    position = F.row_number().over(group.orderBy(*order)) - 1
    total = F.count(F.lit(1)).over(group)
    size = F.floor(total / (folds + 1))
    block = F.floor(F.try_divide(position - (total - folds * size), size))
    return train.withColumn("block", F.greatest(F.coalesce(block, F.lit(-1)), F.lit(-1)).cast("int"))


def fold_roles(blocks: DataFrame, folds: int = 5) -> DataFrame:
    """One row per (row, fold) that takes part, with its role in the fold."""
    listed = blocks.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    taking_part = listed.where(F.col("block") <= F.col("fold"))
    return taking_part.withColumn("role", F.when(F.col("block") == F.col("fold"), "test").otherwise("train"))
