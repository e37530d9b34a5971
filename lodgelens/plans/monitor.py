"""Monitoring: model metrics, residuals, data quality and daily figures, assembled into report rows."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodgelens.operators.distribution import equal_width_histogram
from lodgelens.plans.daily import same_day_occupancy
from lodgelens.plans.profile import data_quality
from lodgelens.schema import TABLE_NAMES
from lodgelens.tables import HotelTables

# Fixed value: error of the reference model that reports are compared with.
BASELINE_RMSE = 8.350


def with_residual(predictions: DataFrame) -> DataFrame:
    return predictions.withColumn("residual", F.col("label") - F.col("prediction"))


def model_metrics(
    predictions: DataFrame, by: Sequence[str] = ("hotel_id",), baseline_rmse: float = BASELINE_RMSE
) -> DataFrame:
    """RMSE, MAE and R² of ``(prediction, label)`` rows, in one aggregate."""
    scored = with_residual(predictions.where(F.col("prediction").isNotNull() & F.col("label").isNotNull()))
    squares = F.sum(F.col("residual") * F.col("residual"))
    n = F.count(F.lit(1))
    return scored.groupBy(*by).agg(
        n.alias("n"),
        F.sqrt(F.try_divide(squares, n)).alias("rmse"),
        F.avg(F.abs("residual")).alias("mae"),
        (1 - F.try_divide(squares, F.var_pop("label") * n)).alias("r2"),
        (F.sqrt(F.try_divide(squares, n)) - baseline_rmse).alias("rmse_vs_baseline"),
    )


def residual_histogram(predictions: DataFrame, by: Sequence[str] = ("hotel_id",), bins: int = 20) -> DataFrame:
    return equal_width_histogram(with_residual(predictions), by, "residual", bins)


def daily_metrics(t: HotelTables) -> DataFrame:
    """Bookings, occupancy rate and website visitors per property and day.

    The three daily aggregates are stacked and merged by key, which keeps days known to one of them only.
    """
    none = F.lit(None).cast("double")
    zero = F.lit(0).cast("long")
    bookings = (
        t.search_log.where(F.col("conversion") == 1)
        .groupBy("hotel_id", F.col("utc_datetime").cast("date").alias("date"))
        .agg(F.count(F.lit(1)).alias("bookings"))
        .select("hotel_id", "date", "bookings", none.alias("occupancy_rate"), zero.alias("website_visitors"))
    )
    occupancy = (
        same_day_occupancy(t)
        .groupBy("hotel_id", "date")
        .agg(F.avg("fill_rate").alias("occupancy_rate"))
        .select("hotel_id", "date", zero.alias("bookings"), "occupancy_rate", zero.alias("website_visitors"))
    )
    visitors = (
        t.website_daily_users.groupBy("hotel_id", "date")
        .agg(F.sum("user_count").alias("website_visitors"))
        .select("hotel_id", "date", zero.alias("bookings"), none.alias("occupancy_rate"), "website_visitors")
    )
    stacked = reduce(DataFrame.unionByName, [bookings, occupancy, visitors])
    return stacked.groupBy("hotel_id", "date").agg(
        F.sum("bookings").alias("bookings"),
        F.max("occupancy_rate").alias("occupancy_rate"),
        F.sum("website_visitors").alias("website_visitors"),
    )


def model_report(
    predictions: DataFrame,
    t: HotelTables,
    model_name: str,
    reported_at: datetime,
    baseline_rmse: float = BASELINE_RMSE,
    tables: tuple[str, ...] = TABLE_NAMES,
) -> DataFrame:
    """One nested report row per property: metrics, data quality of ``tables``, figures of the report day.

    Append it with ``store.append_report``; the history is read back with ``store.read_reports``.
    """
    metrics = model_metrics(predictions, baseline_rmse=baseline_rmse).select(
        "hotel_id",
        F.struct("rmse", "mae", "r2").alias("model_metrics"),
        "rmse_vs_baseline",
    )
    quality = data_quality(t, tables).groupBy("hotel_id").agg(
        F.sort_array(
            F.collect_list(F.struct("table_name", "missing_values", "row_count", "duplicate_rows"))
        ).alias("data_quality")  # eleven entries per property
    )
    today = (
        daily_metrics(t)
        .where(F.col("date") == F.lit(reported_at.date()))
        .select("hotel_id", F.struct("date", "bookings", "occupancy_rate", "website_visitors").alias("daily_metrics"))
    )
    return (
        metrics.join(quality, "hotel_id", "left")
        .join(today, "hotel_id", "left")
        .select(
            F.lit(reported_at.date()).alias("report_date"),
            F.lit(f"{reported_at:%Y-%m-%d %H:%M:%S}").alias("timestamp"),
            F.lit(model_name).alias("model_name"),
            "hotel_id",
            "model_metrics",
            "rmse_vs_baseline",
            "data_quality",
            "daily_metrics",
        )
    )


def metric_history(reports: DataFrame) -> DataFrame:
    """RMSE, MAE and R² of the stored reports in time order, and the change of RMSE and MAE since the report before."""
    kept = reports.select(
        "hotel_id", "model_name", "timestamp", "model_metrics.rmse", "model_metrics.mae", "model_metrics.r2", "rmse_vs_baseline"
    )
    before = Window.partitionBy("hotel_id", "model_name").orderBy("timestamp")
    change = {f"{m}_change": F.col(m) - F.lag(m).over(before) for m in ("rmse", "mae")}
    return kept.withColumns(change).orderBy("hotel_id", "model_name", "timestamp")
