"""Visitors and booking values by day as mergeable sketches, and by month from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgelens.operators import sketches
from lodgelens.operators.segments import session_columns
from lodgelens.tables import HotelTables


def _searches(t: HotelTables) -> DataFrame:
    """Searches with their day, their visitor, and their value where they led to a booking."""
    visitors = session_columns(t, "uuid")
    rows = t.search_log.select(
        "hotel_id",
        "search_log_session_id",
        F.col("utc_datetime").cast("date").alias("date"),
        F.when(F.col("conversion") == 1, F.col("total_price_final").cast("double")).alias("value"),
    )
    return rows.join(visitors, ["hotel_id", "search_log_session_id"], "left")


def daily_sketches(t: HotelTables) -> DataFrame:
    """One row per property and day with a sketch of its visitors and one of its booking values; meant to be stored."""
    return sketches.sketch_rows(_searches(t), ["hotel_id", "date"], "uuid", "value")


def _month(name: str = "date"):
    return F.date_format(name, "yyyy-MM").alias("month")


def monthly_estimates(daily: DataFrame) -> DataFrame:
    """Estimated visitors and median booking value per property and month, from stored daily sketches."""
    return sketches.merged(daily, ["hotel_id", _month()]).select(
        "hotel_id",
        "month",
        sketches.distinct_count().alias("visitors"),
        sketches.approximate_quantile(0.5).alias("median_value"),
    )


def monthly_check(t: HotelTables, daily: DataFrame) -> DataFrame:
    """Exact visitors and bookings per property and month, and whether the merged sketches are within their bounds."""
    rows = _searches(t).select("hotel_id", _month(), "uuid", "value")
    estimates = monthly_estimates(daily).withColumnsRenamed({"visitors": "estimate"})
    exact = rows.groupBy("hotel_id", "month").agg(F.count_distinct("uuid").alias("visitors"))
    below = F.count_if(F.col("value") < F.col("median_value"))
    upto = F.count_if(F.col("value") <= F.col("median_value"))
    ranked = (
        rows.where(F.col("value").isNotNull())
        .join(estimates.select("hotel_id", "month", "median_value"), ["hotel_id", "month"])
        .groupBy("hotel_id", "month")
        .agg(F.count(F.lit(1)).alias("bookings"), below.alias("below"), upto.alias("upto"))
    )
    return (
        exact.join(estimates, ["hotel_id", "month"])
        .join(ranked, ["hotel_id", "month"], "left")
        .select(
            "hotel_id",
            "month",
            "visitors",
            sketches.distinct_within(F.col("estimate"), F.col("visitors")).alias("visitors_within"),
            F.coalesce("bookings", F.lit(0)).alias("bookings"),
            F.coalesce(sketches.rank_within(F.col("below"), F.col("upto"), F.col("bookings"), 0.5), F.lit(True)).alias("median_within"),
        )
    )
