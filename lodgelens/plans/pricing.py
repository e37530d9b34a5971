"""Does the recorded price of a booking equal the sum of its parts?  Plus booking statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodgelens.functions.columns import ratio, recomposed_price
from lodgelens.operators.cells import top_k
from lodgelens.tables import HotelTables

DOUBLE_TOLERANCE = 0.005


def price_differences(t: HotelTables) -> DataFrame:
    """Booking rows with the recomposed price, its difference to the recorded one and its absolute value."""
    parts = t.booking_data.withColumn("recomposed", recomposed_price())
    return parts.withColumn("diff", F.col("recomposed") - F.col("total_price_final")).withColumn(
        "abs_diff", F.abs("diff")
    )


def differs(bookings: DataFrame, tolerance: float | None = None) -> Column:
    """True where the difference counts: exactly non-zero for decimals, beyond half a cent for doubles."""
    if tolerance is None:
        exact = isinstance(bookings.schema["diff"].dataType, T.DecimalType)
        tolerance = 0.0 if exact else DOUBLE_TOLERANCE
    return F.col("abs_diff") > F.lit(tolerance).cast(bookings.schema["abs_diff"].dataType)


def _with_search(bookings: DataFrame, t: HotelTables) -> DataFrame:
    searches = t.search_log.select("hotel_id", F.col("id").alias("search_log_id"), "utc_datetime", "currency")
    return bookings.join(searches, ["hotel_id", "search_log_id"], "left")


def price_reconciliation(t: HotelTables, tolerance: float | None = None) -> DataFrame:
    """Bookings and price differences per currency.

    Booking rows are reduced to one per search first; that aggregate and the join share one exchange.
    Bookings whose search is unknown have no currency and are left out.
    """
    rows = price_differences(t)
    per_search = rows.groupBy("hotel_id", "search_log_id").agg(
        F.count(F.lit(1)).alias("bookings"),
        F.count_if(differs(rows, tolerance)).alias("diff_count"),
        F.sum("diff").alias("diff_sum"),
    )
    joined = _with_search(per_search, t).where(F.col("currency").isNotNull())
    return joined.groupBy("hotel_id", "currency").agg(
        F.sum("bookings").alias("bookings"),
        F.sum("diff_count").alias("diff_count"),
        F.sum("diff_sum").cast("double").alias("diff_sum"),
    )


def price_diff_top(t: HotelTables, k: int = 5, tolerance: float | None = None) -> DataFrame:
    """The ``k`` bookings with the largest absolute difference per currency; none where nothing differs."""
    rows = price_differences(t)
    flagged = rows.select(
        "hotel_id", "search_log_id", "recomposed", "total_price_final", "diff", "abs_diff",
        differs(rows, tolerance).alias("_differs"),
    )
    joined = _with_search(flagged, t).where(F.col("currency").isNotNull())
    largest = top_k(joined, ["hotel_id", "currency"], [F.desc("abs_diff"), F.asc("search_log_id")], k)
    # The rows left are at most k per currency, the first of them carrying the largest difference.
    leader = F.max_by("_differs", "abs_diff").over(Window.partitionBy("hotel_id", "currency"))
    return (
        largest.withColumn("_any", leader)
        .where("_any")
        .select(
            "hotel_id",
            "currency",
            "rank",
            "search_log_id",
            F.col("recomposed").cast("double").alias("recomposed"),
            F.col("total_price_final").cast("double").alias("total_price"),
            F.col("diff").cast("double").alias("diff"),
        )
    )


def price_diff_series(t: HotelTables, tolerance: float | None = None) -> DataFrame:
    """Every difference with its time, currency and sign; the filter runs before the join."""
    rows = price_differences(t)
    off = rows.where(differs(rows, tolerance)).select("hotel_id", "search_log_id", "diff")
    return (
        _with_search(off, t)
        .where(F.col("currency").isNotNull())
        .select(
            "hotel_id",
            "currency",
            "utc_datetime",
            "search_log_id",
            F.col("diff").cast("double").alias("diff"),
            F.when(F.col("diff") > 0, "surplus").otherwise("shortfall").alias("sign"),
        )
    )


def booking_stats(t: HotelTables) -> DataFrame:
    """Searches, bookings, conversion rate and mean value: in all, by currency and by language.

    One scan and one exchange of pre-aggregated cells; the three groupings are formed from the cells.
    """
    booked = F.col("conversion") == 1
    cells = t.search_log.groupBy("hotel_id", "currency", "lang_code").agg(
        F.count(F.lit(1)).alias("searches"),
        F.sum("conversion").alias("conversions"),
        F.count_if(booked).alias("bookings"),
        F.sum(F.when(booked, F.col("total_price_final"))).alias("revenue"),
    )
    views = F.array(
        F.struct(F.lit("all").alias("dimension"), F.lit("all").alias("value")),
        F.struct(F.lit("currency").alias("dimension"), F.col("currency").alias("value")),
        F.struct(F.lit("language").alias("dimension"), F.col("lang_code").alias("value")),
    )
    exploded = cells.select("hotel_id", F.inline(views), "searches", "conversions", "bookings", "revenue")
    return exploded.groupBy("hotel_id", "dimension", "value").agg(
        F.sum("searches").alias("searches"),
        F.sum("bookings").alias("bookings"),
        (ratio(F.sum("conversions"), F.sum("searches")) * 100).alias("conversion_pct"),
        ratio(F.sum("revenue"), F.sum("bookings")).alias("avg_value"),
    )
