"""Lead time: whole days between search and arrival, for searches that have a booking record."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgelens.functions.columns import is_pair, lead_time_days, utm_pair
from lodgelens.operators.cells import spread, value_counts
from lodgelens.operators.distribution import (
    box_statistics,
    quartiles,
    summarise,
    value_histogram,
    weighted_mean,
)
from lodgelens.operators.segments import join_sessions, recorded, with_segment
from lodgelens.schema import PPC_PAIRS
from lodgelens.tables import HotelTables

BY_SEGMENT = ("hotel_id", "segment")
BY_SOURCE = ("hotel_id", "utm_source_and_medium", "segment")
MONTHS = tuple(range(1, 13))


def bookings_with_lead_time(t: HotelTables) -> DataFrame:
    """Recorded bookings with segment, lead time and month of the search."""
    return with_segment(recorded(t), t).select(
        "hotel_id",
        "id",
        "search_log_session_id",
        "segment",
        "arrival",
        "utc_datetime",
        lead_time_days("utc_datetime", "arrival").alias("lead_time"),
        F.month("utc_datetime").alias("booking_month"),
    )


def _segment_histogram(t: HotelTables) -> DataFrame:
    return value_histogram(bookings_with_lead_time(t), BY_SEGMENT, "lead_time")


def lead_time_by_segment(t: HotelTables) -> DataFrame:
    """Count, mean, median, standard deviation, minimum and maximum of the lead time per segment."""
    return summarise(_segment_histogram(t), BY_SEGMENT, "lead_time")


def lead_time_percentiles(t: HotelTables) -> DataFrame:
    return quartiles(_segment_histogram(t), BY_SEGMENT, "lead_time")


def lead_time_box(t: HotelTables) -> DataFrame:
    return box_statistics(_segment_histogram(t), BY_SEGMENT, "lead_time")


def lead_time_monthly(t: HotelTables) -> DataFrame:
    """Mean lead time per segment, one column per month of the search (``m1`` … ``m12``)."""
    return _monthly(value_histogram(bookings_with_lead_time(t), [*BY_SEGMENT, "booking_month"], "lead_time"), BY_SEGMENT)


def _monthly(histogram: DataFrame, by: Sequence[str]) -> DataFrame:
    wide = spread(histogram, by, "booking_month", MONTHS, {"mean": weighted_mean("lead_time")})
    return wide.select(*by, *[F.col(str(m)).alias(f"m{m}") for m in MONTHS])


def _source_histogram(t: HotelTables, pairs: Sequence[str], *keys: str) -> DataFrame:
    """Lead-time counts per paid-click pair and segment, reduced per session before the session join."""
    per_session = value_histogram(
        bookings_with_lead_time(t), ["hotel_id", "search_log_session_id", "segment", *keys], "lead_time"
    )
    named = join_sessions(per_session, t, "utm_source", "utm_medium").withColumn(
        "utm_source_and_medium", utm_pair("utm_source", "utm_medium")
    )
    chosen = named.where(is_pair("utm_source", "utm_medium", pairs))
    return chosen.groupBy(*BY_SOURCE, *keys, "lead_time").agg(F.sum("n").alias("n"))


def lead_time_by_source(t: HotelTables, pairs: Sequence[str] = PPC_PAIRS) -> DataFrame:
    return summarise(_source_histogram(t, pairs), BY_SOURCE, "lead_time")


def lead_time_by_source_box(t: HotelTables, pairs: Sequence[str] = PPC_PAIRS) -> DataFrame:
    return box_statistics(_source_histogram(t, pairs), BY_SOURCE, "lead_time")


def lead_time_by_source_monthly(t: HotelTables, pairs: Sequence[str] = PPC_PAIRS) -> DataFrame:
    return _monthly(_source_histogram(t, pairs, "booking_month"), BY_SOURCE)


def bookings_by_source(t: HotelTables, pairs: Sequence[str] = PPC_PAIRS) -> DataFrame:
    """Recorded bookings per paid-click pair; rooms and children are not read."""
    per_session = recorded(t).groupBy("hotel_id", "search_log_session_id").agg(F.count(F.lit(1)).alias("n"))
    named = join_sessions(per_session, t, "utm_source", "utm_medium").withColumn(
        "utm_source_and_medium", utm_pair("utm_source", "utm_medium")
    )
    chosen = named.where(is_pair("utm_source", "utm_medium", pairs))
    return chosen.groupBy("hotel_id", "utm_source_and_medium").agg(F.sum("n").alias("bookings"))


def bookings_by_segment(t: HotelTables) -> DataFrame:
    return value_counts(with_segment(recorded(t), t), "segment", name="bookings")
