"""Paid clicks: traffic, spend, conversions and bookings by source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgelens.functions.columns import (
    contains_ignoring_case,
    is_paid_click,
    percent,
    source_of_pair,
    utm_parts,
)
from lodgelens.operators.cells import add_share, by_count, drop_zero_columns, spread, value_counts
from lodgelens.operators.segments import bookings_with_segment, converted, join_sessions
from lodgelens.schema import CURRENCIES, PPC_PAIRS, PPC_SOURCES, SPEND_PLATFORMS
from lodgelens.tables import HotelTables

Currencies = tuple[str, ...] | None


def paid_traffic(t: HotelTables, pairs: Sequence[str] = PPC_PAIRS) -> DataFrame:
    return t.datepicker_daily_visitors.where(F.col("utm_source_and_medium").isin(*pairs))


def ppc_daily_traffic(t: HotelTables) -> DataFrame:
    return paid_traffic(t).groupBy("hotel_id", "date", "utm_source_and_medium").agg(
        F.sum("user_count").alias("user_count"), F.sum("session_count").alias("session_count")
    )


def ppc_daily_spend(t: HotelTables) -> DataFrame:
    """Daily spend, one row per platform."""
    platforms = F.array(
        *[F.struct(F.lit(p).alias("platform"), F.col(c).alias("spend")) for p, c in SPEND_PLATFORMS.items()]
    )
    return t.daily_ppc_budget.select("hotel_id", "date", F.inline(platforms))


def _bookings_by_source(t: HotelTables) -> DataFrame:
    """Converted searches per paid-click source; the per-session count shares its exchange with the join."""
    per_session = converted(t).groupBy("hotel_id", "search_log_session_id").agg(F.count(F.lit(1)).alias("n"))
    clicked = join_sessions(per_session, t, "utm_source", "utm_medium").where(
        is_paid_click("utm_source", "utm_medium")
    )
    return clicked.groupBy("hotel_id", "utm_source").agg(F.sum("n").alias("bookings"))


def ppc_conversions(t: HotelTables) -> DataFrame:
    """Visitors, bookings and conversion rate per source; sources seen on one side only are kept."""
    visitors = (
        paid_traffic(t)
        .groupBy("hotel_id", source_of_pair("utm_source_and_medium").alias("utm_source"))
        .agg(F.sum("user_count").alias("visitors"))
    )
    aligned = visitors.join(_bookings_by_source(t), ["hotel_id", "utm_source"], "full").select(
        "hotel_id",
        "utm_source",
        F.coalesce("visitors", F.lit(0)).alias("visitors"),
        F.coalesce("bookings", F.lit(0)).alias("bookings"),
    )
    return aligned.where((F.col("visitors") > 0) | (F.col("bookings") > 0)).withColumn(
        "conversion_pct", percent("bookings", "visitors")
    )


def _cells(t: HotelTables, currencies: Currencies) -> DataFrame:
    """Paid-click bookings per currency, segment and source: rows and revenue."""
    per_session = bookings_with_segment(t, currencies).groupBy(
        "hotel_id", "search_log_session_id", "currency", "segment"
    ).agg(F.count("total_price").alias("bookings"), F.sum("total_price").alias("revenue"))
    clicked = join_sessions(per_session, t, "utm_source", "utm_medium").where(
        is_paid_click("utm_source", "utm_medium")
    )
    return clicked.groupBy("hotel_id", "currency", "segment", "utm_source").agg(
        F.sum("bookings").alias("bookings"), F.sum("revenue").alias("revenue")
    )


def ppc_bookings_by_segment(t: HotelTables) -> DataFrame:
    """Bookings per segment and source, all currencies, with the segment's percent of the source."""
    cells = _cells(t, None).groupBy("hotel_id", "segment", "utm_source").agg(F.sum("bookings").alias("bookings"))
    return add_share(cells, "bookings", ["hotel_id", "utm_source"])


def ppc_revenue_by_segment(t: HotelTables, currencies: Currencies = CURRENCIES) -> DataFrame:
    """Bookings and revenue per currency, segment and source; sources without revenue are dropped."""
    cells = drop_zero_columns(_cells(t, currencies), ["hotel_id", "currency", "utm_source"], "revenue")
    return cells.withColumn("revenue", F.col("revenue").cast("double"))


def ppc_revenue_wide(t: HotelTables, currencies: Currencies = CURRENCIES) -> DataFrame:
    """The same as one row per segment with ``<source>_bookings`` and ``<source>_revenue``, empty cells 0."""
    return spread(
        _cells(t, currencies),
        ["hotel_id", "currency", "segment"],
        "utm_source",
        PPC_SOURCES,
        {"bookings": F.sum("bookings"), "revenue": F.sum("revenue").cast("double")},
        fill=0,
    )


def utm_matches(t: HotelTables, needle: str = "cpc", with_all_levels: bool = False) -> DataFrame:
    """UTM pairs that contain ``needle`` in any case, with their row counts, most frequent first.

    ``with_all_levels`` also lists the pairs that do not match, with 0 rows.
    """
    visits = t.datepicker_daily_visitors
    matching = visits.where(contains_ignoring_case("utm_source_and_medium", needle))
    counts = value_counts(matching, "utm_source_and_medium", levels=visits if with_all_levels else None)
    return by_count(counts, "hotel_id", "utm_source_and_medium")


def utm_split(t: HotelTables, table: str = "datepicker_daily_visitors", trim: bool = True) -> DataFrame:
    """Visitors per source and medium of a traffic table: its own columns, else split out of the combined text.

    A loaded table has split a missing pair into ``unknown`` before it filled the combined text, so its columns count.
    """
    visits = t[table]
    source, medium = utm_parts("utm_source_and_medium", trim)
    if {"utm_source", "utm_medium"} <= set(visits.columns):
        source, medium = F.col("utm_source"), F.col("utm_medium")
    return (
        visits
        .groupBy("hotel_id", source.alias("utm_source"), medium.alias("utm_medium"))
        .agg(F.sum("user_count").alias("user_count"), F.sum("session_count").alias("session_count"))
    )
