"""Guest segments: sizes, stays, spending, revenue, and the campaigns that brought them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgelens.functions.columns import guests, percent, ratio
from lodgelens.operators.cells import add_open_share, add_share, count_cells, top_k
from lodgelens.operators.segments import bookings_with_segment, converted, in_currencies, join_sessions
from lodgelens.schema import CURRENCIES, NOT_SET
from lodgelens.tables import HotelTables

Currencies = tuple[str, ...] | None


def segment_stats(t: HotelTables, currencies: Currencies = CURRENCIES) -> DataFrame:
    """Bookings and mean stay, price and guests per segment; costs are ratios of means, not means of ratios."""
    sums = bookings_with_segment(t, currencies).groupBy("hotel_id", "currency", "segment").agg(
        F.count(F.lit(1)).alias("bookings"),
        F.sum("nights").alias("nights"),
        F.sum("total_price").alias("price"),
        F.sum(guests()).alias("guests"),
    )
    return sums.select(
        "hotel_id",
        "currency",
        "segment",
        "bookings",
        ratio("nights", "bookings").alias("avg_nights"),
        ratio("price", "bookings").alias("avg_price"),
        ratio("guests", "bookings").alias("avg_guests"),
        ratio("price", "nights").alias("cost_per_night"),
        ratio("price", "guests").alias("cost_per_person"),
    )


def segment_revenue(t: HotelTables, currencies: Currencies = CURRENCIES) -> DataFrame:
    cells = count_cells(
        bookings_with_segment(t, currencies),
        ["hotel_id", "currency", "segment"],
        "bookings",
        revenue=F.sum("total_price"),
    )
    shared = add_share(cells, "revenue", ["hotel_id", "currency"], "revenue_share_pct")
    return shared.select(
        "hotel_id",
        "currency",
        "segment",
        F.col("revenue").cast("double").alias("revenue"),
        "bookings",
        "revenue_share_pct",
        ratio("revenue", "bookings").alias("avg_value"),
    )


def revenue_totals(t: HotelTables, currencies: Currencies = CURRENCIES) -> DataFrame:
    """Revenue and bookings per currency; needs no segment, hence no join."""
    return in_currencies(converted(t), currencies).groupBy("hotel_id", "currency").agg(
        F.sum("total_price_final").cast("double").alias("revenue"), F.count(F.lit(1)).alias("bookings")
    )


def segment_top(t: HotelTables, k: int = 3, currencies: Currencies = CURRENCIES) -> DataFrame:
    return top_k(
        segment_revenue(t, currencies), ["hotel_id", "currency"], [F.desc("revenue"), F.asc("segment")], k
    ).select("hotel_id", "currency", "rank", "segment", "revenue", "revenue_share_pct")


def _campaign_cells(bookings: DataFrame, t: HotelTables, keys: list[str]) -> DataFrame:
    """Bookings per ``keys`` and campaign.  Rows are reduced per session before they meet the sessions."""
    per_session = count_cells(bookings, ["hotel_id", "search_log_session_id", *keys], "bookings")
    named = join_sessions(per_session, t, "utm_campaign", how="left").withColumn(
        "utm_campaign", F.coalesce("utm_campaign", F.lit(NOT_SET))
    )
    return named.groupBy("hotel_id", *keys, "utm_campaign").agg(F.sum("bookings").alias("bookings"))


def campaign_by_segment(t: HotelTables, currencies: Currencies = CURRENCIES) -> DataFrame:
    """Bookings per segment and campaign, with the campaign's percent of the segment."""
    cells = _campaign_cells(bookings_with_segment(t, currencies), t, ["currency", "segment"])
    return add_open_share(cells, "bookings", ["hotel_id", "currency", "segment"])


def campaign_totals(t: HotelTables, currencies: Currencies = CURRENCIES) -> DataFrame:
    """Bookings per campaign; the segment is not needed, so rooms and children are not read."""
    return _campaign_cells(in_currencies(converted(t), currencies), t, ["currency"])


def top_campaigns(t: HotelTables, k: int = 5, currencies: Currencies = CURRENCIES) -> DataFrame:
    """The ``k`` campaigns with most bookings; the share is among these ``k``, not among all."""
    first = top_k(
        campaign_totals(t, currencies), ["hotel_id", "currency"], [F.desc("bookings"), F.asc("utm_campaign")], k
    )
    return add_share(first, "bookings", ["hotel_id", "currency"])


def campaign_summary(t: HotelTables, currencies: Currencies = CURRENCIES) -> DataFrame:
    return campaign_totals(t, currencies).groupBy("hotel_id", "currency").agg(
        F.sum("bookings").alias("bookings"),
        F.count(F.lit(1)).alias("active_campaigns"),
        ratio(F.sum("bookings"), F.count(F.lit(1))).alias("bookings_per_campaign"),
        percent(F.max("bookings"), F.sum("bookings")).alias("largest_share_pct"),
    )
