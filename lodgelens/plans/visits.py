"""Visitors across sessions: visits before the first booking, repeat bookers.

A visitor is a ``uuid``; its sessions carry the searches.  Searches meet sessions in a plain equi join whose
right side has one row per session (and currency booked in), so a session with a large share of all searches only
makes the left side uneven, which adaptive execution splits.  Everything else works on one row per session or per visitor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodgelens.functions.columns import guests, percent, ratio
from lodgelens.operators.cells import top_k
from lodgelens.operators.distribution import quantile
from lodgelens.operators.segments import converted, join_sessions, session_columns
from lodgelens.tables import HotelTables

USER = ("hotel_id", "uuid")
FIGURES = ("bookings", "revenue", "adults", "children")


def _booked(t: HotelTables, *dimensions: str) -> DataFrame:
    """Bookings, revenue, guests and first booking of every visitor who booked, per ``dimensions`` of the search log.

    ``booked_at`` is the visitor's first booking over all dimensions.
    """
    per_session = converted(t).groupBy("hotel_id", "search_log_session_id", *dimensions).agg(
        F.min("utc_datetime").alias("booked_at"),
        F.count(F.lit(1)).alias("bookings"),
        F.sum("total_price_final").alias("revenue"),
        F.sum("adults").alias("adults"),
        F.sum("children").alias("children"),
    )
    joined = join_sessions(per_session, t, "uuid").where(F.col("uuid").isNotNull())
    booked = joined.groupBy(*USER, *dimensions).agg(
        F.min("booked_at").alias("booked_at"), *[F.sum(c).alias(c) for c in FIGURES]
    )
    if not dimensions:
        return booked
    return booked.withColumn("booked_at", F.min("booked_at").over(Window.partitionBy(*USER)))


def _booked_with_visits(t: HotelTables, *dimensions: str) -> DataFrame:
    """Every visitor who booked with ``visits``, the searches strictly before the first booking, and the figures.

    The first booking is found on converted searches alone and carried to the visitor's sessions, the figures with
    it; the full search log is then shuffled once, with three columns, to be counted against it.  A visitor who
    booked in two currencies has two rows, both with all the searches before the overall first booking.
    """
    sessions = session_columns(t, "uuid").where(F.col("uuid").isNotNull())
    searches = t.search_log.select("hotel_id", "search_log_session_id", "utc_datetime")
    return (
        searches.join(sessions.join(_booked(t, *dimensions), list(USER)), ["hotel_id", "search_log_session_id"])
        .groupBy(*USER, *dimensions)
        .agg(
            F.count_if(F.col("utc_datetime") < F.col("booked_at")).alias("visits"),
            *[F.max(c).alias(c) for c in FIGURES],  # the same in all rows of a group
        )
    )


def visits_before_booking(t: HotelTables) -> DataFrame:
    """For each visitor who booked: searches strictly before the first booking."""
    return _booked_with_visits(t).select(*USER, "visits")


def _bookings_per_user(t: HotelTables, *dimensions: str) -> DataFrame:
    """Bookings, revenue and guests per visitor, currency and further session columns."""
    per_session = converted(t).groupBy("hotel_id", "search_log_session_id", "currency").agg(
        F.count(F.lit(1)).alias("bookings"),
        F.sum("total_price_final").alias("revenue"),
        F.sum("adults").alias("adults"),
        F.sum("children").alias("children"),
    )
    joined = join_sessions(per_session, t, "uuid", *dimensions).where(F.col("uuid").isNotNull())
    return joined.groupBy(*USER, "currency", *dimensions).agg(*[F.sum(c).alias(c) for c in FIGURES])


def _currency_histogram(t: HotelTables) -> DataFrame:
    """Visitors per (currency, visits), with their bookings, revenue and guests in that currency."""
    return _booked_with_visits(t, "currency").groupBy("hotel_id", "currency", "visits").agg(
        F.count(F.lit(1)).alias("users"), *[F.sum(c).alias(c) for c in FIGURES]
    )


def visits_distribution(t: HotelTables) -> DataFrame:
    """Visitors per number of visits and currency, with their percent."""
    cells = _currency_histogram(t).select("hotel_id", "currency", "visits", "users")
    total = F.sum("users").over(Window.partitionBy("hotel_id", "currency"))
    return cells.withColumn("share_pct", percent("users", total))


def _visit_statistics():
    return [
        ratio(F.sum(F.col("visits") * F.col("users")), F.sum("users")).alias("mean_visits"),
        quantile("visits", 0.5, "users").alias("median_visits"),
        F.min("visits").alias("min_visits"),
        F.max("visits").alias("max_visits"),
        F.sum("users").alias("users"),
    ]


def visits_summary(t: HotelTables) -> DataFrame:
    """Visits before booking per currency, with bookings, value, revenue and guests."""
    return _currency_histogram(t).groupBy("hotel_id", "currency").agg(
        *_visit_statistics(),
        F.sum("bookings").alias("bookings"),
        ratio(F.sum("revenue"), F.sum("bookings")).alias("avg_value"),
        F.sum("revenue").cast("double").alias("revenue"),
        F.sum("adults").alias("adults"),
        F.sum("children").alias("children"),
    )


def visits_levels(t: HotelTables) -> DataFrame:
    """Visits before booking per currency and over all, from one pass: ``level`` is 0 for a currency's row and 1 for
    the property's, whose ``currency`` is NULL.

    A visitor's rows by currency have the same visits, so each visitor counts once at either level.
    """
    users = _booked_with_visits(t, "currency")
    levels = users.groupingSets([[*USER, "currency"], [*USER]], *USER, "currency").agg(
        F.grouping("currency").cast("int").alias("level"),
        F.max("visits").alias("visits"),
        F.sum("bookings").alias("bookings"),
        F.sum("revenue").alias("revenue"),
    )
    histogram = levels.groupBy("hotel_id", "level", "currency", "visits").agg(
        F.count(F.lit(1)).alias("users"), F.sum("bookings").alias("bookings"), F.sum("revenue").alias("revenue")
    )
    return histogram.groupBy("hotel_id", "level", "currency").agg(
        *_visit_statistics(), F.sum("bookings").alias("bookings"), F.sum("revenue").cast("double").alias("revenue")
    )


def visits_overall(t: HotelTables) -> DataFrame:
    """Visits before booking over all currencies, each visitor once."""
    histogram = _booked_with_visits(t).groupBy("hotel_id", "visits").agg(
        F.count(F.lit(1)).alias("users"), F.sum("bookings").alias("bookings")
    )
    return histogram.groupBy("hotel_id").agg(*_visit_statistics(), F.sum("bookings").alias("bookings"))


# -- repeat bookers ----------------------------------------------------------------------------------------


def _repeat_cells(t: HotelTables, *dimensions: str) -> DataFrame:
    """Bookings of repeat bookers per visitor, currency and session columns, with the visitor's total.

    The window sees one row per combination of currency and dimensions of a visitor, not one per booking.
    """
    cells = _bookings_per_user(t, *dimensions)
    total = F.sum("bookings").over(Window.partitionBy(*USER))
    return cells.withColumn("booking_count", total).where(F.col("booking_count") > 1)


def _repeat_by_source(t: HotelTables) -> DataFrame:
    cells = _repeat_cells(t, "utm_source", "utm_medium").groupBy("hotel_id", "utm_source", "utm_medium", "currency")
    return cells.agg(
        F.count(F.lit(1)).alias("users"),  # a cell is one visitor
        *[F.sum(c).alias(c) for c in ("bookings", "revenue", "adults", "children")],
    )


def repeat_bookers(t: HotelTables) -> DataFrame:
    """Bookings, distinct visitors, revenue and guests of repeat bookers by source, medium and currency."""
    return _repeat_by_source(t).withColumns(
        {"avg_value": ratio("revenue", "bookings"), "revenue": F.col("revenue").cast("double")}
    )


def repeat_totals(t: HotelTables) -> DataFrame:
    """Bookings, revenue and guests of repeat bookers per currency."""
    return _repeat_by_source(t).groupBy("hotel_id", "currency").agg(
        F.sum("bookings").alias("bookings"),
        F.sum("revenue").cast("double").alias("revenue"),
        F.sum(guests()).alias("guests"),
        F.sum("adults").alias("adults"),
        F.sum("children").alias("children"),
    )


def booking_counts(t: HotelTables) -> DataFrame:
    """Bookings per visitor, all visitors who booked."""
    per_session = converted(t).groupBy("hotel_id", "search_log_session_id").agg(F.count(F.lit(1)).alias("n"))
    joined = join_sessions(per_session, t, "uuid").where(F.col("uuid").isNotNull())
    return joined.groupBy(*USER).agg(F.sum("n").alias("booking_count"))


def booking_frequency(t: HotelTables) -> DataFrame:
    """How many repeat bookers booked two, three, … times."""
    repeat = booking_counts(t).where(F.col("booking_count") > 1)
    return repeat.groupBy("hotel_id", "booking_count").agg(F.count(F.lit(1)).alias("users"))


def _top_cells(t: HotelTables, k: int, *dimensions: str) -> DataFrame:
    """Cells of the ``k`` visitors with most bookings, found in the cells themselves: one pass over the bookings."""
    order = [F.desc("booking_count"), F.asc("uuid")]
    return top_k(_repeat_cells(t, *dimensions), ["hotel_id"], order, k, dense=True)


def top_bookers(t: HotelTables, k: int = 5) -> DataFrame:
    """The ``k`` visitors with most bookings: bookings, spend and guests per currency."""
    return _top_cells(t, k).select(
        "hotel_id",
        "rank",
        "uuid",
        "booking_count",
        "currency",
        "bookings",
        F.col("revenue").cast("double").alias("revenue"),
        ratio("revenue", "bookings").alias("avg_value"),
        guests().alias("guests"),
        "adults",
        "children",
    )


def top_booker_sources(t: HotelTables, k: int = 5) -> DataFrame:
    """Bookings of the ``k`` top visitors by source."""
    by_source = _top_cells(t, k, "utm_source").groupBy(*USER, "utm_source").agg(F.sum("bookings").alias("bookings"))
    return by_source.where(F.col("bookings") > 0)
