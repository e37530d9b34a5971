"""Searches, bookings and their guest segment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgelens.functions.columns import segment_label
from lodgelens.schema import CURRENCIES, TODDLER_MAX_AGE
from lodgelens.tables import HotelTables


def toddler_searches(t: HotelTables) -> DataFrame:
    """Keys of the searches with a child of at most two years in one of their rooms.

    The age filter reaches the scan; rooms with a toddler are made distinct before the exchange, so each key
    meets the room table once.
    """
    infants = (
        t.search_log_room_child.where(F.col("age") <= TODDLER_MAX_AGE)
        .select("hotel_id", F.col("search_log_room_id").alias("id"))
        .distinct()
    )
    rooms = t.search_log_room.select("hotel_id", "id", "search_log_id")
    return rooms.join(infants, ["hotel_id", "id"], "left_semi").select("hotel_id", "search_log_id").distinct()


def with_segment(searches: DataFrame, t: HotelTables) -> DataFrame:
    """Add the guest segment to search rows; needs ``id``, ``adults`` and ``children``.

    Rows that carry a segment already (see :func:`with_stored_segment`) are returned as they are.
    """
    if "segment" in searches.columns:
        return searches
    flags = toddler_searches(t).select("hotel_id", F.col("search_log_id").alias("id"), F.lit(True).alias("_toddler"))
    return (
        searches.join(flags, ["hotel_id", "id"], "left")
        .withColumn("segment", segment_label("adults", "children", "_toddler"))
        .drop("_toddler")
    )


def with_stored_segment(t: HotelTables) -> HotelTables:
    """The same tables with the segment as a column of the search log.

    Persist that table, or write the set with ``store.write_store``, and every later analysis skips the joins to
    rooms and children.
    """
    return t.replaced(search_log=with_segment(t.search_log, t))


def picked(searches: DataFrame, *columns: str | Column) -> DataFrame:
    """The listed columns, and the stored segment where there is one."""
    return searches.select(*columns, *(["segment"] if "segment" in searches.columns else []))


def converted(t: HotelTables) -> DataFrame:
    """Search rows that ended in a booking, by the flag of the search log."""
    return t.search_log.where(F.col("conversion") == 1)


def recorded(t: HotelTables) -> DataFrame:
    """Search rows that have a booking record.

    Adaptive execution cannot split the right side of a semi-join, so a search with very many records is merged
    to one key first; the distinct step and the join share one exchange.
    """
    ids = t.booking_data.select("hotel_id", F.col("search_log_id").alias("id")).distinct()
    return t.search_log.join(ids, ["hotel_id", "id"], "left_semi")


def in_currencies(df: DataFrame, currencies: tuple[str, ...] | None = CURRENCIES) -> DataFrame:
    """Rows of the listed currencies; ``None`` keeps every currency found."""
    return df if currencies is None else df.where(F.col("currency").isin(*currencies))


def bookings_with_segment(t: HotelTables, currencies: tuple[str, ...] | None = None) -> DataFrame:
    """Converted searches with their segment, the input of most booking analyses."""
    bookings = picked(
        in_currencies(converted(t), currencies),
        "hotel_id",
        "id",
        "search_log_session_id",
        "currency",
        "nights",
        "adults",
        "children",
        F.col("total_price_final").alias("total_price"),
    )
    return with_segment(bookings, t)


def session_columns(t: HotelTables, *columns: str) -> DataFrame:
    """Sessions keyed the way search rows refer to them."""
    return t.search_log_session.select("hotel_id", F.col("id").alias("search_log_session_id"), *columns)


def join_sessions(cells: DataFrame, t: HotelTables, *columns: str, how: str = "inner") -> DataFrame:
    """Attach session columns to rows keyed by ``(hotel_id, search_log_session_id)``.

    Callers reduce their rows to one per session and dimension first, so a session that made a large share of
    all searches arrives here as a handful of rows.
    """
    return cells.join(session_columns(t, *columns), ["hotel_id", "search_log_session_id"], how)
