"""Which rooms guests pick, by segment and by paid-click source.

Bookings are matched to their rooms, so every figure here counts room rows: a booking of three rooms counts
three times, in the mean price too.  Shares are windows over cells: a property's room names are a catalogue.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgelens.functions.columns import is_paid_click, ratio
from lodgelens.operators.cells import add_share, spread
from lodgelens.operators.segments import bookings_with_segment, converted, in_currencies, join_sessions
from lodgelens.schema import CURRENCIES, PPC_SOURCES
from lodgelens.tables import HotelTables

Currencies = tuple[str, ...] | None


def _rooms_per_search(t: HotelTables) -> DataFrame:
    """Room rows reduced to one per search and room name; rows without a name carry no choice."""
    rooms = t.search_log_room.where(F.col("picked_room").isNotNull())
    return rooms.groupBy("hotel_id", F.col("search_log_id").alias("id"), "picked_room").agg(
        F.count(F.lit(1)).alias("room_rows")
    )


def bookings_with_rooms(bookings: DataFrame, t: HotelTables) -> DataFrame:
    """Left join of bookings to their rooms: bookings without a room row stay, with a NULL room."""
    return bookings.join(_rooms_per_search(t), ["hotel_id", "id"], "left").withColumn(
        "room_rows", F.coalesce("room_rows", F.lit(1))
    )


def room_choice_by_segment(t: HotelTables, currencies: Currencies = CURRENCIES) -> DataFrame:
    """Room rows per segment and room, with the room's percent of the segment."""
    rows = bookings_with_rooms(bookings_with_segment(t, currencies), t).where(F.col("picked_room").isNotNull())
    cells = rows.groupBy("hotel_id", "currency", "segment", "picked_room").agg(F.sum("room_rows").alias("room_rows"))
    return add_share(cells, "room_rows", ["hotel_id", "currency", "segment"])


def _rooms_by_source(t: HotelTables, currencies: Currencies) -> DataFrame:
    """Cells (currency, room, source) of paid-click bookings: room rows, and price summed over room rows.

    Rooms are joined first and the result reduced per session, so the session join sees few rows per session.
    """
    bookings = in_currencies(converted(t), currencies).select(
        "hotel_id", "id", "search_log_session_id", "currency", F.col("total_price_final").alias("price")
    )
    rows = bookings_with_rooms(bookings, t).where(F.col("picked_room").isNotNull())
    per_session = rows.groupBy("hotel_id", "search_log_session_id", "currency", "picked_room").agg(
        F.sum("room_rows").alias("room_rows"), F.sum(F.col("price") * F.col("room_rows")).alias("price")
    )
    clicked = join_sessions(per_session, t, "utm_source", "utm_medium").where(
        is_paid_click("utm_source", "utm_medium")
    )
    return clicked.groupBy("hotel_id", "currency", "picked_room", "utm_source").agg(
        F.sum("room_rows").alias("room_rows"), F.sum("price").alias("price")
    )


def room_choice_by_source(t: HotelTables) -> DataFrame:
    """Room rows per room and source over all currencies, with the room's percent of the source."""
    cells = _rooms_by_source(t, None).groupBy("hotel_id", "picked_room", "utm_source").agg(
        F.sum("room_rows").alias("room_rows")
    )
    return add_share(cells, "room_rows", ["hotel_id", "utm_source"])


def room_choice_by_source_and_currency(t: HotelTables, currencies: Currencies = CURRENCIES) -> DataFrame:
    cells = _rooms_by_source(t, currencies)
    shared = add_share(cells, "room_rows", ["hotel_id", "currency", "utm_source"])
    return shared.withColumn("avg_price", ratio("price", "room_rows")).drop("price")


def room_avg_price(t: HotelTables, currencies: Currencies = CURRENCIES) -> DataFrame:
    """Mean booking value per room, one column per source; NULL where a source never chose the room."""
    return spread(
        _rooms_by_source(t, currencies),
        ["hotel_id", "currency", "picked_room"],
        "utm_source",
        PPC_SOURCES,
        {"avg_price": ratio(F.sum("price"), F.sum("room_rows"))},
    )
