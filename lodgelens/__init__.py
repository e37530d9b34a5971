"""Booking and marketing analytics for accommodation data, written on Spark SQL and Spark ML.

Every analysis is a function from a :class:`~lodgelens.tables.HotelTables` to a DataFrame.  Nothing runs
until the caller acts on the result; ``hotel_id`` is the first key of every join, group and window, so the
same code serves one property's export and a partitioned history of many.
"""

from lodgelens.tables import HotelTables

__all__ = ["HotelTables"]
