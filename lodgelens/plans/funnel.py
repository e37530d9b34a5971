"""Conversion funnels: from website visit to booking, as a whole and by currency."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgelens.functions.columns import percent
from lodgelens.operators.cells import add_share
from lodgelens.tables import HotelTables

# Stage names in funnel order.
STAGES = ("website_visits", "datepicker_usage", "searches", "bookings")


def stage_counts(t: HotelTables, definition: str = "sessions") -> DataFrame:
    """One row per property with the size of each stage.

    ``sessions`` counts distinct searching sessions and booking records, ``rows`` counts search rows and
    search rows flagged as converted.
    """
    visits = t.website_daily_users.groupBy("hotel_id").agg(F.sum("user_count").alias("n"))
    pickers = t.datepicker_daily_visitors.groupBy("hotel_id").agg(F.sum("user_count").alias("n"))
    if definition == "sessions":
        # Two exact steps: distinct (property, session) pairs spread over all tasks, then one count each.
        pairs = t.search_log.select("hotel_id", "search_log_session_id").distinct()
        searches = pairs.groupBy("hotel_id").agg(F.count(F.lit(1)).alias("n"))
        bookings = t.booking_data.groupBy("hotel_id").agg(F.count(F.lit(1)).alias("n"))
        parts = [(0, visits), (1, pickers), (2, searches), (3, bookings)]
    elif definition == "rows":
        both = t.search_log.groupBy("hotel_id").agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.col("conversion") == 1).alias("n3")
        )
        parts = [(0, visits), (1, pickers)]
    else:
        raise ValueError(f"definition must be 'sessions' or 'rows', not {definition!r}")

    tagged = [
        df.select("hotel_id", *[(F.col("n") if i == stage else F.lit(0)).cast("long").alias(s) for i, s in enumerate(STAGES)])
        for stage, df in parts
    ]
    if definition == "rows":
        zero = F.lit(0).cast("long")
        tagged.append(both.select("hotel_id", zero.alias(STAGES[0]), zero.alias(STAGES[1]), F.col("n").alias(STAGES[2]), F.col("n3").alias(STAGES[3])))
    stacked = reduce(DataFrame.unionByName, tagged)
    return stacked.groupBy("hotel_id").agg(*[F.sum(s).alias(s) for s in STAGES])


def funnel(t: HotelTables, definition: str = "sessions") -> DataFrame:
    """Stage, users, percent of the stage before and percent of the first stage, per property."""
    counts = stage_counts(t, definition)
    rows = [
        F.struct(
            F.lit(i + 1).alias("stage_no"),
            F.lit(stage).alias("stage"),
            F.col(stage).alias("users"),
            (F.lit(100.0) if i == 0 else percent(stage, STAGES[i - 1])).alias("step_pct"),
            (F.lit(100.0) if i == 0 else percent(stage, STAGES[0])).alias("from_start_pct"),
        )
        for i, stage in enumerate(STAGES)
    ]
    return counts.select("hotel_id", F.inline(F.array(*rows)))


def funnel_rates(t: HotelTables, definition: str = "sessions") -> DataFrame:
    """The named conversion rates of the funnel, one row per property."""
    visits, pickers, searches, bookings = STAGES
    return stage_counts(t, definition).select(
        "hotel_id",
        percent(pickers, visits).alias("visit_to_datepicker_pct"),
        percent(searches, pickers).alias("datepicker_to_search_pct"),
        percent(bookings, searches).alias("search_to_booking_pct"),
        percent(bookings, pickers).alias("datepicker_to_booking_pct"),
        percent(bookings, visits).alias("visit_to_booking_pct"),
    )


def funnel_by_currency(t: HotelTables) -> DataFrame:
    """Searches and bookings per currency, conversion rate, and share of the property's totals."""
    cells = t.search_log.groupBy("hotel_id", "currency").agg(
        F.count(F.lit(1)).alias("searches"), F.count_if(F.col("conversion") == 1).alias("bookings")
    )
    shared = add_share(cells, "searches", ["hotel_id"], "search_share_pct")
    shared = add_share(shared, "bookings", ["hotel_id"], "booking_share_pct")
    return shared.withColumn("conversion_pct", percent("bookings", "searches"))
