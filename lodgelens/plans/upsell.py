"""Upsell products: counts by segment, revenue tiers, revenue by segment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgelens.operators.cells import spread
from lodgelens.operators.segments import converted, in_currencies, picked, with_segment
from lodgelens.operators.tiers import add_tier
from lodgelens.schema import CURRENCIES, SEGMENTS
from lodgelens.tables import HotelTables

Currencies = tuple[str, ...] | None


def _booked_upsell(t: HotelTables, currencies: Currencies, segment: bool) -> DataFrame:
    """Upsell of converted searches that have a booking record: one row per search and product.

    Upsell rows are summed per search and product, booking records counted per search, so every side of the
    two joins has unique keys.  A search with several booking records counts each product as many times.
    """
    searches = picked(in_currencies(converted(t), currencies), "hotel_id", "id", "currency", "adults", "children")
    if segment:
        searches = with_segment(searches, t)
    records = t.booking_data.groupBy("hotel_id", F.col("search_log_id").alias("id")).agg(
        F.count(F.lit(1)).alias("records")
    )
    products = t.upsell_data.groupBy("hotel_id", F.col("search_log_id").alias("id"), "name").agg(
        F.count(F.lit(1)).alias("sold"), F.sum("sum_price").alias("revenue")
    )
    joined = searches.join(records, ["hotel_id", "id"]).join(products, ["hotel_id", "id"])
    return joined.withColumn("sold", F.col("sold") * F.col("records")).withColumn(
        "revenue", F.col("revenue") * F.col("records")
    )


def upsell_cells(t: HotelTables, currencies: Currencies = CURRENCIES) -> DataFrame:
    """Times sold and revenue per currency, segment and product."""
    rows = _booked_upsell(t, currencies, segment=True)
    return rows.groupBy("hotel_id", "currency", "segment", "name").agg(
        F.sum("sold").alias("sold"), F.sum("revenue").alias("revenue")
    )


def upsell_by_segment(t: HotelTables, currencies: Currencies = CURRENCIES) -> DataFrame:
    """Times sold: one row per product, one column per segment, and the total."""
    wide = spread(
        upsell_cells(t, currencies),
        ["hotel_id", "currency", "name"],
        "segment",
        SEGMENTS,
        {"sold": F.sum("sold")},
        fill=0,
    )
    total = sum((F.col(s) for s in SEGMENTS[1:]), F.col(SEGMENTS[0]))
    return wide.withColumn("total", total).where(F.col("total") > 0)


def upsell_levels(t: HotelTables, currencies: Currencies = CURRENCIES) -> DataFrame:
    """Times sold and revenue per product and segment with all margins, from one pass over the cells.

    ``level`` is 0 for a cell, 1 for a product over all segments, 2 for a segment over all products, 3 for the currency;
    what is summed over is NULL.
    """
    keys = ["hotel_id", "currency", "name", "segment"]
    margins = [keys, keys[:3], [*keys[:2], "segment"], keys[:2]]
    level = F.grouping("name") * 2 + F.grouping("segment")
    return upsell_cells(t, currencies).groupingSets(margins, *keys).agg(
        level.cast("int").alias("level"), F.sum("sold").alias("sold"), F.sum("revenue").cast("double").alias("revenue")
    )


def upsell_revenue(t: HotelTables, currencies: Currencies = CURRENCIES) -> DataFrame:
    return upsell_cells(t, currencies).select(
        "hotel_id", "currency", "segment", "name", F.col("revenue").cast("double").alias("revenue")
    )


def upsell_revenue_tiers(
    t: HotelTables, currencies: Currencies = CURRENCIES, all_products: bool = False
) -> DataFrame:
    """Revenue per product with its tercile among the products sold in that currency.

    ``all_products`` cuts the terciles over every product name of the property, those without sales in the
    currency counting as zero; such rows take part in the cut and are then left out.
    """
    by = ["hotel_id", "currency"]
    items = _booked_upsell(t, currencies, segment=False).groupBy(*by, "name").agg(F.sum("revenue").alias("revenue"))
    if all_products:
        names = t.upsell_data.select("hotel_id", "name").distinct()
        grid = items.select(*by).distinct().join(names, "hotel_id")
        items = grid.join(items, [*by, "name"], "left").withColumn("revenue", F.coalesce("revenue", F.lit(0)))
    tiers = add_tier(items, by, "revenue")
    return tiers.where(F.col("revenue") > 0).select(
        *by, "name", "tier", F.col("revenue").cast("double").alias("revenue")
    )
