"""The eleven input tables, their column kinds, and the fixed value lists of the domain."""

from __future__ import annotations

from pyspark.sql import types as T

# Column kinds.  ``id`` and ``int`` may not be null in the raw files; ``label`` columns have nulls replaced
# by the text "0" and numeric kinds by 0; ``text`` and the two time kinds keep their nulls.
SPARK_TYPE: dict[str, T.DataType] = {
    "id": T.LongType(),
    "int": T.IntegerType(),
    "money": T.DecimalType(14, 2),
    "rate": T.DoubleType(),
    "label": T.StringType(),
    "text": T.StringType(),
    "date": T.DateType(),
    "instant": T.TimestampNTZType(),
}
REQUIRED_KINDS = frozenset({"id", "int"})

TABLES: dict[str, dict[str, str]] = {
    "booking_data": {
        "search_log_id": "id",
        "total_price_final": "money",
        "rooms_total_price": "money",
        "upsell_total_price": "money",
        "vouchers_total_price": "int",
        "loyalty_discount_total": "money",
        "redeemed_loyalty_points_total": "money",
    },
    "daily_occupancy": {"recording_date": "date", "subject_date": "date", "fill_rate": "rate"},
    "daily_ppc_budget": {
        "date": "date",
        "daily_google_spend": "int",
        "daily_microsoft_spend": "int",
        "daily_meta_spend": "int",
    },
    "datepicker_daily_visitors": {
        "date": "date",
        "utm_source_and_medium": "label",
        "utm_campaign": "label",
        "user_count": "int",
        "session_count": "int",
    },
    "search_log": {
        "id": "id",
        "search_log_session_id": "id",
        "utc_datetime": "instant",
        "lang_code": "label",
        "currency": "label",
        "arrival": "instant",
        "departure": "instant",
        "days": "int",
        "nights": "int",
        "adults": "int",
        "children": "int",
        "conversion": "rate",
        "total_price_final": "money",
    },
    "search_log_room_child": {"id": "id", "search_log_room_id": "id", "age": "int", "baby_bed": "int"},
    "search_log_room": {
        "id": "id",
        "search_log_id": "id",
        "adults": "int",
        "children": "int",
        "picked_price": "money",
        "picked_room": "label",
    },
    "search_log_room_offer": {
        "id": "id",
        "search_log_id": "id",
        "search_log_room_id": "id",
        "room_code": "label",
        "room_price_min": "money",
        "room_price_max": "money",
    },
    "search_log_session": {
        "id": "id",
        "uuid": "text",
        "session_id": "id",
        "utm_source": "label",
        "utm_medium": "label",
        "utm_campaign": "label",
    },
    "upsell_data": {
        "search_log_id": "id",
        "upsell_type": "int",
        "name": "label",
        "unit_price": "money",
        "pieces": "int",
        "sum_price": "money",
    },
    "website_daily_users": {
        "date": "date",
        "utm_source_and_medium": "label",
        "utm_campaign": "label",
        "user_count": "int",
        "session_count": "int",
    },
}
TABLE_NAMES = tuple(TABLES)

# Tables whose combined UTM column is split on load; the flag says whether both parts are stripped of blanks.
UTM_SPLIT = {"datepicker_daily_visitors": True, "website_daily_users": False}

# Guest segments, revenue tiers, currencies, paid-click sources.
SEGMENTS = (
    "single",
    "couple",
    "three_adults",
    "four_adults",
    "group_5plus",
    "family_toddler",
    "family_1_child",
    "family_2_children",
    "family_3plus_children",
)
TODDLER_MAX_AGE = 2
REVENUE_TIERS = ("low", "medium", "high")
CURRENCIES = ("HUF", "EUR")
PPC_MEDIUM = "cpc"
PPC_SOURCES = ("google", "facebook", "instagram", "bing")
PPC_PAIRS = tuple(f"{source} / {PPC_MEDIUM}" for source in PPC_SOURCES)
SPEND_PLATFORMS = {
    "google": "daily_google_spend",
    "bing": "daily_microsoft_spend",
    "meta": "daily_meta_spend",
}
NOT_SET = "(not set)"
UNKNOWN = "unknown"


def clean_schema(table: str) -> T.StructType:
    """Schema of a cleaned table, derived UTM columns and ``hotel_id`` included."""
    fields = [T.StructField("hotel_id", T.LongType(), False)]
    fields += [T.StructField(name, SPARK_TYPE[kind]) for name, kind in TABLES[table].items()]
    if table in UTM_SPLIT:
        fields += [T.StructField("utm_source", T.StringType()), T.StructField("utm_medium", T.StringType())]
    return T.StructType(fields)
