from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lodgelens.operators.segments import bookings_with_segment, toddler_searches
from lodgelens.plans import funnel, leadtime, ppc, pricing, profile, rooms, segments, upsell, visits

NOON = datetime(2024, 5, 1, 12)


def at(hours):
    return NOON + timedelta(hours=hours)


def search(i, session=1, hours=0, conversion=1.0, currency="HUF", adults=2, children=0, price="100.00", **more):
    return {
        "id": i, "search_log_session_id": session, "utc_datetime": at(hours), "arrival": at(hours) + timedelta(days=10),
        "currency": currency, "lang_code": "hu", "nights": 2, "adults": adults, "children": children,
        "conversion": conversion, "total_price_final": Decimal(price), **more,
    }


def session(i, uuid="u1", source="google", medium="cpc", campaign="spring", **more):
    return {"id": i, "uuid": uuid, "utm_source": source, "utm_medium": medium, "utm_campaign": campaign, **more}


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


# -- segments ----------------------------------------------------------------------------------------------


def test_segment_looks_through_rooms_to_children(make_tables):
    t = make_tables(
        search_log=[search(1, children=1), search(2, children=1), search(3, children=1), search(1, children=1, hotel_id=2)],
        search_log_room=[
            {"id": 10, "search_log_id": 1}, {"id": 11, "search_log_id": 1}, {"id": 20, "search_log_id": 2},
            {"id": 10, "search_log_id": 1, "hotel_id": 2},
        ],
        search_log_room_child=[
            {"search_log_room_id": 10, "age": 9}, {"search_log_room_id": 11, "age": 2}, {"search_log_room_id": 20, "age": 3},
            {"search_log_room_id": 10, "age": 8, "hotel_id": 2},
        ],
    )
    assert rows(toddler_searches(t), "hotel_id", "search_log_id") == [(1, 1)]
    assert rows(bookings_with_segment(t), "hotel_id", "id", "segment") == [
        (1, 1, "family_toddler"), (1, 2, "family_1_child"), (1, 3, "family_1_child"), (2, 1, "family_1_child"),
    ]


def test_costs_are_ratios_of_means(make_tables):
    t = make_tables(
        search_log=[search(1, nights=1, price="100"), search(2, nights=9, price="200"), search(3, conversion=0.0)],
        search_log_room=[], search_log_room_child=[],
    )
    row = segments.segment_stats(t).first()
    assert (row["bookings"], row["avg_price"], row["avg_nights"]) == (2, 150, 5)
    assert row["cost_per_night"] == 30 and row["cost_per_person"] == 75
    assert rows(segments.segment_revenue(t), "segment", "revenue", "revenue_share_pct") == [("couple", 300, 100)]


def test_campaigns(make_tables):
    bookings = [search(i, session=i) for i in range(1, 9)]
    sessions = [session(i, campaign=c) for i, c in enumerate("aabcdef", 1)]  # session 8 is unknown
    t = make_tables(search_log=bookings, search_log_session=sessions, search_log_room=[], search_log_room_child=[])
    top = segments.top_campaigns(t)
    assert rows(top, "rank", "utm_campaign", "bookings") == [
        (1, "a", 2), (2, "(not set)", 1), (3, "b", 1), (4, "c", 1), (5, "d", 1),
    ]
    assert top.where("utm_campaign = 'a'").first()["share_pct"] == pytest.approx(100 * 2 / 6)  # among the five
    summary = segments.campaign_summary(t).first()
    assert (summary["bookings"], summary["active_campaigns"]) == (8, 7)
    assert summary["largest_share_pct"] == 25
    shares = segments.campaign_by_segment(t).groupBy("segment").agg(F.sum("share_pct").alias("s")).first()
    assert shares["s"] == pytest.approx(100)


# -- visits ------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def visitors(make_tables):
    return make_tables(
        search_log=[
            search(1, 1, 0, 0.0), search(2, 2, 1, 0.0), search(3, 1, 2, currency="EUR"), search(4, 2, 3, 0.0),
            search(5, 1, 4), search(6, 3, 5), search(7, 3, 5, 0.0), search(8, 4, 6, 0.0), search(9, 9, 0),
            search(1, 1, 9, hotel_id=2),
        ],
        search_log_session=[
            session(1), session(2, source="bing"), session(3, uuid="u2"), session(4, uuid="u3"), session(1, hotel_id=2),
        ],
    )


def test_visits_before_the_first_booking(visitors):
    # u1: two searches before the booking in EUR; the later booking does not matter.
    # u2: a search at the same instant as the booking is not before it.  u3 never booked.
    got = rows(visits.visits_before_booking(visitors), "hotel_id", "uuid", "visits")
    assert got == [(1, "u1", 2), (1, "u2", 0), (2, "u1", 0)]


def test_a_visitor_counts_in_each_currency(visitors):
    got = rows(visits.visits_summary(visitors).where("hotel_id = 1"), "currency", "users", "mean_visits", "bookings")
    assert got == [("EUR", 1, 2, 1), ("HUF", 2, 1, 2)]
    overall = visits.visits_overall(visitors).where("hotel_id = 1").first()
    assert (overall["users"], overall["bookings"], overall["mean_visits"]) == (2, 3, 1)


def test_repeat_bookers(visitors):
    got = rows(visits.repeat_bookers(visitors), "utm_source", "currency", "bookings", "users", "revenue")
    assert got == [("google", "EUR", 1, 1, 100), ("google", "HUF", 1, 1, 100)]
    assert rows(visits.booking_frequency(visitors), "booking_count", "users") == [(2, 1)]
    assert rows(visits.top_bookers(visitors), "rank", "uuid", "currency", "bookings", "guests") == [
        (1, "u1", "EUR", 1, 2), (1, "u1", "HUF", 1, 2),
    ]
    assert rows(visits.top_booker_sources(visitors), "uuid", "utm_source", "bookings") == [("u1", "google", 2)]
    assert rows(visits.repeat_totals(visitors), "currency", "bookings", "guests") == [("EUR", 1, 2), ("HUF", 1, 2)]


# -- prices ------------------------------------------------------------------------------------------------


def booking(i, total, rooms="100", upsell="10", vouchers=5, **more):
    return {
        "search_log_id": i, "total_price_final": Decimal(total), "rooms_total_price": Decimal(rooms),
        "upsell_total_price": Decimal(upsell), "vouchers_total_price": vouchers, "loyalty_discount_total": Decimal(0),
        "redeemed_loyalty_points_total": Decimal(0), **more,
    }


def test_price_reconciliation(make_tables):
    t = make_tables(
        booking_data=[booking(1, "105"), booking(2, "106"), booking(3, "104"), booking(99, "1")],
        search_log=[search(1), search(2), search(3, currency="EUR")],
    )
    got = rows(pricing.price_reconciliation(t), "currency", "bookings", "diff_count", "diff_sum")
    assert got == [("EUR", 1, 1, 1), ("HUF", 2, 1, -1)]
    series = rows(pricing.price_diff_series(t), "search_log_id", "diff", "sign")
    assert series == [(2, -1, "shortfall"), (3, 1, "surplus")]
    assert rows(pricing.price_reconciliation(t, tolerance=2), "currency", "diff_count") == [("EUR", 0), ("HUF", 0)]


def test_top_differences_skip_currencies_without_any(make_tables):
    t = make_tables(
        booking_data=[booking(i, 105 - (i if i < 7 else 0)) for i in range(1, 9)] + [booking(20, "105")],
        search_log=[search(i) for i in range(1, 9)] + [search(20, currency="EUR")],
    )
    got = rows(pricing.price_diff_top(t), "currency", "rank", "search_log_id", "diff")
    assert got == [("HUF", 1, 6, 6), ("HUF", 2, 5, 5), ("HUF", 3, 4, 4), ("HUF", 4, 3, 3), ("HUF", 5, 2, 2)]


def test_double_prices_get_a_tolerance(make_tables):
    t = make_tables(booking_data=[booking(1, "105")], search_log=[search(1)])
    as_double = t.booking_data.select(
        "hotel_id", "search_log_id", "vouchers_total_price",
        *[F.col(c).cast("double").alias(c) for c in t.booking_data.columns if c not in ("hotel_id", "search_log_id", "vouchers_total_price")],
    ).withColumn("total_price_final", F.lit(105.0000001))
    got = pricing.price_reconciliation(t.replaced(booking_data=as_double))
    assert rows(got, "currency", "diff_count") == [("HUF", 0)]


def test_booking_stats(make_tables):
    t = make_tables(search_log=[search(1), search(2, conversion=0.0), search(3, currency="EUR", price="50", lang_code="de")])
    got = rows(pricing.booking_stats(t), "dimension", "value", "searches", "bookings", "avg_value")
    assert got == [
        ("all", "all", 3, 2, 75), ("currency", "EUR", 1, 1, 50), ("currency", "HUF", 2, 1, 100),
        ("language", "de", 1, 1, 50), ("language", "hu", 2, 1, 100),
    ]


# -- upsell ------------------------------------------------------------------------------------------------


def test_upsell_counts_every_booking_record(make_tables):
    t = make_tables(
        search_log=[search(1), search(2, adults=1), search(3, conversion=0.0)],
        search_log_room=[], search_log_room_child=[],
        booking_data=[booking(1, "1"), booking(1, "1"), booking(2, "1"), booking(3, "1")],
        upsell_data=[
            {"search_log_id": 1, "name": "wine", "sum_price": Decimal(5)},
            {"search_log_id": 1, "name": "wine", "sum_price": Decimal(6)},
            {"search_log_id": 2, "name": "spa", "sum_price": Decimal(7)},
            {"search_log_id": 3, "name": "spa", "sum_price": Decimal(1000)},
        ],
    )
    got = rows(upsell.upsell_by_segment(t), "name", "couple", "single", "total")
    assert got == [("spa", 0, 1, 1), ("wine", 4, 0, 4)]
    assert rows(upsell.upsell_revenue(t), "segment", "name", "revenue") == [("couple", "wine", 22), ("single", "spa", 7)]
    assert rows(upsell.upsell_revenue_tiers(t), "name", "tier") == [("spa", "low"), ("wine", "high")]


def test_tiers_over_all_product_names(make_tables):
    sold = [(1, "a", 1), (1, "b", 2), (2, "z", 9)]
    t = make_tables(
        search_log=[search(1), search(2, currency="EUR")],
        booking_data=[booking(1, "1"), booking(2, "1")],
        upsell_data=[{"search_log_id": s, "name": n, "sum_price": Decimal(v)} for s, n, v in sold],
    )
    huf = upsell.upsell_revenue_tiers(t, all_products=True).where("currency = 'HUF'")
    # cut over 0 (z), 1 (a), 2 (b): edges 0, 2/3, 4/3, 2
    assert rows(huf, "name", "tier") == [("a", "medium"), ("b", "high")]


# -- rooms, paid clicks, lead time, funnel -----------------------------------------------------------------


def test_rooms_weight_bookings_by_room_rows(make_tables):
    t = make_tables(
        search_log=[search(1, price="100"), search(2, price="400"), search(3)],
        search_log_room=[
            {"id": 1, "search_log_id": 1, "picked_room": "A"}, {"id": 2, "search_log_id": 1, "picked_room": "A"},
            {"id": 3, "search_log_id": 1, "picked_room": "B"}, {"id": 4, "search_log_id": 2, "picked_room": "A"},
        ],
        search_log_room_child=[],
        search_log_session=[session(1)],
    )
    got = rows(rooms.room_choice_by_segment(t), "picked_room", "room_rows", "share_pct")
    assert got == [("A", 3, 75), ("B", 1, 25)]
    assert rows(rooms.room_avg_price(t), "picked_room", "google") == [("A", 200), ("B", 100)]
    assert rooms.room_avg_price(t).where("picked_room = 'A'").first()["bing"] is None
    unmatched = rooms.bookings_with_rooms(bookings_with_segment(t), t).where("picked_room is null")
    assert rows(unmatched, "id", "room_rows") == [(3, 1)]


def visit(source, users, day=1, sessions=1):
    return {"date": date(2024, 5, day), "utm_source_and_medium": source, "user_count": users, "session_count": sessions}


def test_conversions_keep_both_sides(make_tables):
    t = make_tables(
        datepicker_daily_visitors=[visit("google / cpc", 4), visit("google / cpc", 6, 2), visit("bing / cpc", 0), visit("direct", 9)],
        search_log=[search(1, 1), search(2, 1), search(3, 2), search(4, 3)],
        search_log_session=[session(1), session(2, source="facebook"), session(3, medium="organic")],
    )
    got = ppc.ppc_conversions(t).orderBy("utm_source").collect()
    assert [(r["utm_source"], r["visitors"], r["bookings"], r["conversion_pct"]) for r in got] == [
        ("facebook", 0, 1, None), ("google", 10, 2, 20),
    ]
    assert rows(ppc.utm_matches(t, with_all_levels=True), "utm_source_and_medium", "n") == [
        ("bing / cpc", 1), ("direct", 0), ("google / cpc", 2),
    ]
    assert rows(ppc.ppc_daily_traffic(t), "utm_source_and_medium", "user_count") == [
        ("bing / cpc", 0), ("google / cpc", 4), ("google / cpc", 6),
    ]


def test_revenue_table_drops_empty_sources(make_tables):
    t = make_tables(
        search_log=[search(1, 1), search(2, 2, price="0")],
        search_log_session=[session(1), session(2, source="bing")],
        search_log_room=[], search_log_room_child=[],
    )
    assert rows(ppc.ppc_revenue_by_segment(t), "utm_source", "bookings", "revenue") == [("google", 1, 100)]
    assert rows(ppc.ppc_revenue_wide(t), "google_bookings", "bing_bookings", "bing_revenue") == [(1, 1, 0)]


def test_lead_time_counts_recorded_bookings(make_tables):
    t = make_tables(
        search_log=[search(1, conversion=0.0), search(2, arrival=at(-1)), search(3)],
        booking_data=[booking(1, "1"), booking(1, "1"), booking(2, "1")],
        search_log_room=[], search_log_room_child=[],
        search_log_session=[session(1)],
    )
    row = leadtime.lead_time_by_segment(t).first()
    assert (row["bookings"], row["min"], row["max"], row["mean"]) == (2, -1, 10, 4.5)
    assert rows(leadtime.lead_time_monthly(t), "segment", "m5") == [("couple", 4.5)]
    assert rows(leadtime.bookings_by_source(t), "utm_source_and_medium", "bookings") == [("google / cpc", 2)]


def test_both_funnels(make_tables):
    t = make_tables(
        website_daily_users=[visit("x", 100)],
        datepicker_daily_visitors=[visit("x", 50)],
        search_log=[search(1, 1), search(2, 1, conversion=0.0), search(3, 2, conversion=0.0)],
        booking_data=[booking(1, "1"), booking(2, "1")],
    )
    by_session = rows(funnel.funnel(t), "stage_no", "users", "step_pct", "from_start_pct")
    assert by_session == [(1, 100, 100, 100), (2, 50, 50, 50), (3, 2, 4, 2), (4, 2, 100, 2)]
    assert rows(funnel.funnel(t, "rows"), "stage_no", "users") == [(1, 100), (2, 50), (3, 3), (4, 1)]
    with pytest.raises(ValueError):
        funnel.funnel(t, "other")


def test_profiles(make_tables):
    from lodgelens.schema import TABLE_NAMES

    t = make_tables(**{**dict.fromkeys(TABLE_NAMES, []), "daily_occupancy": [{"fill_rate": 1.0}, {"fill_rate": 1.0}, {"fill_rate": 3.0}]})
    shown = profile.profile_tables(t).where("table_name = 'daily_occupancy'")
    assert rows(shown, "position", "column_name", "data_type", "row_count")[-1] == (4, "fill_rate", "double", 3)
    quality = profile.data_quality(t).collect()
    assert [tuple(r) for r in quality] == [(1, "daily_occupancy", 6, 3, 1)]
    assert len(profile.first_rows(t)["daily_occupancy"].collect()) == 3


def test_rows_that_differ_in_which_value_is_missing_are_no_duplicates(make_tables):
    pair = [{"utm_source": "x", "utm_medium": None}, {"utm_source": None, "utm_medium": "x"}]
    t = make_tables(search_log_session=[*pair, *pair, {"utm_source": "x", "utm_medium": "x"}])
    found = profile.data_quality(t, ("search_log_session",)).first()
    assert (found["row_count"], found["duplicate_rows"]) == (5, 2)
