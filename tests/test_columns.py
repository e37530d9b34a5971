from datetime import datetime
from math import cos, pi, sin

import pytest
from pyspark.sql import functions as F

from lodgelens.functions import columns as c


def one(spark, column, **values):
    frame = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return frame.select(column).first()[0]


def parts(spark, text, trim):
    frame = spark.createDataFrame([(text,)], "pair string")
    return tuple(frame.select(*c.utm_parts("pair", trim)).first())


@pytest.mark.parametrize(
    "text, expected",
    [
        ("google / cpc", ("google", "cpc")),
        ("direct", ("direct", "unknown")),
        (None, ("unknown", "unknown")),
        ("a/b/c", ("a", "b/c")),
    ],
)
def test_utm_parts_trimmed(spark, text, expected):
    assert parts(spark, text, True) == expected


def test_utm_parts_keep_blanks_when_not_trimmed(spark):
    assert parts(spark, "google / cpc", False) == ("google ", " cpc")


@pytest.mark.parametrize(
    "arrival, days",
    [
        (datetime(2024, 5, 2), 0),  # 14 hours ahead
        (datetime(2024, 5, 1), -1),  # 10 hours past
        (datetime(2024, 5, 4), 2),
        (datetime(2024, 5, 1, 10), 0),
        (datetime(2024, 5, 1, 9, 59, 59, 999999), -1),  # a microsecond past
        (datetime(2024, 5, 2, 10), 1),
    ],
)
def test_lead_time_floors(spark, arrival, days):
    frame = spark.createDataFrame([(datetime(2024, 5, 1, 10), arrival)], "s timestamp_ntz, a timestamp_ntz")
    assert frame.select(c.lead_time_days("s", "a")).first()[0] == days


def test_ratios(spark):
    assert one(spark, c.ratio("a", "b"), a=1, b=0) is None
    assert one(spark, c.percent("a", "b"), a=1, b=8) == 12.5
    assert one(spark, c.ratio_zero_as_one("a", "b"), a=6, b=0) == 6
    assert one(spark, c.ratio_zero_as_one("a", "b"), a=6, b=3) == 2


@pytest.mark.parametrize(
    "adults, children, toddler, segment",
    [
        (1, 0, None, "single"),
        (2, 0, None, "couple"),
        (3, 0, None, "three_adults"),
        (4, 0, None, "four_adults"),
        (5, 0, None, "group_5plus"),
        (0, 0, None, "group_5plus"),
        (2, 0, True, "couple"),  # no children: a stray child row does not matter
        (2, 1, True, "family_toddler"),
        (2, 3, True, "family_toddler"),
        (2, 1, None, "family_1_child"),
        (2, 2, False, "family_2_children"),
        (2, 3, None, "family_3plus_children"),
    ],
)
def test_segment_label(spark, adults, children, toddler, segment):
    frame = spark.createDataFrame([(adults, children, toddler)], "adults int, children int, t boolean")
    assert frame.select(c.segment_label("adults", "children", "t")).first()[0] == segment


def test_mapping_and_matching(spark):
    assert one(spark, c.source_of_pair("p"), p="bing / cpc") == "bing"
    assert one(spark, c.source_of_pair("p"), p="newsletter / email") == "newsletter / email"
    assert one(spark, c.contains_ignoring_case("p", "CPC"), p="Google / Cpc") is True
    frame = spark.createDataFrame([(None,)], "p string")
    assert frame.select(c.contains_ignoring_case("p", "cpc")).first()[0] is False
    assert one(spark, c.utm_pair("s", "m"), s="google", m="cpc") == "google / cpc"
    assert one(spark, c.first_part("p"), p="ridge_selected") == "ridge"


def test_calendar(spark):
    saturday = spark.sql("select date'2024-06-01' d")
    assert saturday.select(F.weekday("d"), c.is_weekend("d")).first()[:] == (5, 1)
    s, k = c.on_circle("w", 7)
    row = spark.sql("select 3 w").select(s, k).first()
    assert row[0] == pytest.approx(sin(2 * pi * 3 / 7)) and row[1] == pytest.approx(cos(2 * pi * 3 / 7))


def test_report_formats(spark):
    assert one(spark, c.as_amount("x", 2), x=1234567.891) == "1,234,567.89"
    assert one(spark, c.as_percent("x"), x=12.345) == "12.3%"
    assert one(spark, c.rounded("x", 0), x=2.5) == 2.0  # half to even


def test_noise_is_normal_and_independent_of_partitioning(spark):
    text = c.keyed_normal(7, "fill_rate", "id")
    wide = spark.range(20000).repartition(13).selectExpr("id", f"{text} as z").orderBy("id").collect()
    narrow = spark.range(20000).coalesce(1).selectExpr("id", f"{text} as z").orderBy("id").collect()
    assert wide == narrow
    z = [r["z"] for r in wide]
    mean = sum(z) / len(z)
    assert abs(mean) < 0.03 and abs(sum((v - mean) ** 2 for v in z) / len(z) - 1) < 0.05
