"""Scalar functions of the domain."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodgelens.schema import PPC_MEDIUM, PPC_SOURCES, SPEND_PLATFORMS, UNKNOWN

MICROS_PER_DAY = 86_400_000_000
ColumnLike = Column | str


def _c(column: ColumnLike) -> Column:
    return F.col(column) if isinstance(column, str) else column


# -- ratios ------------------------------------------------------------------------------------------------


def ratio(numerator: ColumnLike, denominator: ColumnLike) -> Column:
    """``numerator / denominator`` as a double, NULL on a zero denominator."""
    return F.try_divide(_c(numerator).cast("double"), _c(denominator).cast("double"))


def percent(part: ColumnLike, whole: ColumnLike) -> Column:
    return F.try_divide(_c(part).cast("double") * 100, _c(whole).cast("double"))


def ratio_zero_as_one(numerator: ColumnLike, denominator: ColumnLike) -> Column:
    """Ratio in which a zero denominator counts as one (per-user figures on days without users)."""
    return _c(numerator).cast("double") / F.when(_c(denominator) == 0, 1).otherwise(_c(denominator))


# -- UTM texts ---------------------------------------------------------------------------------------------


def utm_parts(pair: ColumnLike, trim: bool) -> tuple[Column, Column]:
    """Source and medium of ``source / medium``; only the first slash splits, a missing part is ``unknown``."""
    parts = F.split(_c(pair), "/", 2)
    cut = [F.try_element_at(parts, F.lit(i)) for i in (1, 2)]
    if trim:
        cut = [F.trim(c) for c in cut]
    source, medium = (F.coalesce(c, F.lit(UNKNOWN)) for c in cut)
    return source, medium


def utm_pair(source: ColumnLike, medium: ColumnLike) -> Column:
    return F.concat(_c(source), F.lit(" / "), _c(medium))


def source_of_pair(pair: ColumnLike) -> Column:
    """``google / cpc`` → ``google`` for the paid-click pairs; any other text stays as it is."""
    known = F.create_map(*[F.lit(x) for s in PPC_SOURCES for x in (f"{s} / {PPC_MEDIUM}", s)])
    return F.coalesce(F.try_element_at(known, _c(pair)), _c(pair))


def contains_ignoring_case(text: ColumnLike, needle: str) -> Column:
    return F.coalesce(F.contains(F.lower(_c(text)), F.lit(needle.lower())), F.lit(False))


def is_paid_click(source: ColumnLike, medium: ColumnLike, sources: Sequence[str] = PPC_SOURCES) -> Column:
    return (_c(medium) == PPC_MEDIUM) & _c(source).isin(*sources)


def is_pair(source: ColumnLike, medium: ColumnLike, pairs: Sequence[str]) -> Column:
    """Whether ``source / medium`` is one of ``pairs``, as comparisons of plain columns that reach the scan."""
    by_medium: dict[str, list[str]] = {}
    for pair in pairs:
        known_source, _, known_medium = pair.partition(" / ")
        by_medium.setdefault(known_medium, []).append(known_source)
    tests = [(_c(medium) == m) & _c(source).isin(*sources) for m, sources in by_medium.items()]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def first_part(text: ColumnLike, separator: str = "_") -> Column:
    return F.split_part(_c(text), F.lit(separator), F.lit(1))


# -- times -------------------------------------------------------------------------------------------------


def lead_time_days(searched_at: ColumnLike, arrival: ColumnLike) -> Column:
    """Whole days from search to arrival, floored: ten hours in the past is −1."""
    micros = F.timestamp_diff("MICROSECOND", _c(searched_at), _c(arrival))
    return F.floor(micros / MICROS_PER_DAY).cast("int")


def is_weekend(date: ColumnLike) -> Column:
    return (F.weekday(_c(date)) >= 5).cast("int")


def on_circle(position: ColumnLike, period: int) -> tuple[Column, Column]:
    """Sine and cosine of a cyclic position, so that the end of a cycle lies next to its start."""
    angle = _c(position) * F.lit(2 * pi) / period
    return F.sin(angle), F.cos(angle)


# -- bookings ----------------------------------------------------------------------------------------------


def segment_label(adults: ColumnLike, children: ColumnLike, has_toddler: ColumnLike) -> Column:
    """Guest segment.  Without children the adults decide, every number outside 1..4 (zero too) being a
    large group; with children a toddler decides first, then their number."""
    adults, children = _c(adults), _c(children)
    no_children = (
        F.when(adults == 1, "single")
        .when(adults == 2, "couple")
        .when(adults == 3, "three_adults")
        .when(adults == 4, "four_adults")
        .otherwise("group_5plus")
    )
    return (
        F.when(children == 0, no_children)
        .when(F.coalesce(_c(has_toddler), F.lit(False)), "family_toddler")
        .when(children == 1, "family_1_child")
        .when(children == 2, "family_2_children")
        .otherwise("family_3plus_children")
    )


def recomposed_price() -> Column:
    """What a booking should cost: rooms and upsell less vouchers, loyalty discount and redeemed points."""
    return (
        F.col("rooms_total_price")
        + F.col("upsell_total_price")
        - F.col("vouchers_total_price")
        - F.col("loyalty_discount_total")
        - F.col("redeemed_loyalty_points_total")
    )


def total_spend() -> Column:
    columns = [F.col(c).cast("long") for c in SPEND_PLATFORMS.values()]
    return columns[0] + columns[1] + columns[2]


def guests() -> Column:
    return F.col("adults") + F.col("children")


# -- random ------------------------------------------------------------------------------------------------


def keyed_normal(seed: int, name: str, *keys: str) -> str:
    """SQL text of standard normal noise that is a pure function of (seed, name, keys).

    Unlike ``randn`` it does not depend on how the rows are partitioned, so a task that is run again after
    the loss of an executor gives the same numbers.  The two uniforms are the first and the last 52 bits of one
    MD5 digest, which other engines can compute too.
    """
    parts = ", ".join(f"CAST({key} AS STRING)" for key in keys)
    digest = f"md5(concat_ws('|', '{seed}', '{name}', {parts}))"

    def uniform(first: int) -> str:
        return f"((CAST(conv(substr({digest}, {first}, 13), 16, 10) AS DOUBLE) + 0.5D) / {float(1 << 52)!r}D)"

    return f"(sqrt(-2 * ln({uniform(1)})) * cos(2 * pi() * {uniform(20)}))"


# -- report formatting -------------------------------------------------------------------------------------


def as_amount(value: ColumnLike, decimals: int = 0) -> Column:
    """Number with thousands separators, for printed reports only."""
    return F.format_number(_c(value).cast("double"), decimals)


def as_percent(value: ColumnLike, decimals: int = 1) -> Column:
    return F.format_string(f"%.{decimals}f%%", _c(value).cast("double"))


def rounded(value: ColumnLike, decimals: int) -> Column:
    """Half-even rounding, for report projections only."""
    return F.bround(_c(value).cast("double"), decimals)
