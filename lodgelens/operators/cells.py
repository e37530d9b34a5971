"""Cross tables, shares, listings and top-k on aggregated cells.

A cross table is kept long, one row per non-empty cell, because rooms, products and campaigns are open sets;
``spread`` makes it wide when the column values are known.  Shares are taken from cells, never from raw rows,
so what a window partition or a join sees is the number of distinct combinations.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodgelens.functions.columns import percent

Names = Sequence[str]


def count_cells(df: DataFrame, keys: Names, name: str = "n", **measures: Column) -> DataFrame:
    """One row per observed combination of ``keys`` with its row count and further aggregates."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name), *[m.alias(k) for k, m in measures.items()])


def add_share(cells: DataFrame, value: str, within: Names, name: str = "share_pct") -> DataFrame:
    """Percent of ``value`` in the total of its ``within`` group, for groups over a closed set of cells."""
    whole = F.sum(value).over(Window.partitionBy(*within))
    return cells.withColumn(name, percent(value, whole))


def add_open_share(cells: DataFrame, value: str, within: Names, name: str = "share_pct") -> DataFrame:
    """As :func:`add_share`, for groups over an open set (campaigns, products, rooms).

    The totals are aggregated with map-side combine and joined back, so no task receives a whole group; the
    exchange of the cells is planned once and used by both sides.
    """
    totals = cells.groupBy(*within).agg(F.sum(value).alias("_whole"))
    return equi_join(cells, totals, within).withColumn(name, percent(value, "_whole")).drop("_whole")


def drop_zero_columns(cells: DataFrame, column_keys: Names, value: str) -> DataFrame:
    """Remove the columns of a cross table whose values add up to zero; a window sees one column's cells."""
    whole = F.sum(value).over(Window.partitionBy(*column_keys))
    return cells.withColumn("_whole", whole).where(F.col("_whole") != 0).drop("_whole")


def spread(
    cells: DataFrame,
    rows: Names,
    column: str,
    values: Sequence[object],
    measures: Mapping[str, Column],
    fill: float | int | None = None,
) -> DataFrame:
    """Wide cross table with one column per (value, measure) for a value list known beforehand.

    One measure gives columns named after the values, several give ``<value>_<measure>``.  ``fill`` replaces
    empty cells; without it they stay NULL.
    """
    named = [m.alias(k) for k, m in measures.items()]
    wide = cells.groupBy(*rows).pivot(column, list(values)).agg(*named)
    return wide if fill is None else wide.na.fill(fill, [c for c in wide.columns if c not in rows])


def value_counts(
    df: DataFrame, column: str, by: Names = ("hotel_id",), levels: DataFrame | None = None, name: str = "n"
) -> DataFrame:
    """Row count per value.  ``levels`` (a frame with ``by`` + ``column``) adds values without rows as 0."""
    keys = [*by, column]
    counts = count_cells(df, keys, name)
    if levels is None:
        return counts
    listed = levels.select(*keys).distinct()
    return equi_join(listed, counts, keys, "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)))


def by_count(counts: DataFrame, *columns: str, name: str = "n") -> DataFrame:
    """Listing order: most frequent first, ties by value."""
    return counts.orderBy(F.desc(name), *columns)


def distinct_sorted(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct().orderBy(*columns)


def top_k(
    df: DataFrame, by: Names, order: Sequence[Column], k: int, rank: str = "rank", dense: bool = False
) -> DataFrame:
    """First ``k`` rows of each group; with ``dense`` all rows of the first ``k`` distinct order values.

    ``order`` must be total, i.e. end in a key (of the row, or with ``dense`` of the thing ranked).  The rank
    filter is pushed below the exchange by Spark (window group limit), so each task sends only its own first
    ``k``, however large the group is.
    """
    window = Window.partitionBy(*by).orderBy(*order)
    position = F.dense_rank() if dense else F.row_number()
    return df.withColumn(rank, position.over(window)).where(F.col(rank) <= k)


def equi_join(left: DataFrame, right: DataFrame, keys: Names, how: str = "inner") -> DataFrame:
    """Join on equal keys with NULL equal to NULL, keeping one copy of the keys (those of the left side)."""
    prefixed = right.select(*[F.col(c).alias(f"_r_{c}" if c in keys else c) for c in right.columns])
    same = reduce(lambda a, b: a & b, [left[k].eqNullSafe(prefixed[f"_r_{k}"]) for k in keys])
    return left.join(prefixed, same, how).drop(*[f"_r_{k}" for k in keys])
