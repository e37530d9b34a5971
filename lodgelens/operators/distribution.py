"""Exact order statistics from value counts.

``percentile`` in Spark keeps a value → count map per group.  All functions here first reduce the rows to one
row per (group, value) with map-side combine and then weight each value by its count.  The state of the last
step thus grows with the number of distinct values (days of lead time, visit counts), not with the rows, and a
group that holds a third of all rows costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodgelens.functions.columns import ratio
from lodgelens.operators.cells import equi_join

WHISKER_REACH = 1.5


def value_histogram(df: DataFrame, by: Sequence[str], value: str, name: str = "n") -> DataFrame:
    return df.groupBy(*by, value).agg(F.count(F.lit(1)).alias(name))


def quantile(value: str, fraction: float, weight: str = "n") -> Column:
    """Linearly interpolated quantile of ``value``, each value occurring ``weight`` times."""
    return F.percentile(F.col(value), F.lit(fraction), F.col(weight))


def weighted_mean(value: str, weight: str = "n") -> Column:
    return ratio(F.sum(F.col(value) * F.col(weight)), F.sum(weight))


def weighted_stddev(value: str, weight: str = "n") -> Column:
    """Sample standard deviation of an integer column from its value counts; NULL for a single row.

    Both sums are exact (decimal), so no digits cancel however many rows there are.
    """
    x, n = F.col(value).cast("decimal(10,0)"), F.col(weight).cast("decimal(18,0)")
    total, squares, linear = F.sum(n), F.sum(n * (x * x)), F.sum(n * x)
    spread = (squares.cast("double") * total.cast("double") - linear.cast("double") * linear.cast("double"))
    rows = total.cast("double")
    return F.sqrt(F.try_divide(F.greatest(spread, F.lit(0.0)), rows * (rows - 1)))


def summarise(histogram: DataFrame, by: Sequence[str], value: str, weight: str = "n") -> DataFrame:
    """Count, mean, median, sample standard deviation, minimum and maximum per group."""
    return histogram.groupBy(*by).agg(
        F.sum(weight).alias("bookings"),
        weighted_mean(value, weight).alias("mean"),
        quantile(value, 0.5, weight).alias("median"),
        weighted_stddev(value, weight).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )


def quartiles(histogram: DataFrame, by: Sequence[str], value: str, weight: str = "n") -> DataFrame:
    return histogram.groupBy(*by).agg(
        quantile(value, 0.25, weight).alias("p25"),
        quantile(value, 0.50, weight).alias("p50"),
        quantile(value, 0.75, weight).alias("p75"),
    )


def box_statistics(histogram: DataFrame, by: Sequence[str], value: str, weight: str = "n") -> DataFrame:
    """The numbers of a box plot without outliers: quartiles and the outermost values within reach.

    The quartiles are set beside the group's values by a window over the value counts, so the counts are
    exchanged once and not joined to themselves.
    """
    group = Window.partitionBy(*by)
    marks = {"p25": 0.25, "p50": 0.50, "p75": 0.75}
    beside = histogram.withColumns({name: quantile(value, q, weight).over(group) for name, q in marks.items()})
    iqr = F.col("p75") - F.col("p25")
    inside = F.col(value).between(F.col("p25") - WHISKER_REACH * iqr, F.col("p75") + WHISKER_REACH * iqr)
    return beside.groupBy(*by).agg(
        *[F.first(name).alias(name) for name in marks],
        F.least(F.min(F.when(inside, F.col(value))).cast("double"), F.first("p25")).alias("whisker_low"),
        F.greatest(F.max(F.when(inside, F.col(value))).cast("double"), F.first("p75")).alias("whisker_high"),
    )


def equal_width_histogram(df: DataFrame, by: Sequence[str], value: str, bins: int = 20) -> DataFrame:
    """Counts in ``bins`` equal intervals between the group's extremes; the last one is closed on the right."""
    ends = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    number = F.coalesce(F.floor(F.try_divide(F.col(value) - F.col("lo"), width)), F.lit(0))
    placed = equi_join(df.where(F.col(value).isNotNull()).select(*by, value), ends, by)
    return (
        placed.groupBy(*by, F.least(number, F.lit(bins - 1)).cast("int").alias("bin"), "lo", "hi")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(*by, "bin", (F.col("lo") + F.col("bin") * width).alias("bin_start"), "n")
    )
