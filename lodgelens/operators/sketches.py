"""Mergeable sketches: distinct counts and quantiles per property and day, merged for any range of days.

A day's sketch is written once and never read row by row again; a month, a year or a season is a merge of some thirty,
some hundred sketches of a few kilobytes, whatever the number of visits behind them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOG_REGISTERS = 14  # of a distinct-count sketch: standard error 1.04 / sqrt(2^14) = 0.8 %
DISTINCT_BOUND = 0.04  # five standard errors
QUANTILE_SIZE = 800  # of a quantile sketch: rank error about 0.4 %
RANK_BOUND = 0.02  # five times that


def sketch_rows(rows: DataFrame, keys: Sequence[str], distinct: str, value: str) -> DataFrame:
    """Per ``keys``: a sketch of the distinct values of one column and one of the distribution of another.

    Nulls of either column are passed over by its sketch; a group with nulls only has an empty one.
    """
    number = F.col(value).cast("double")
    return rows.groupBy(*keys).agg(
        F.hll_sketch_agg(distinct, LOG_REGISTERS).alias("distinct_sketch"),
        F.kll_sketch_agg_double(number, QUANTILE_SIZE).alias("value_sketch"),
    )


def merged(sketches: DataFrame, keys: Sequence[str | Column]) -> DataFrame:
    """One sketch of each kind per coarser ``keys``."""
    return sketches.groupBy(*keys).agg(
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
        F.kll_merge_agg_double("value_sketch").alias("value_sketch"),
    )


def distinct_count(sketch: str = "distinct_sketch") -> Column:
    return F.hll_sketch_estimate(sketch)


def approximate_quantile(fraction: float, sketch: str = "value_sketch") -> Column:
    """NULL for an empty sketch."""
    some = F.kll_sketch_get_n_double(sketch) > 0
    return F.when(some, F.kll_sketch_get_quantile_double(F.when(some, F.col(sketch)), F.lit(fraction)))


def distinct_within(estimate: Column, exact: Column) -> Column:
    return F.abs(estimate - exact) <= DISTINCT_BOUND * exact


def rank_within(below: Column, upto: Column, n: Column, fraction: float) -> Column:
    """Whether a value with ``below`` rows under it and ``upto`` rows not above it is near the rank ``fraction``."""
    return (below / n <= fraction + RANK_BOUND) & (upto / n >= fraction - RANK_BOUND)
