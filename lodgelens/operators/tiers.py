"""Quantile tiers: equal-count classes with right-closed bins, equal edges merged."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgelens.operators.cells import equi_join
from lodgelens.operators.ranks import quantile_edges
from lodgelens.schema import REVENUE_TIERS

EDGE_DECIMALS = 6


def tier_edges(items: DataFrame, by: Sequence[str], value: str, classes: int) -> DataFrame:
    """Distinct quantile edges of each group, ascending, as one array; no task's state grows with the items."""
    found = quantile_edges(items, by, value, [i / classes for i in range(classes + 1)])
    rounded = F.transform("edges", lambda e: F.round(e, EDGE_DECIMALS))
    return found.select(*by, F.array_distinct(rounded).alias("edges"))


def add_tier(
    items: DataFrame, by: Sequence[str], value: str, labels: Sequence[str] = REVENUE_TIERS, name: str = "tier"
) -> DataFrame:
    """Label each item with its quantile class.

    A value on an edge belongs to the class below it, the lowest edge to the first class.  Merged edges leave
    fewer classes, which take the first labels.
    """
    placed = equi_join(items, tier_edges(items, by, value, len(labels)), by)
    inner = F.slice("edges", F.lit(2), F.greatest(F.size("edges") - 2, F.lit(0)))
    below = F.size(F.filter(inner, lambda e: e < F.col(value).cast("double")))
    label = F.element_at(F.array(*[F.lit(x) for x in labels]), below + 1)
    return placed.withColumn(name, label).drop("edges")
