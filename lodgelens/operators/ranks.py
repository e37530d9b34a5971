"""Exact quantiles by running counts over ranges of values, with bounded state.

``percentile`` keeps every distinct value of a group in one task.  Here a sketch cuts each group's values into ranges of
about equal numbers of distinct values; totals per range (a fixed number per group) tell in which range each wanted
rank lies; only those ranges are numbered through, each in a task of its own that holds no more than a running sum.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodgelens.operators.cells import equi_join

RANGES = 256  # of values per group


def quantile_edges(
    items: DataFrame, by: Sequence[str], value: str, fractions: Sequence[float], ranges: int = RANGES, name: str = "edges"
) -> DataFrame:
    """``by`` and an array with the linearly interpolated quantile of ``value`` for each fraction.

    The sketch only decides where ranges end, so the result is exact whatever its error.  Nulls are left out; a group
    of nulls only has no row.
    """
    known = items.where(F.col(value).isNotNull())
    counts = known.groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    cuts = [i / ranges for i in range(1, ranges)]
    bounds = counts.groupBy(*by).agg(F.percentile_approx("_v", cuts, 10 * ranges).alias("_bounds"))
    below = F.size(F.filter(F.array_distinct("_bounds"), lambda b: b < F.col("_v")))
    placed = equi_join(counts, bounds, by).select(*by, "_v", "_n", below.alias("_range"))

    group = Window.partitionBy(*by)  # one row per range
    totals = placed.groupBy(*by, "_range").agg(F.sum("_n").alias("_total"))
    before = F.sum("_total").over(group.orderBy("_range")) - F.col("_total")
    offset = totals.select(*by, "_range", "_total", before.alias("_before"), F.sum("_total").over(group).alias("_all"))
    position = [(F.col("_all") - 1) * F.lit(float(f)) for f in fractions]
    ranks = F.array_distinct(F.array(*[g(p).cast("long") for p in position for g in (F.floor, F.ceil)]))
    asked = F.filter(ranks, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_total")))
    wanted = offset.withColumn("_ranks", asked).where(F.size("_ranks") > 0).drop("_total")

    near = equi_join(placed, wanted, [*by, "_range"])
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy(*by, "_range").orderBy("_v"))
    numbered = near.select(*by, "_v", "_n", "_ranks", "_all", upto.alias("_upto"))
    here = F.filter("_ranks", lambda r: (r >= F.col("_upto") - F.col("_n")) & (r < F.col("_upto")))
    found = numbered.select(*by, "_v", "_all", F.explode(here).alias("_rank"))
    at = found.groupBy(*by).agg(
        F.first("_all").alias("_all"),
        F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at"),  # two per fraction at most
    )

    def edge(p):
        low, high = F.floor(p).cast("long"), F.ceil(p).cast("long")
        between = (high - p) * F.element_at("_at", low) + (p - low) * F.element_at("_at", high)
        return F.when(low == high, F.element_at("_at", low)).otherwise(between)

    return at.select(*by, F.array(*[edge(p) for p in position]).alias(name))
