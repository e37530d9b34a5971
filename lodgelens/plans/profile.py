"""Table profiles, base statistics and data quality."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgelens.functions.columns import ratio
from lodgelens.schema import TABLE_NAMES
from lodgelens.session import cut_lineage, input_bytes, small_tasks
from lodgelens.tables import HotelTables


def profile_tables(t: HotelTables) -> DataFrame:
    """One row per table and column: position, type, and the table's row count.

    Types come from the schemas; the counts are eleven one-row aggregates that read no column.
    """
    parts = []
    for name in TABLE_NAMES:
        table = t[name]
        described = F.array(
            *[
                F.struct(
                    F.lit(i).alias("position"),
                    F.lit(field.name).alias("column_name"),
                    F.lit(field.dataType.simpleString()).alias("data_type"),
                )
                for i, field in enumerate(table.schema, start=1)
            ]
        )
        counted = table.agg(F.count(F.lit(1)).alias("row_count"))
        parts.append(counted.select(F.lit(name).alias("table_name"), F.inline(described), "row_count"))
    return reduce(DataFrame.unionByName, parts)


def row_counts(t: HotelTables) -> DataFrame:
    """Rows per table and property."""
    parts = [
        t[name].groupBy("hotel_id").agg(F.count(F.lit(1)).alias("row_count")).withColumn("table_name", F.lit(name))
        for name in TABLE_NAMES
    ]
    return reduce(DataFrame.unionByName, parts)


def first_rows(t: HotelTables, n: int = 5) -> dict[str, DataFrame]:
    return {name: t[name].limit(n) for name in TABLE_NAMES}


def base_stats(t: HotelTables) -> DataFrame:
    """Booking records, mean fill rate, searches, mean nights and mean adults, per property."""
    bookings = t.booking_data.groupBy("hotel_id").agg(F.count(F.lit(1)).alias("bookings"))
    occupancy = t.daily_occupancy.groupBy("hotel_id").agg(F.avg("fill_rate").alias("avg_fill_rate"))
    searches = t.search_log.groupBy("hotel_id").agg(
        F.count(F.lit(1)).alias("searches"),
        ratio(F.sum("nights"), F.count("nights")).alias("avg_nights"),
        ratio(F.sum("adults"), F.count("adults")).alias("avg_adults"),
    )
    return searches.join(bookings, "hotel_id", "full").join(occupancy, "hotel_id", "full")


FEW_FINGERPRINTS = 1_000_000  # repeated ones up to this number (16 MB) are broadcast
TASK_BYTES = 16 << 20  # of a file or a shuffle, read by a task that groups fingerprints: about two million rows
SHUFFLED = 4  # bytes of fingerprints for a byte of the files, at most: they do not compress, the columns do


def fingerprint(columns: list[Column]) -> Column:
    """A 64-bit hash of a row; the hash itself passes over missing values, so where they are is hashed too."""
    return F.xxhash64(*columns, *[c.isNull() for c in columns])


def data_quality(
    t: HotelTables,
    tables: tuple[str, ...] = TABLE_NAMES,
    hashed: Callable[[list[Column]], Column] = fingerprint,
) -> DataFrame:
    """Missing values, rows and duplicate rows per table and property.

    Exact in two phases.  The first groups fingerprints, not rows, of all tables in one exchange, and stores those that
    occur more than once, and one row of sums for all others.  The second fetches the rows with repeated fingerprints
    and counts equal ones in full; a table without any is not read again.  Nearly every fingerprint is a group of its
    own, so the first phase runs in tasks of bounded bytes, as many as the files are large.
    """
    merged = reduce(DataFrame.unionByName, [_fingerprints(t[name], name, hashed) for name in tables])
    single = merged.groupBy("table_name", "hotel_id", "_hash").agg(F.count(F.lit(1)).alias("_n"), F.sum("_missing").alias("_missing"))
    folded = single.groupBy("table_name", "hotel_id", F.when(F.col("_n") > 1, F.col("_hash")).alias("_hash")).agg(
        F.sum("_n").alias("_n"), F.sum("_missing").alias("_missing")
    )
    files = input_bytes(t[name] for name in tables)
    with small_tasks(merged.sparkSession, SHUFFLED * files, TASK_BYTES):
        folded = cut_lineage(folded)
    repeated = folded.where(F.col("_hash").isNotNull())
    sizes = {r["table_name"]: r["n"] for r in repeated.groupBy("table_name").agg(F.count(F.lit(1)).alias("n")).collect()}
    totals = folded.groupBy("table_name", "hotel_id").agg(
        F.sum("_missing").alias("missing_values"), F.sum("_n").alias("row_count")
    )
    counted = totals.withColumn("duplicate_rows", F.lit(0).cast("long"))
    if sizes:
        found = [_surplus(t[name], name, hashed, repeated, n) for name, n in sorted(sizes.items())]
        joined = totals.join(reduce(DataFrame.unionByName, found), ["table_name", "hotel_id"], "left")
        counted = joined.withColumn("duplicate_rows", F.coalesce("duplicate_rows", F.lit(0).cast("long")))
    return counted.select("hotel_id", "table_name", "missing_values", "row_count", "duplicate_rows")


def _others(table: DataFrame) -> list[Column]:
    return [F.col(c) for c in table.columns if c != "hotel_id"]


def _fingerprints(table: DataFrame, name: str, hashed: Callable[[list[Column]], Column]) -> DataFrame:
    others = _others(table)
    missing = reduce(lambda a, b: a + b, [c.isNull().cast("long") for c in others])
    return table.select(F.lit(name).alias("table_name"), "hotel_id", hashed(others).alias("_hash"), missing.alias("_missing"))


def _surplus(table: DataFrame, name: str, hashed: Callable, repeated: DataFrame, n: int) -> DataFrame:
    """Rows beyond the first of equal ones, per property, among those with a repeated fingerprint."""
    keys = repeated.where(F.col("table_name") == name).select("hotel_id", "_hash")
    keys = F.broadcast(keys) if n <= FEW_FINGERPRINTS else keys
    rows = table.withColumn("_hash", hashed(_others(table))).join(keys, ["hotel_id", "_hash"], "left_semi")
    equal = rows.groupBy(*table.columns).agg(F.count(F.lit(1)).alias("_n"))
    return equal.groupBy("hotel_id").agg(F.lit(name).alias("table_name"), F.sum(F.col("_n") - 1).alias("duplicate_rows"))
