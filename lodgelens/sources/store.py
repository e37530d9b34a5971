"""Clean tables and reports on disk: Parquet store, CSV export, JSON report log."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from lodgelens.schema import TABLE_NAMES
from lodgelens.tables import HotelTables


def write_store(tables: HotelTables, path: str) -> None:
    """Parquet, one folder per table, partitioned by ``hotel_id``.

    The rebalance hint gathers each property's rows into few files, and lets adaptive execution split the
    partition of a property that holds a large share of all rows.  Only the properties in ``tables`` are replaced;
    the others in the store stay.
    """
    for name in TABLE_NAMES:
        rows = tables[name].hint("rebalance", "hotel_id")
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("hotel_id").parquet(f"{path}/{name}")


def read_store(spark: SparkSession, path: str, hotel_ids: list[int] | None = None) -> HotelTables:
    """Tables of a store; with ``hotel_ids`` only those partitions are listed and read."""

    def open_table(table: str) -> DataFrame:
        rows = spark.read.parquet(f"{path}/{table}")
        rows = rows.withColumn("hotel_id", rows.hotel_id.cast("long"))
        return rows if hotel_ids is None else rows.where(rows.hotel_id.isin(*hotel_ids))

    return HotelTables(open_table)


def export_csv(
    tables: HotelTables, path: str, compression: str = "none", exported_at: datetime | None = None
) -> str:
    """Clean tables as CSV with a header, one folder per table; returns the folder written to.

    With ``exported_at`` each export gets its own time-stamped folder, next to earlier ones.
    """
    target = path if exported_at is None else f"{path}/export_ts={exported_at:%Y%m%d_%H%M%S}"
    for name in TABLE_NAMES:
        tables[name].write.mode("overwrite").csv(
            f"{target}/{name}", header=True, compression=compression, escape='"'
        )
    return target


def export_compressed(tables: HotelTables, path: str, exported_at: datetime) -> str:
    return export_csv(tables, path, compression="gzip", exported_at=exported_at)


REPORT_KEYS = ("report_date", "model_name", "timestamp", "hotel_id")


def append_report(report: DataFrame, path: str) -> None:
    """Add report rows as JSON, in a folder per day, model, time and property.

    A run that is repeated replaces its own rows and no others, so it can be started again after a failure.
    """
    writer = report.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*REPORT_KEYS).json(path)


def read_reports(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The report log, read with the schema of a report frame (no inference pass)."""
    return spark.read.schema(like.schema).json(path)
