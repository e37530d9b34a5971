"""Raw CSV exports of a property → typed, filled tables.

A property's folder holds ``<table>_hotel_<id>.csv`` for the eleven tables.  Columns are matched by header
name; known columns get the type of ``lodgelens.schema``, further ones pass through as text.  Typing, null
checks and fills are one projection over the scan: no extra job, no second pass.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from lodgelens.functions.columns import utm_parts
from lodgelens.schema import REQUIRED_KINDS, SPARK_TYPE, TABLE_NAMES, TABLES, UTM_SPLIT
from lodgelens.tables import HotelTables

# Texts that stand for a missing value in a raw file.
MISSING_TEXTS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

# Files that are not UTF-8, by property and table.
KNOWN_ENCODINGS: dict[tuple[int, str], str] = {
    (2, "datepicker_daily_visitors"): "ISO-8859-2",
    (2, "website_daily_users"): "ISO-8859-2",
    (3, "datepicker_daily_visitors"): "ISO-8859-2",
    (3, "search_log_session"): "ISO-8859-2",
    (3, "website_daily_users"): "ISO-8859-2",
}

SPARK_CSV_ENCODINGS = frozenset({"UTF-8", "US-ASCII", "ISO-8859-1", "UTF-16", "UTF-16BE", "UTF-16LE", "UTF-32"})


def separator(table: str) -> str:
    return "," if table == "daily_ppc_budget" else ";"


SURPLUS = "field beyond the header"


def _upper_half(encoding: str) -> str:
    return bytes(range(0xA0, 0x100)).decode(encoding)


def csv_options(sep: str, encoding: str, multiline: bool = False) -> dict[str, object]:
    """Spark refuses single-byte encodings other than ISO-8859-1; such a file is read as that, which keeps every byte."""
    return {
        "header": True,
        "sep": sep,
        "encoding": encoding if encoding.upper() in SPARK_CSV_ENCODINGS else "ISO-8859-1",
        "quote": '"',
        "escape": '"',
        "multiLine": multiline,
    }


def to_true_characters(columns: Iterable[str], encoding: str) -> list[Column]:
    """Text columns read with :func:`csv_options`, mapped to the characters of their encoding."""
    if encoding.upper() in SPARK_CSV_ENCODINGS:
        return [F.col(f"`{c}`") for c in columns]
    wrong, right = _upper_half("ISO-8859-1"), _upper_half(encoding)
    return [F.translate(F.col(f"`{c}`"), wrong, right).alias(c) for c in columns]


def scan_csv(
    spark: SparkSession, path: str | list[str], sep: str = ";", encoding: str = "UTF-8", multiline: bool = False
) -> DataFrame:
    """CSV with a header, all columns as text.

    Characters of encodings that Spark refuses are mapped inside the scan's projection.  ``multiline`` allows line breaks inside quotes, at the price of one task per file.  A line with more fields than
    the header is an error, as the surplus would be lost; a shorter line ends in nulls.
    """
    options = csv_options(sep, encoding, multiline)
    columns = spark.read.csv(path, inferSchema=False, **options).columns
    fields = [T.StructField(name, T.StringType()) for name in (*columns, SURPLUS)]
    lost = F.raise_error(F.concat(F.lit("a line has more fields than the header: "), F.input_file_name()))
    whole = F.when(F.col(SURPLUS).isNotNull(), lost.cast("boolean")).otherwise(F.lit(True))
    raw = spark.read.csv(path, schema=T.StructType(fields), **options).where(whole).drop(SURPLUS)
    return raw.select(*to_true_characters(raw.columns, encoding))


def _typed(table: str, name: str, kind: str) -> Column:
    text = F.col(f"`{name}`")
    text = F.when(F.trim(text).isin(*MISSING_TEXTS), None).otherwise(text)
    if kind in REQUIRED_KINDS:
        # "3.0" is a valid integer text; the decimal step keeps all digits of a long and drops the fraction.
        value = F.trim(text).cast("decimal(25,6)").cast(SPARK_TYPE[kind])
        missing = F.raise_error(F.lit(f"{table}.{name}: missing value in an integer column"))
        return F.coalesce(value, missing.cast(SPARK_TYPE[kind]))
    if kind == "money":
        return F.coalesce(F.trim(text).cast(SPARK_TYPE[kind]), F.lit(0).cast(SPARK_TYPE[kind]))
    if kind == "rate":
        return F.coalesce(F.trim(text).cast("double"), F.lit(0.0))
    if kind == "label":
        return F.coalesce(text, F.lit("0"))
    if kind in ("date", "instant"):
        return F.trim(text).cast("timestamp_ntz").cast(SPARK_TYPE[kind])
    return text


def clean(raw: DataFrame, table: str, hotel_id: int) -> DataFrame:
    """Type and fill one raw table (all-text columns) and add the key of the property."""
    kinds = TABLES[table]
    absent = [c for c in kinds if c not in raw.columns]
    if absent:
        raise ValueError(f"{table} of hotel {hotel_id}: no column {', '.join(absent)}")
    columns = [F.lit(hotel_id).cast("long").alias("hotel_id")]
    columns += [_typed(table, name, kind).alias(name) for name, kind in kinds.items()]
    if table in UTM_SPLIT:
        # Split the text as read, before its nulls become "0": a missing pair gives unknown / unknown.
        pair = F.when(F.col("utm_source_and_medium").isin(*MISSING_TEXTS), None)
        source, medium = utm_parts(pair.otherwise(F.col("utm_source_and_medium")), trim=UTM_SPLIT[table])
        columns += [source.alias("utm_source"), medium.alias("utm_medium")]
    columns += [F.col(f"`{c}`") for c in raw.columns if c not in kinds]
    return raw.select(*columns)


def load_hotel(
    spark: SparkSession,
    folder: str,
    hotel_id: int,
    encodings: Mapping[tuple[int, str], str] = KNOWN_ENCODINGS,
    multiline: bool = False,
) -> HotelTables:
    """The eleven clean tables of one property."""

    def open_table(table: str) -> DataFrame:
        path = f"{folder}/{table}_hotel_{hotel_id}.csv"
        encoding = encodings.get((hotel_id, table), "UTF-8")
        try:
            raw = scan_csv(spark, path, separator(table), encoding, multiline)
        except AnalysisException as error:
            raise RuntimeError(f"cannot read table {table} of hotel {hotel_id}: {error}") from error
        if table == "daily_ppc_budget" and "date" not in raw.columns:
            raw = raw.withColumnRenamed("_c0", "date")  # the name Spark gives to an empty first header
        return clean(raw, table, hotel_id)

    return HotelTables(open_table)


def validate(tables: HotelTables) -> dict[str, int]:
    """Read every typed column of every table once, so that a bad or missing integer fails now and not in a later
    query that happens to use the column.  Returns the row counts."""
    counts = {}
    for name in TABLE_NAMES:
        touched = [F.count(c).alias(c) for c in TABLES[name]]
        counts[name] = tables[name].agg(F.count(F.lit(1)).alias("_rows"), *touched).first()["_rows"]
    return counts


def load_hotels(spark: SparkSession, folders: Mapping[int, str], **options: object) -> HotelTables:
    """Clean tables of several properties, one under the other.

    For a handful of fresh exports, any bad line of which is an error.  ``many_csv.ManyHotels`` reads many exports with
    few scans and sets bad lines aside; a long history belongs in the partitioned Parquet store (``store.write_store``).
    """
    loaded = [load_hotel(spark, folder, hotel_id, **options) for hotel_id, folder in sorted(folders.items())]
    return HotelTables(lambda table: _stacked(t[table] for t in loaded))


def _stacked(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
