"""Raw CSV exports of many properties, read with as few scans as there are kinds of files.

``raw_csv`` opens one property's export and fails on a bad line.  Here the files of a table are grouped by encoding and
header; a group is one scan however many properties it holds, the property comes from the file's name, and lines that
break a rule are set aside in a table of their own, with file and reason, while the good ones are loaded.
"""

from __future__ import annotations

import csv
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodgelens.functions.columns import utm_parts
from lodgelens.schema import REQUIRED_KINDS, SPARK_TYPE, TABLE_NAMES, TABLES, UTM_SPLIT
from lodgelens.sources.raw_csv import KNOWN_ENCODINGS, MISSING_TEXTS, SURPLUS, csv_options, separator, to_true_characters
from lodgelens.tables import HotelTables

REJECTED = "hotel_id long, table_name string, file string, reason string, line string"
FILE_HOTEL = r"_hotel_(\d+)\.csv$"


# -- rules ---------------------------------------------------------------------------------------------------


def _checked(name: str, kind: str) -> tuple[Column, Column]:
    """Value of a raw text column under the loading rules, and the reason why it has none (NULL if it is good)."""
    text = F.col(f"`{name}`")
    text = F.when(F.trim(text).isin(*MISSING_TEXTS), None).otherwise(text)
    target = SPARK_TYPE[kind]
    if kind in ("label", "text"):
        return (F.coalesce(text, F.lit("0")) if kind == "label" else text), F.lit(None).cast("string")
    if kind in REQUIRED_KINDS:
        # "3.0" is a valid integer text; the decimal step keeps all digits of a long and drops the fraction.
        value = F.trim(text).try_cast("decimal(25,6)").try_cast(target)
        reason = F.when(text.isNull(), f"{name}: missing value in an integer column").when(value.isNull(), f"{name}: not an integer")
        return value, reason
    value = F.trim(text).try_cast("timestamp_ntz").try_cast(target) if kind in ("date", "instant") else F.trim(text).try_cast(target)
    reason = F.when(text.isNotNull() & value.isNull(), f"{name}: not a {kind}")
    filled = F.coalesce(value, F.lit(0).cast(target)) if kind in ("money", "rate") else value
    return filled, reason


def split_rows(raw: DataFrame, table: str, hotel: str, file: str) -> tuple[DataFrame, DataFrame]:
    """Typed and filled rows, and ``REJECTED`` rows, of a raw table: all-text columns, ``SURPLUS`` if it was scanned, and the
    columns ``hotel`` and ``file`` that say where a row is from.

    The first broken rule names the reason: more fields than the header, a missing or bad integer, a bad number or day.
    A missing text gives 0, ``"0"`` or NULL by the kind of its column, as in ``raw_csv``.
    """
    kinds = TABLES[table]
    checked = {name: _checked(name, kind) for name, kind in kinds.items()}
    texts = [c for c in raw.columns if c not in (hotel, file)]
    extra = [c for c in texts if c not in kinds and c != SURPLUS]
    reasons = [reason for _, reason in checked.values()]
    if SURPLUS in raw.columns:
        reasons.insert(0, F.when(F.col(SURPLUS).isNotNull(), "more fields than the header"))
    line = F.concat_ws(separator(table), *[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in texts])
    hotel_id = F.col(hotel).cast("long").alias("hotel_id")
    marked = raw.withColumn("_reason", F.coalesce(*reasons))
    columns = [hotel_id, *[value.alias(name) for name, (value, _) in checked.items()]]
    if table in UTM_SPLIT:
        # Split the text as read, before its nulls become "0": a missing pair gives unknown / unknown.
        pair = F.when(F.col("utm_source_and_medium").isin(*MISSING_TEXTS), None).otherwise(F.col("utm_source_and_medium"))
        source, medium = utm_parts(pair, trim=UTM_SPLIT[table])
        columns += [source.alias("utm_source"), medium.alias("utm_medium")]
    good = marked.where(F.col("_reason").isNull()).select(*columns, *[F.col(f"`{c}`") for c in extra])
    bad = marked.where(F.col("_reason").isNotNull()).select(
        hotel_id, F.lit(table).alias("table_name"), F.col(file).alias("file"), F.col("_reason").alias("reason"), line.alias("line"),
    )
    return good, bad


# -- files ---------------------------------------------------------------------------------------------------


def _names(line: str, table: str) -> tuple[str, ...]:
    """Column names of a header line; the advertising budget's first name is empty in the files."""
    fields = next(csv.reader([line.lstrip("﻿")], delimiter=separator(table)))
    return tuple("date" if not name and i == 0 and table == "daily_ppc_budget" else name for i, name in enumerate(fields))


def read_headers(spark: SparkSession, table: str, paths: Mapping[int, str]) -> dict[int, tuple[str, ...]]:
    """Column names by property, of all files of a table in one job.

    The header is the line that names all known columns.  The job reads lines as they are, without parsing fields; one
    line per file reaches the driver.
    """
    known = [c for c in TABLES[table] if not (table == "daily_ppc_budget" and c == "date")]
    lines = spark.read.text(list(paths.values())).select("value", F.regexp_extract("_metadata.file_name", FILE_HOTEL, 1).alias("hotel"))
    fields = F.split(F.translate("value", "\"\r﻿", ""), separator(table))
    named = [F.array_contains(fields, name) for name in known]
    found = lines.where(reduce(lambda a, b: a & b, named)).groupBy("hotel").agg(F.min("value").alias("line"))
    headers = {int(r["hotel"]): _names(r["line"].rstrip("\r"), table) for r in found.collect()}
    absent = sorted(set(paths) - set(headers))
    if absent:
        raise ValueError(f"{table} of hotel {absent[0]}: no header with the columns {', '.join(known)}")
    return headers


@dataclass(frozen=True)
class Group:
    """Files of one table that one scan can read."""

    table: str
    encoding: str
    header: tuple[str, ...]
    paths: tuple[str, ...]

    def raw(self, spark: SparkSession) -> DataFrame:
        options = csv_options(separator(self.table), self.encoding)
        schema = T.StructType([T.StructField(name, T.StringType()) for name in (*self.header, SURPLUS)])
        rows = spark.read.csv(list(self.paths), schema=schema, **options)
        name = F.col("_metadata.file_name")
        texts = to_true_characters(rows.columns, self.encoding)
        return rows.select(*texts, name.alias("_file"), F.regexp_extract(name, FILE_HOTEL, 1).alias("_hotel"))


def groups(
    spark: SparkSession, folders: Mapping[int, str], table: str, encodings: Mapping[tuple[int, str], str] = KNOWN_ENCODINGS
) -> list[Group]:
    paths = {hotel: f"{folder}/{table}_hotel_{hotel}.csv" for hotel, folder in folders.items()}
    try:
        headers = read_headers(spark, table, paths)
    except ValueError:
        raise
    except Exception as error:
        raise RuntimeError(f"cannot read table {table}: {error}") from error
    kinds: dict[tuple[str, tuple[str, ...]], list[str]] = {}
    for hotel in sorted(paths):
        kinds.setdefault((encodings.get((hotel, table), "UTF-8"), headers[hotel]), []).append(paths[hotel])
    return [Group(table, encoding, header, tuple(files)) for (encoding, header), files in kinds.items()]


class ManyHotels:
    """Tables of many properties and the lines that were set aside; a table's files are looked at on first use."""

    def __init__(self, spark: SparkSession, folders: Mapping[int, str], encodings: Mapping[tuple[int, str], str] = KNOWN_ENCODINGS):
        self.spark, self.folders, self.encodings = spark, folders, encodings
        self._opened: dict[str, tuple[DataFrame, DataFrame]] = {}
        self.tables = HotelTables(lambda table: self.open(table)[0])

    def open(self, table: str) -> tuple[DataFrame, DataFrame]:
        if table not in self._opened:
            found = groups(self.spark, self.folders, table, self.encodings)
            parts = [split_rows(group.raw(self.spark), table, "_hotel", "_file") for group in found]
            stack = lambda frames: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
            self._opened[table] = stack([g for g, _ in parts]), stack([b for _, b in parts])
        return self._opened[table]

    def rejected(self, tables: tuple[str, ...] = TABLE_NAMES) -> DataFrame:
        """``REJECTED`` lines of the tables."""
        return reduce(DataFrame.unionByName, [self.open(table)[1] for table in tables])
