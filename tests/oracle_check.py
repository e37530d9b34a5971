"""Compare a driver query with its SQL text in DuckDB: columns, row count and values."""

from __future__ import annotations

import decimal
import math

import duckdb

DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in DRIVER_TABLES:
        connection.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    return connection


def _plain(value):
    if value is None:
        return None
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float) and math.isnan(value):
        return None
    if hasattr(value, "isoformat"):
        return value.isoformat()[:19].replace("T00:00:00", "")
    return value


def _sorted_rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(plain, key=lambda r: tuple((v is None, str(v)) for v in r))


def differences(spark_df, connection, sql: str) -> list[str]:
    cursor = connection.execute(sql)
    expected_columns = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    actual = spark_df.collect()
    found = []
    if sorted(spark_df.columns) != sorted(expected_columns):
        return [f"columns {sorted(spark_df.columns)} != {sorted(expected_columns)}"]
    if len(actual) != len(expected):
        found.append(f"rows {len(actual)} != {len(expected)}")
    a = _sorted_rows([tuple(r) for r in actual], spark_df.columns)
    b = _sorted_rows(expected, expected_columns)
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    if wrong:
        found.append(f"{len(wrong)} rows differ, first: {wrong[0][0]} != {wrong[0][1]}")
    return found
