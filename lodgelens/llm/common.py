"""Column helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that separate words: space and the control characters from tab to carriage return.
SPACE = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACE}]+"


def text_of(name: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def split_number(id_name: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; -1 (in no split) for a null id."""
    return F.coalesce(F.crc32(F.col(id_name).cast("string").cast("binary")) % modulus, F.lit(-1))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def others(df: DataFrame, results: Iterable[str]) -> list[str]:
    """Columns of ``df`` that no result column replaces."""
    taken = {name.lower() for name in results}
    return [name for name in df.columns if name.lower() not in taken]


def quoted(name: str) -> Column:
    """A column by its exact name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def input_rows(df: DataFrame, results: Iterable[str]) -> Column:
    """The input's columns, save those that results replace, as one struct that no working column can clash with."""
    return F.struct(*[quoted(name).alias(name) for name in others(df, results)])


def grows(df: DataFrame) -> DataFrame:
    """A join side that grows with the data: always shuffled, so that plans are alike at every size."""
    return df.hint("merge")


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
