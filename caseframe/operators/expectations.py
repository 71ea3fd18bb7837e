"""Assertions on tables; each runs one small job and raises where it doesn't hold."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ExpectationError(ValueError):
    """A table isn't as expected."""


def require_empty(df: DataFrame, what: str) -> None:
    found = df.limit(3).collect()
    if found:
        raise ExpectationError(f"{what}: {', '.join(str(tuple(r)) for r in found)}")


def require_rows(df: DataFrame, expected: int, what: str = "rows") -> None:
    found = df.count()
    if found != expected:
        raise ExpectationError(f"{what}: expected {expected}, found {found}")


def require_some(df: DataFrame, what: str = "table") -> None:
    if df.isEmpty():
        raise ExpectationError(f"{what} is empty")


def duplicate_keys(df: DataFrame, key: Iterable[str]) -> DataFrame:
    """Keys with more than one row, and their counts."""
    return df.groupBy(*key).agg(F.count("*").alias("copies")).where("copies > 1")


def require_unique(df: DataFrame, key: Iterable[str]) -> None:
    """Keyed table: some rows, no null in a key, no repeated key."""
    key = list(key)
    require_some(df)
    nulls = F.greatest(*[F.col(c).isNull().cast("int") for c in key], F.lit(0)) == 1
    require_empty(df.where(nulls).select(*key), "rows without a key")
    require_empty(duplicate_keys(df, key), "repeated keys")


def require_counts(df: DataFrame, column: str, expected: dict[str, int]) -> None:
    """The number of rows for each value of a column."""
    wanted = df.sparkSession.createDataFrame(list(expected.items()), f"{column} string, wanted long")
    found = df.groupBy(column).agg(F.count("*").alias("found")).join(wanted, column, "full").where("not found <=> wanted")
    require_empty(found, f"counts by {column}")


def require_split(df: DataFrame, split: str = "test") -> None:
    require_empty(df.where(~F.col("split").eqNullSafe(split)), f"rows that aren't {split}")


def require_same_values(df: DataFrame, column: str, values: Iterable[str]) -> None:
    found = df.agg(F.array_sort(F.collect_set(column))).first()[0]
    if sorted(values) != found:
        raise ExpectationError(f"{column}: expected {sorted(values)}, found {found}")
