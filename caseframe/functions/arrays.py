"""Array columns to rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def elements(df: DataFrame, array: Column | str, name: str, *keep: Column | str) -> DataFrame:
    """A row for each element that isn't null.

    A plain explode would make the optimizer filter by the array's size first
    and compute a costly array twice; the outer form doesn't.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def once(c: Column) -> Column:
    """A costly column that filters and projections above must not repeat.

    The optimizer never moves a filter below, or copies, an expression that it
    takes for non-deterministic; the value itself doesn't depend on it.
    """
    return F.when(F.monotonically_increasing_id() >= 0, c)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; lambda bodies share nothing otherwise."""
    return F.element_at(F.transform(F.array(value), body), 1)
