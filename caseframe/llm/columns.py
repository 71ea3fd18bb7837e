"""Keeps an input's columns apart from those that an operator works with."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shield(df: DataFrame, needed: Iterable[str], made: Iterable[str]) -> tuple[DataFrame, Callable[[], list[Column]]]:
    """``df`` with its needed columns, and the others under names that clash with nothing.

    The function gives the original columns of a later frame, in order, without
    those that the operator makes anew. Names are compared without case, as the
    engine does.
    """
    made = {m.lower() for m in made}
    needed = {n.lower(): n for n in needed}
    held = {c: needed.get(c.lower(), f"in:{i}") for i, c in enumerate(df.columns)}
    quoted = lambda name: F.col("`" + name.replace("`", "``") + "`")
    inside = df.select(*[quoted(c).alias(name) for c, name in held.items() if c.lower() not in made or c.lower() in needed])
    return inside, lambda: [quoted(name).alias(c) for c, name in held.items() if c.lower() not in made]
