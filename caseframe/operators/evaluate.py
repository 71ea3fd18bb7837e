"""Counts of the metrics, overall and by language."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseframe.functions.text import ratio
from caseframe.schema import METRICS


def metric_counts(scored: DataFrame, by: str | None = "language") -> DataFrame:
    """One row for each scope (``ALL`` and each language) with the total and a count for each metric.

    Rows are counted by language first, so the grouping sets add up a row for
    each language and not every sample twice.
    """
    counts = [F.count("*").alias("total"), *[F.count_if(m).alias(m) for m in METRICS]]
    if by is None:
        return scored.agg(*counts).withColumn("scope", F.lit("ALL"))
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", *METRICS)]
    grouped = scored.groupBy(by).agg(*counts).groupingSets([[], [F.col(by)]], F.col(by)).agg(F.grouping(by).alias("_all"), *sums)
    return grouped.withColumn("scope", F.when(F.col("_all") == 1, F.lit("ALL")).otherwise(F.col(by))).drop("_all", by)


def long_counts(counts: DataFrame, accuracy: str = "fraction") -> DataFrame:
    """(scope, metric, correct, total, accuracy, failed): a row for each scope and metric."""
    rows = counts.unpivot(["scope", "total"], list(METRICS), "metric", "correct")
    scale, digits = {"fraction": (1.0, None), "percent": (100.0, None), "percent2": (100.0, 2)}[accuracy]
    return rows.select("scope", "metric", "correct", "total", ratio(F.col("correct"), F.col("total"), digits, scale).alias("accuracy"), (F.col("total") - F.col("correct")).alias("failed"))


def failure_counts(counts: DataFrame) -> DataFrame:
    """(scope, metric, failed), most failures first."""
    return long_counts(counts).select("scope", "metric", "failed").orderBy(F.desc("failed"), "scope", "metric")
