"""Comparison of two models, sample by sample."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseframe.functions.text import ratio
from caseframe.operators import metrics
from caseframe.operators.expectations import require_empty, require_unique
from caseframe.schema import E2, METRICS, Dialect

KEY = ("case_id", "language")
CATEGORIES = ("both_correct", "improved", "regressed", "both_wrong")


def category(base: Column, candidate: Column) -> Column:
    return F.when(base & candidate, F.lit("both_correct")).when(candidate, F.lit("improved")).when(base, F.lit("regressed")).otherwise(F.lit("both_wrong"))


def key_difference(base: DataFrame, candidate: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Keys that only one side has, with the side: one full outer join."""
    left, right = base.select(*key).distinct().withColumn("_b", F.lit(1)), candidate.select(*key).distinct().withColumn("_c", F.lit(1))
    both = left.join(right, list(key), "full")
    side = F.when(F.col("_c").isNull(), F.lit("base")).when(F.col("_b").isNull(), F.lit("candidate"))
    return both.withColumn("side", side).where("side is not null").select(*key, "side")


def paired(base: DataFrame, candidate: DataFrame, key: tuple[str, ...] = KEY, check: bool = False) -> DataFrame:
    """Scored rows of both sides joined by key, base_ and candidate_ metrics, and a category for each metric.

    With ``check``, unequal key sets, repeated keys, and rows whose target or
    utterance differ between the sides raise.
    """
    if check:
        require_unique(base, key)
        require_unique(candidate, key)
        require_empty(key_difference(base, candidate, key), "keys of only one side")
    rest = [c for c in ("utterance", "target") if c in base.columns and c in candidate.columns]
    left = base.select(*key, *rest, *[F.col(m).alias(f"base_{m}") for m in METRICS])
    right = candidate.select(*key, *[F.col(c).alias(f"_{c}") for c in rest], *[F.col(m).alias(f"candidate_{m}") for m in METRICS])
    joined = left.join(right, list(key))
    if check and rest:
        differs = reduce(lambda a, b: a | b, (~F.col(c).eqNullSafe(F.col(f"_{c}")) for c in rest))
        require_empty(joined.where(differs).select(*key), "rows whose target or utterance differs")
    return with_categories(joined.drop(*[f"_{c}" for c in rest]))


def with_categories(pairs: DataFrame) -> DataFrame:
    """``pairs``, which have base_ and candidate_ metrics, with a category for each metric."""
    return pairs.withColumns({f"category_{m}": category(F.col(f"base_{m}"), F.col(f"candidate_{m}")) for m in METRICS})


def scored_pairs(base: DataFrame, candidate: DataFrame, dialect: Dialect = E2, key: tuple[str, ...] = KEY) -> DataFrame:
    """Raw predictions of both sides, joined by key and scored in one pass against the target, which they share."""
    joined = base.join(candidate.select(*key, F.col("prediction").alias("_candidate")), list(key))
    return with_categories(metrics.score_all(joined, {"base_": "prediction", "candidate_": "_candidate"}, dialect).drop("_candidate"))


def outcomes(pairs: DataFrame, by: str | None = None) -> DataFrame:
    """For each metric (and language): total, the four category counts, both accuracies and their difference in percentage points."""
    names = [f"category_{m}" for m in METRICS]
    scope = [by] if by else []
    rows = pairs.select(*scope, *[F.col(c).alias(c.removeprefix("category_")) for c in names]).unpivot(scope, list(METRICS), "metric", "category")
    counts = rows.groupBy(*scope, "metric").agg(F.count("*").alias("total"), *[F.count_if(F.col("category") == c).alias(c) for c in CATEGORIES])
    counts = counts.withColumns({"base_correct": F.col("both_correct") + F.col("regressed"), "candidate_correct": F.col("both_correct") + F.col("improved")})
    counts = counts.withColumns({f"{s}_accuracy": ratio(F.col(f"{s}_correct"), F.col("total"), scale=100.0) for s in ("base", "candidate")})
    return counts.withColumn("delta", F.col("candidate_accuracy") - F.col("base_accuracy"))


def in_category(pairs: DataFrame, wanted: str, metric: str = "core_exact") -> DataFrame:
    return pairs.where(F.col(f"category_{metric}") == wanted)
