"""Resuming, invalidating and replacing rows by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseframe.functions.normalize import derived_missing_struct
from caseframe.operators.expectations import require_empty, require_unique
from caseframe.operators.generate import deterministic_duration, strings
from caseframe.schema import LANGUAGES, TARGET_FIELDS

KEY = ("case_id", "split", "language")


def pending(wanted: DataFrame, done: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Rows whose key isn't done yet."""
    return wanted.join(done.select(*key), list(key), "left_anti")


def invalidate(rows: DataFrame, invalid: DataFrame, key: tuple[str, ...] = KEY) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): rows whose key is in the invalid set go."""
    keys = invalid.select(*key).distinct()
    return rows.join(keys, list(key), "left_anti"), rows.join(keys, list(key), "left_semi")


def replace_by_key(old: DataFrame, new: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """The old table with the new rows in place of those of the same key; no row is added or lost."""
    rest = [c for c in old.columns if c not in key]
    fresh = new.select(*key, F.struct(*rest).alias("_new"))
    joined = old.join(fresh, list(key), "left")
    return joined.select(*[F.col(c) if c in key else F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in old.columns])


def case_languages(cases: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """Every language of each case."""
    return cases.select("case_id").distinct().withColumn("language", F.explode(strings(languages)))


def repair_keys(cases: DataFrame, failures: DataFrame, key: tuple[str, ...] = ("case_id", "language")) -> DataFrame:
    """Keys to make anew: all languages of the repaired cases, and the failed rows, each once."""
    return case_languages(cases).select(*key).union(failures.select(*key)).distinct()


def repair_overlap(cases: DataFrame, failures: DataFrame, key: tuple[str, ...] = ("case_id", "language")) -> DataFrame:
    """Sizes of both sets, of their union, and of their overlap."""
    a = case_languages(cases).select(*key).withColumn("_a", F.lit(1))
    b = failures.select(*key).distinct().withColumn("_b", F.lit(1))
    both = a.join(b, list(key), "full")
    out = both.agg(F.count("_a").alias("from_cases"), F.count("_b").alias("from_failures"), F.count("*").alias("all_keys"))
    return out.withColumn("overlap", F.col("from_cases") + F.col("from_failures") - F.col("all_keys"))


def require_subset(keys: DataFrame, of: DataFrame, key: tuple[str, ...] = ("case_id", "language")) -> None:
    require_empty(keys.select(*key).join(of.select(*key), list(key), "left_anti"), "keys outside the table")


def repair_cases(cases: DataFrame, patterns: tuple[str, ...] = ("missing_medications", "missing_allergies")) -> DataFrame:
    """Cases of the patterns whose chief symptom lacks a duration get the one of their id; missing fields follow. ``changed`` says which."""
    chief = F.col("chief_complaint")
    lacks = F.exists("symptoms", lambda s: (s["name"] == chief) & (s["status"] == "present") & s["duration"].isNull())
    changed = F.col("case_pattern").isin(*patterns) & F.coalesce(lacks, F.lit(False))
    mended = F.transform("symptoms", lambda s: F.when((s["name"] == chief) & s["duration"].isNull(), s.withField("duration", deterministic_duration(F.col("case_id")))).otherwise(s))
    out = cases.withColumn("changed", changed).withColumn("symptoms", F.when(F.col("changed"), mended).otherwise(F.col("symptoms")))
    derived = derived_missing_struct(F.struct(*[F.col(f) for f in TARGET_FIELDS]))
    return out.withColumn("missing_information", F.when(F.col("changed"), derived).otherwise(F.col("missing_information")))


def repair_report(repaired: DataFrame) -> DataFrame:
    """One row: totals, changed cases by pattern, and their ids."""
    by = repaired.where("changed").groupBy("case_pattern").agg(F.count("*").alias("n"))
    counts = by.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("case_pattern", "n")))).alias("changed_by_pattern"))
    whole = repaired.agg(F.count("*").alias("total_cases"), F.count_if("changed").alias("changed_cases"), F.array_sort(F.collect_list(F.when(F.col("changed"), F.col("case_id")))).alias("changed_case_ids"))
    return whole.crossJoin(counts)  # one row each


def changed_by_pattern(repaired: DataFrame) -> DataFrame:
    return repaired.where("changed").groupBy("case_pattern").agg(F.count("*").alias("changed"))


def sync(rows: DataFrame, source: DataFrame, key: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """Rows with their case's present values; the source's keys must be unique and cover all rows."""
    require_unique(source, key)
    require_empty(rows.join(source.select(*key), list(key), "left_anti").select(*key), "rows without a source")
    return replace_by_key(rows, source.select(*rows.columns), key)
