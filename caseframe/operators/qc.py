"""Quality-control verdicts: acceptance, rejection, and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseframe.functions import jsonvalue as j
from caseframe.functions.arrays import elements
from caseframe.functions.text import strip
from caseframe.operators.expectations import require_empty, require_unique

KEY = ("case_id", "language")


def split_rank(split: Column) -> Column:
    return F.when(split == "train", 0).when(split == "validation", 1).when(split == "test", 2).otherwise(99)


def passed(flag: str) -> Column:
    """A missing verdict counts as failed."""
    return F.coalesce(F.col(flag), F.lit(False))


def failed_either() -> Column:
    return ~passed("semantic_passed") | ~passed("language_passed")


def with_verdicts(samples: DataFrame, verdicts: DataFrame, key: tuple[str, ...] = KEY, check: bool = False) -> DataFrame:
    """Samples with their verdicts; with ``check``, repeated verdicts and samples without one raise."""
    if check:
        require_unique(verdicts, key)
        require_empty(unmatched(samples, verdicts, key), "samples without a verdict")
    extra = [c for c in verdicts.columns if c in key or c not in samples.columns]
    return samples.join(verdicts.select(*extra), list(key), "left")


def unmatched(samples: DataFrame, verdicts: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    return samples.join(verdicts.select(*key), list(key), "left_anti").select(*key)


def accepted(joined: DataFrame) -> DataFrame:
    return joined.where(passed("semantic_passed") & passed("language_passed"))


def rejected(joined: DataFrame) -> DataFrame:
    return joined.where(failed_either())


def report(joined: DataFrame, by: str = "language") -> DataFrame:
    """Counts by language: all, and failures of either kind or any."""
    return joined.groupBy(by).agg(
        F.count("*").alias("total"),
        F.count_if(~passed("semantic_passed")).alias("semantic_failed"),
        F.count_if(~passed("language_passed")).alias("language_failed"),
        F.count_if(failed_either()).alias("either_failed"),
    )


def failure_kinds(joined: DataFrame) -> DataFrame:
    """Failures that are semantic only, of language only, or both."""
    s, k = ~passed("semantic_passed"), ~passed("language_passed")
    return joined.agg(F.count_if(s & ~k).alias("semantic_only"), F.count_if(~s & k).alias("language_only"), F.count_if(s & k).alias("both"))


def error_types(column: str) -> Column:
    """The types of an error list; ``unknown`` where an error has none."""
    return F.transform(F.coalesce(F.col(column), F.expr("cast(array() as array<struct<type:string,description:string>>)")), lambda e: F.coalesce(e["type"], F.lit("unknown")))


def error_type_counts(verdicts: DataFrame, column: str) -> DataFrame:
    """Occurrences of each error type, most common first; ties by name."""
    rows = elements(verdicts, error_types(column), "error_type")
    return rows.groupBy("error_type").agg(F.count("*").alias("occurrences")).orderBy(F.desc("occurrences"), "error_type")


def report_order(df: DataFrame) -> DataFrame:
    """Rows numbered ``ordinal`` of ``total`` by split rank, language and case.

    Rows are numbered within their split and language, and these follow each
    other by their counts: one small table of splits and languages is in order.
    """
    from pyspark.sql.window import Window

    rows = df.withColumns({"_rank": split_rank(F.col("split")), "_lang": F.coalesce("language", F.lit(""))})
    sizes = rows.groupBy("_rank", "_lang").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_rank", "_lang").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumns({"_before": F.coalesce(F.sum("_size").over(before), F.lit(0)), "total": F.sum("_size").over(Window.partitionBy())}).drop("_size")
    own = F.row_number().over(Window.partitionBy("_rank", "_lang").orderBy("case_id"))
    return rows.join(sizes, ["_rank", "_lang"]).withColumn("ordinal", (F.col("_before") + own).cast("long")).drop("_rank", "_lang", "_before")


VERDICT_KEYS = ("semantic_passed", "language_passed", "semantic_errors", "language_errors")


def parse_verdict(text: Column) -> Column:
    """A judge's raw answer as VARIANT: prefix and suffix fences go, the four typed keys must be there; else null."""
    body = strip(F.regexp_replace(F.regexp_replace(strip(text), r"^```(?:json)?", ""), r"```$", ""))
    v = j.strict_object(body)
    flag = lambda k: F.coalesce(j.kind(j.get(v, k)) == "BOOLEAN", F.lit(False))
    listed = lambda k: j.is_array(j.get(v, k))
    return F.when(flag("semantic_passed") & flag("language_passed") & listed("semantic_errors") & listed("language_errors"), v)
