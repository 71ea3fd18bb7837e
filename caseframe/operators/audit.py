"""Corpus audits: coverage, lexical diversity, lengths, scripts, tokens."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caseframe.functions import text as tx
from caseframe.functions.arrays import elements, let
from caseframe.functions.text import ratio
from caseframe.schema import MAX_TOKENS
from caseframe.sources.scratch import keep

#: Cells in which the terms of a group are counted before any is counted by itself.
CELLS = 65_536


def target_features(target: Column) -> dict[str, Column]:
    """Flags and counts of a target."""
    symptoms = target["symptoms"]
    statuses = F.transform(symptoms, lambda s: s["status"])
    return {
        "has_absent": F.coalesce(F.array_contains(statuses, "absent"), F.lit(False)),
        "has_uncertain": F.coalesce(F.array_contains(statuses, "uncertain"), F.lit(False)),
        "statuses": statuses,
        "symptom_count": F.greatest(F.size(symptoms), F.lit(0)),
        "duration_count": F.greatest(F.size(F.filter(symptoms, lambda s: s["duration"].isNotNull())), F.lit(0)),
        "medication_status": target["medications"]["status"],
        "allergy_status": target["allergies"]["status"],
    }


def symptom_bucket(n: Column) -> Column:
    return F.when(n >= 4, F.lit("4+")).otherwise(n.cast("string"))


def duration_bucket(n: Column) -> Column:
    return F.when(n >= 2, F.lit("2+")).otherwise(n.cast("string"))


def coverage(df: DataFrame, by: str, target: str = "target") -> DataFrame:
    """For each group: flags, means and shares of its targets, in one pass."""
    rows = df.withColumns(target_features(F.col(target)))
    n = F.count("*")
    counts = {
        "total": n,
        "with_absent": F.count_if("has_absent"),
        "with_uncertain": F.count_if("has_uncertain"),
        "multiple_durations": F.count_if(F.col("duration_count") >= 2),
        "no_duration": F.count_if(F.col("duration_count") == 0),
        "medications_reported": F.count_if(F.col("medication_status") == "reported"),
        "allergies_reported": F.count_if(F.col("allergy_status") == "reported"),
        "symptoms": F.sum("symptom_count"),
    }
    out = rows.groupBy(by).agg(*[c.alias(k) for k, c in counts.items()])
    return out.withColumns({f"{k}_pct": ratio(F.col(k), F.col("total"), scale=100.0) for k in ("with_absent", "with_uncertain", "multiple_durations")})


def coverage_values(df: DataFrame, by: str, target: str = "target") -> DataFrame:
    """(group, field, value, total): nested counters of statuses, buckets and missing fields, as long rows."""
    f = target_features(F.col(target))
    pair = lambda field, value: F.struct(F.lit(field).alias("field"), value.alias("value"))
    single = F.array(
        pair("symptom_count", symptom_bucket(f["symptom_count"])),
        pair("duration_count", duration_bucket(f["duration_count"])),
        pair("medication_status", f["medication_status"]),
        pair("allergy_status", f["allergy_status"]),
    )
    many = [
        F.transform(f["statuses"], lambda s: pair("symptom_status", s)),
        F.transform(F.col(target)["missing_information"], lambda m: pair("missing_information", m)),
    ]
    rows = elements(df, F.concat(single, *many), "_c", by)
    return rows.groupBy(by, F.col("_c.field").alias("field"), F.col("_c.value").alias("value")).agg(F.count("*").alias("total"))


def lexical_stats(df: DataFrame, text: str, by: tuple[str, ...]) -> DataFrame:
    """For each group: utterances, distinct ones, tokens, vocabulary, type-token ratio, normalized entropy.

    Tokens are counted per group and token first, and distinct texts by their
    128-bit digests, so the shuffles carry the vocabulary and digests, not the text.
    """
    base = df.select(*by, F.unhex(F.md5(tx.normalize_text(F.col(text)))).alias("_t"), tx.tokenize(F.col(text)).alias("_w"))
    whole = base.groupBy(*by).agg(F.count("*").alias("utterances"), F.count_distinct("_t").alias("distinct_utterances"))
    counts = elements(base, "_w", "_w", *by).groupBy(*by, "_w").agg(F.count("*").alias("n"))
    totals = counts.groupBy(*by).agg(F.sum("n").alias("tokens"), F.count("*").alias("vocabulary"), F.sum(F.col("n") * F.ln("n")).alias("_nlogn"))
    out = whole.join(totals, list(by), "left").fillna(0, ["tokens", "vocabulary"]).fillna(0.0, ["_nlogn"])
    # Shannon entropy of the token counts over its maximum: (ln T - sum(n ln n) / T) / ln V.
    entropy = F.when(F.col("vocabulary") <= 1, F.lit(0.0)).otherwise((F.ln("tokens") - F.col("_nlogn") / F.col("tokens")) / F.ln("vocabulary"))
    return out.withColumns({"unique_ratio": ratio(F.col("distinct_utterances"), F.col("utterances")), "type_token_ratio": ratio(F.col("vocabulary"), F.col("tokens")), "normalized_entropy": entropy}).drop("_nlogn")


def top_terms(df: DataFrame, text: str, by: tuple[str, ...], k: int, n: int = 1) -> DataFrame:
    """The ``k`` most common tokens or n-grams of each group, ties by the term, with their rank.

    Terms are first counted by cell, a hash of the term; the count of a cell is
    an upper bound for its terms. The terms of the heaviest cells are counted
    exactly, and the last of the ``k`` best of them is a lower bound for all that
    can be in the result: only the terms of cells that reach it are counted too.
    So no term is left out that could rank, and the shuffles carry cells and the
    terms of heavy ones. Where terms are about equally frequent, all are counted.
    """
    tokens = tx.tokenize(F.col(text))
    ranks = lambda *order: F.row_number().over(Window.partitionBy(*by).orderBy(*order))

    def counted(cells: list[int]) -> DataFrame:
        """Exact counts of the terms of some cells; other terms aren't built."""
        flags = tx.bits(cells, CELLS)
        terms = lambda t: let(tx.ngram_cells(t, n, CELLS), lambda c: tx.ngrams_where(t, n, lambda i: tx.has_bit(flags, F.get(c, i))))
        return elements(df, let(tokens, terms), "term", *by).groupBy(*by, "term").agg(F.count("*").alias("total"))

    cells = elements(df, let(tokens, lambda t: tx.ngram_cells(t, n, CELLS)), "_cell", *by)
    sums = keep(cells.groupBy(*by, "_cell").agg(F.count("*").alias("_n")), "cells")
    heaviest = sums.withColumn("_r", ranks(F.desc("_n"), "_cell")).where(F.col("_r") <= 2 * k)
    first = {r["_cell"] for r in heaviest.select("_cell").distinct().collect()}  # at most CELLS
    counts = keep(counted(list(first)), "terms")
    last = counts.withColumn("_r", ranks(F.desc("total"))).where(F.col("_r") == k).select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("total").alias("_last"))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)], F.lit(True))
    # A group with fewer than k counted terms has no bound, so all its cells are counted.
    reached = sums.join(last, same, "left").where(F.col("_n") >= F.coalesce("_last", F.lit(0)))
    others = {r["_cell"] for r in reached.select("_cell").distinct().collect()} - first
    if others:
        counts = counts.union(counted(list(others)))
    ranked = counts.withColumn("rank", ranks(F.desc("total"), "term"))
    return ranked.where(F.col("rank") <= k)


def percentiles(df: DataFrame, value: Column, by: tuple[str, ...]) -> DataFrame:
    """Mean, exact median and 95th percentile (linear between ranks), and maximum of a number for each group."""
    rows = df.select(*by, value.alias("_v"))
    return rows.groupBy(*by).agg(
        F.count("_v").alias("total"),
        F.avg("_v").alias("mean"),
        F.percentile("_v", 0.5).alias("median"),
        F.percentile("_v", 0.95).alias("p95"),
        F.max("_v").alias("max"),
    )


def script_profile(df: DataFrame, text: str, by: str) -> DataFrame:
    """For each group: texts with Devanagari or Arabic script, and with digits of each kind."""
    c = F.col(text)
    kinds = {
        "devanagari": tx.has_devanagari(c),
        "arabic": tx.has_arabic(c),
        "western_digits": c.rlike("[0-9]"),
        "devanagari_digits": c.rlike("[०-९]"),
        "arabic_digits": c.rlike("[٠-٩]"),
    }
    return df.groupBy(by).agg(F.count("*").alias("total"), *[F.count_if(v).alias(k) for k, v in kinds.items()])


def token_audit(df: DataFrame, prompt: Column, full: Column, limit: int = MAX_TOKENS) -> DataFrame:
    """``df`` with the token columns: prompt, assistant and full tokens, and what is lost where the full text is cut at ``limit``."""
    out = df.withColumns({"prompt_tokens": prompt.cast("int"), "full_tokens": full.cast("int")})
    assistant = F.greatest(F.lit(0), F.col("full_tokens") - F.col("prompt_tokens"))
    out = out.withColumns({"assistant_tokens": assistant, "truncated": F.col("full_tokens") > limit, "tokens_lost": F.greatest(F.lit(0), F.col("full_tokens") - limit)})
    kept = F.least(F.col("assistant_tokens"), F.greatest(F.lit(0), F.lit(limit) - F.col("prompt_tokens")))
    out = out.withColumn("assistant_tokens_kept", kept).withColumn("assistant_tokens_lost", F.col("assistant_tokens") - kept)
    return out.withColumn("assistant_loss_pct", ratio(F.col("assistant_tokens_lost"), F.col("assistant_tokens"), scale=100.0))


def token_report(audited: DataFrame, by: str) -> DataFrame:
    """For each group: texts, cut ones, cut targets, lengths and losses."""
    lost = F.when(F.col("truncated"), F.col("tokens_lost"))
    return audited.groupBy(by).agg(
        F.count("*").alias("total"),
        F.count_if("truncated").alias("truncated"),
        F.count_if(F.col("assistant_tokens_lost") > 0).alias("targets_truncated"),
        F.avg("full_tokens").alias("mean_tokens"),
        F.percentile("full_tokens", 0.5).alias("median_tokens"),
        F.percentile("full_tokens", 0.95).alias("p95_tokens"),
        F.max("full_tokens").alias("max_tokens"),
        F.coalesce(F.avg(lost), F.lit(0.0)).alias("mean_lost"),
        F.coalesce(F.max("assistant_loss_pct"), F.lit(0.0)).alias("max_loss_pct"),
    )


def worst(audited: DataFrame, id_column: str, k: int = 20) -> DataFrame:
    """The rows that lose most tokens; ties by id."""
    return audited.orderBy(F.desc("tokens_lost"), id_column).limit(k)


