"""The queries over the driver tables, one or more for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseframe.functions import jsonvalue as j
from caseframe.functions import text as tx
from caseframe.functions.arrays import elements
from caseframe.operators import audit, compare, evaluate, failures, generate, metrics, model_io, qc, repair, split, validate
from caseframe.operators.expectations import duplicate_keys
from caseframe.plans import roundtrips, views
from caseframe.plans.oracle import ORACLE
from caseframe.schema import DIALECTS, INFO_LABELS, LANGUAGES, METRICS, MISSING_LABELS, STATUS_LABELS
from caseframe.sources import scratch
from caseframe.sources.jsonl import keep_first, keep_last
from caseframe.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}


def query(function: Query) -> Query:
    _queries[function.__name__] = function
    return function


def _scored(spark: SparkSession, sf_dir: str, shift: int = views.BASE, dialect: str = "e2") -> DataFrame:
    return metrics.score(views.predictions(spark, sf_dir, shift), DIALECTS[dialect])


def _failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return failures.failures(views.predictions(spark, sf_dir))


@query
def eval_metrics_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.long_counts(evaluate.metric_counts(_scored(spark, sf_dir), None)).select("metric", "correct", "total", "accuracy")


@query
def eval_metrics_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.long_counts(evaluate.metric_counts(_scored(spark, sf_dir))).select("scope", "metric", "correct", "total", "accuracy")


@query
def eval_failure_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.failure_counts(evaluate.metric_counts(_scored(spark, sf_dir)))


@query
def eval_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("case_id", "language", *METRICS)


@query
def eval_metrics_e1(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = evaluate.metric_counts(_scored(spark, sf_dir, dialect="e1"), None)
    return evaluate.long_counts(counts, "percent").select("metric", "correct", "total", "accuracy")


@query
def eval_metrics_e3(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = evaluate.metric_counts(_scored(spark, sf_dir, dialect="e3"), None)
    return evaluate.long_counts(counts, "percent").select("metric", "correct", "total", "accuracy")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = scratch.keep(views.cases(spark, sf_dir), "cases")
    base, candidate = (views.predictions(spark, sf_dir, shift, cases) for shift in (views.BASE, views.CANDIDATE))
    return compare.scored_pairs(base, candidate)


@query
def compare_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.outcomes(_pairs(spark, sf_dir))


@query
def compare_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.outcomes(_pairs(spark, sf_dir), "language").select("language", "metric", "total", *compare.CATEGORIES, "base_accuracy", "candidate_accuracy", "delta")


@query
def compare_regressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.in_category(_pairs(spark, sf_dir), "regressed").select("case_id", "language")


@query
def compare_key_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.samples(spark, sf_dir).select("case_id", "language")
    graded = views.verdicts(spark, sf_dir).join(views.samples(spark, sf_dir), "case_id").select("case_id", "language").where("language <> 'fr'")
    return compare.key_difference(rows.where("language <> 'de'"), graded)


@query
def error_types_per_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return failures.per_record(_failed(spark, sf_dir))


@query
def error_types_per_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return failures.per_occurrence(_failed(spark, sf_dir))


@query
def error_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = _failed(spark, sf_dir).where(~failures.is_correct())
    return failures.most_common(failures.combinations(failed), "combination", "records", 15)


@query
def error_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symptom-level outer join: what each failing record lacks, has too much, or has wrong."""
    rows = elements(_failed(spark, sf_dir), "failures", "f", "case_id")
    kinds = ("missing_symptom", "extra_symptom", "duplicate_symptom", "wrong_symptom_status")
    return rows.select("case_id", "f.type", "f.symptom", "f.expected", "f.predicted", "f.count").where(F.col("type").isin(*kinds))


@query
def languages_per_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = views.language_results(spark, sf_dir).where("not correct")
    cases = failures.languages_per_case(failed)
    return cases.select("case_id", F.array_join("languages", "+").alias("languages"), F.col("n_languages").cast("long").alias("n_languages"), "kind")


@query
def language_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = failures.languages_per_case(views.language_results(spark, sf_dir).where("not correct"))
    return failures.most_common(failures.language_combinations(cases), "combination", "cases", 15)


@query
def languages_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = failures.languages_per_case(views.language_results(spark, sf_dir).where("not correct"))
    return cases.groupBy("kind", F.col("n_languages").cast("long").alias("n_languages")).agg(F.count("*").alias("cases"))


@query
def cross_language_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = failures.cross_language(views.language_results(spark, sf_dir))
    return classes.groupBy("class", "signature").agg(F.count("*").alias("cases"))


@query
def cross_language_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = failures.cross_language(views.language_results(spark, sf_dir))
    return failures.capped(classes, "class", "case_id", {"all_correct": 10, "all_failed": 13, "mixed": 22}).select("class", "case_id")


@query
def parse_fenced_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.predictions(spark, sf_dir)
    strict, lenient = j.parse_object(F.col("prediction")), j.parse_object(F.col("prediction"), True)
    return rows.select("case_id", strict.isNotNull().alias("strict_ok"), lenient.isNotNull().alias("lenient_ok"), F.try_variant_get(lenient, "$.chief_complaint", "string").alias("chief"))


@query
def parse_event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = j.strict_object(F.col("props"))
    rows = table(spark, sf_dir, "events").select("event_type", F.try_variant_get(v, "$.k", "long").alias("k"))
    return rows.groupBy("event_type").agg(F.count("*").alias("total"), F.count("k").alias("parsed"), F.sum("k").alias("sum_k"))


@query
def derive_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.cases(spark, sf_dir)
    return rows.select("case_id", F.array_join("missing_information", ",").alias("missing"))


@query
def validate_case_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.cases(spark, sf_dir).withColumn("case_id", F.col("case_id").cast("string"))
    return validate.error_counts(validate.with_case_errors(rows))


@query
def sample_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("case_id"), F.col("event_type").alias("language"), (F.col("user_id") % 2).cast("string").alias("split"))
    found = validate.case_coverage(rows.where("language <> 'view' or case_id % 3 <> 0"), ("click", "view", "purchase"))
    text = lambda c: F.array_join(c, ",").alias(c)
    return found.select("case_id", text("languages"), text("missing_languages"), text("extra_languages"), "crosses_splits")


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.stratified(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id")


@query
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir).select("doc_id", "lang", "split")


@query
def stratified_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.distribution(_split(spark, sf_dir), "lang", "split")


@query
def split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaky = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.when(F.col("l_linenumber") > 5, "test").otherwise("train").alias("split"))
    return split.leakage(leaky, "id").select("id", F.array_join("splits", ",").alias("splits"))


@query
def split_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id")
    parts = _split(spark, sf_dir).select("doc_id").where("doc_id % 97 <> 0").unionByName(spark.range(3).select((-F.col("id") - 1).alias("doc_id")))
    return split.completeness(parts, documents, "doc_id")


@query
def split_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("split"))
    return split.repeated_within(rows, "l_orderkey")


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.with_verdicts(views.samples(spark, sf_dir), views.verdicts(spark, sf_dir), ("case_id",))


@query
def qc_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.accepted(_judged(spark, sf_dir)).select("case_id", "language")


@query
def qc_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.rejected(_judged(spark, sf_dir)).select("case_id", "language", "semantic_passed", "language_passed")


@query
def qc_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.unmatched(views.samples(spark, sf_dir), views.verdicts(spark, sf_dir), ("case_id",))


@query
def qc_report_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.report(_judged(spark, sf_dir).where("semantic_passed is not null"))


@query
def qc_failure_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.failure_kinds(_judged(spark, sf_dir).where("semantic_passed is not null"))


@query
def qc_report_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected rows in report order, numbered i of n over the whole report."""
    rows = qc.rejected(_judged(spark, sf_dir).where("semantic_passed is not null")).join(_split(spark, sf_dir).select(F.col("doc_id").alias("case_id"), "split"), "case_id")
    return qc.report_order(rows).select("case_id", "split", "ordinal", "total", qc.split_rank(F.col("split")).alias("rank"))


@query
def qc_error_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    error = lambda when, name: F.when(when, F.struct(F.lit(name).cast("string").alias("type"), F.lit("").alias("description")))
    listed = F.array_compact(F.array(error(~F.col("semantic_passed"), "wrong_status"), error(~F.col("language_passed"), "mixed"), error(~F.col("semantic_passed") & ~F.col("language_passed"), None)))
    rows = views.verdicts(spark, sf_dir).withColumn("semantic_errors", listed)
    return qc.error_type_counts(rows, "semantic_errors")


def _cases_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.cases(spark, sf_dir).withColumn("target", generate.build_target())


@query
def coverage_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.coverage(_cases_target(spark, sf_dir), "case_pattern")


@query
def coverage_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.coverage_values(_cases_target(spark, sf_dir), "case_pattern")


@query
def lexical_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = audit.lexical_stats(table(spark, sf_dir, "documents"), "text", ("lang",))
    return out.withColumns({c: F.round(c, 8) for c in ("unique_ratio", "type_token_ratio", "normalized_entropy")})


@query
def lexical_stats_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = audit.lexical_stats(table(spark, sf_dir, "documents"), "text", ("lang", "source"))
    return out.withColumns({c: F.round(c, 8) for c in ("unique_ratio", "type_token_ratio", "normalized_entropy")})


@query
def top_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.top_terms(table(spark, sf_dir, "documents"), "text", ("lang",), 20).withColumn("rank", F.col("rank").cast("long"))


@query
def top_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.top_terms(table(spark, sf_dir, "documents"), "text", ("lang",), 15, 2).withColumn("rank", F.col("rank").cast("long"))


@query
def top_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.top_terms(table(spark, sf_dir, "documents"), "text", ("lang",), 15, 3).withColumn("rank", F.col("rank").cast("long"))


@query
def length_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return audit.percentiles(docs, F.char_length("text"), ("lang",)).withColumn("max", F.col("max").cast("long"))


@query
def script_digit_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.script_profile(table(spark, sf_dir, "documents"), "text", "lang")


@query
def western_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.array_join(tx.western_digits(F.col("text")), "").alias("digits"))
    return rows.where("digits <> ''")


@query
def arabic_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    language = F.get(generate.strings(LANGUAGES), (F.col("o_orderkey") % 7).cast("int"))
    text = F.concat(F.lit("order "), F.col("o_orderkey").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.arabic_digits(text, language).alias("text"))


@query
def dedupe_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return keep_last(rows, ("l_orderkey", "l_linenumber"), ("l_partkey", "l_suppkey", "l_extendedprice"))


@query
def first_per_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return keep_first(rows, ("l_orderkey",), ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))


@query
def duplicate_line_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_keys(table(spark, sf_dir, "lineitem"), ("l_orderkey", "l_linenumber"))


@query
def upsert_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "documents").select("doc_id", "lang", F.lit("old").alias("state"))
    new = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id", F.lit("xx").alias("lang"), F.lit("new").alias("state"))
    return repair.replace_by_key(old, new, ("doc_id",))


@query
def invalidate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    gone = table(spark, sf_dir, "documents").where("lang = 'fr'").select("doc_id")
    kept, removed = repair.invalidate(rows, gone, ("doc_id",))
    return kept.withColumn("side", F.lit("kept")).unionByName(removed.withColumn("side", F.lit("removed")))


@query
def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.pending(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), ("doc_id",))


@query
def repair_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("case_id"))
    language = F.get(generate.strings(LANGUAGES), (F.col("o_orderkey") % 7).cast("int"))
    bad = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case_id"), language.alias("language"))
    return repair.repair_overlap(cases, bad)


@query
def repair_changed_by_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repair.repair_cases(views.cases(spark, sf_dir), ("1-URGENT", "2-HIGH"))
    return repair.changed_by_pattern(rows.withColumn("changed", F.col("case_pattern").isin("1-URGENT", "2-HIGH") & F.array_contains("missing_information", "allergies")))


@query
def deterministic_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = generate.deterministic_duration(F.col("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", d["value"].alias("value"), d["unit"].alias("unit"), tx.duration_label(d).alias("label"))


@query
def language_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.expand_languages(table(spark, sf_dir, "documents").select("doc_id"))


@query
def generated_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.generate_cases(spark, 1000)


@query
def generated_pattern_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.distribution(generate.generate_cases(spark, 1000), "case_pattern")


@query
def generated_case_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations among generated cases: there are none."""
    return validate.error_counts(validate.with_case_errors(generate.generate_cases(spark, 1000)))


@query
def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", model_io.messages(F.lit("be brief"), F.col("text")).alias("m"))
    return rows.select("conv_id", "turn", F.to_json("m").alias("messages"))


@query
def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    audited = audit.token_audit(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), F.least(words, F.lit(40)), words)
    out = audit.token_report(audited, "lang")
    return out.withColumn("max_tokens", F.col("max_tokens").cast("long"))


@query
def token_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    audited = audit.token_audit(table(spark, sf_dir, "documents").select("doc_id", "text"), F.least(words, F.lit(40)), words)
    return audit.worst(audited, "doc_id").select("doc_id", F.col("full_tokens").cast("long").alias("full_tokens"), F.col("tokens_lost").cast("long").alias("tokens_lost"))


@query
def label_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.sequence(F.lit(1), (F.col("l_quantity").cast("int") % 5) + 3)
    masked = model_io.mask_labels(tokens, F.col("l_linenumber"))
    rows = table(spark, sf_dir, "lineitem").select(F.array_join(F.transform(masked, lambda x: x.cast("string")), ",").alias("labels"))
    return rows.groupBy("labels").agg(F.count("*").alias("total"))


@query
def case_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit list joined to cases; those that are missing drop out."""
    wanted = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case_id"))
    return views.cases(spark, sf_dir).join(wanted, "case_id").select("case_id", "chief_complaint")


@query
def target_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples whose target differs from their case's, or whose case is unknown."""
    cases = _cases_target(spark, sf_dir).select("case_id", "target")
    rows = views.predictions(spark, sf_dir, source=views.cases(spark, sf_dir)).select("case_id", F.when(F.col("case_id") % 13 == 0, F.col("target").withField("chief_complaint", F.lit("other"))).otherwise(F.col("target")).alias("given"))
    joined = rows.join(cases.where("case_id % 17 <> 0"), "case_id", "left")
    state = F.when(F.col("target").isNull(), "unknown_case").when(~F.col("given").eqNullSafe(F.col("target")), "target_differs").otherwise("equal")
    return joined.groupBy(state.alias("state")).agg(F.count("*").alias("total"))


@query
def status_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = views.cases(spark, sf_dir)
    shown = lambda rows, kind, value, labels: rows.select(F.lit(kind).alias("kind"), tx.display_label(value, labels).alias("label"))
    rows = shown(elements(cases, "symptoms", "s"), "symptom", F.col("s.status"), STATUS_LABELS)
    for field in ("medications", "allergies"):
        rows = rows.unionByName(shown(cases, field, F.col(field)["status"], INFO_LABELS))
    rows = rows.unionByName(shown(elements(cases, "missing_information", "m"), "missing", F.col("m"), MISSING_LABELS))
    return split.distribution(rows, "kind", "label")


@query
def model_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", tx.safe_model_name(F.concat(F.lit(" "), "p_name", F.lit("+"), "p_brand", F.lit("/"), "p_type")).alias("name"))


@query
def positional_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordinals whose input and output rows differ."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ordinal"), F.col("o_custkey").alias("case_id"))
    answers = rows.withColumn("case_id", F.when(F.col("ordinal") % 50 == 0, F.lit(-1).cast("long")).otherwise(F.col("case_id"))).where("ordinal % 101 <> 0")
    return model_io.aligned(rows, answers, "ordinal", ("case_id",))


@query
def judge_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    return rows.select("doc_id", F.md5(model_io.judge_prompt(F.col("source"), F.col("lang"), F.col("text"))).alias("prompt_md5"))


@query
def failed_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 failing cases of each language."""
    failed = views.language_results(spark, sf_dir).where("not correct")
    return failures.capped(failed, "language", "case_id", 20).select("language", "case_id")


@query
def truncated_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    audited = audit.token_audit(table(spark, sf_dir, "documents").select("doc_id", "text"), F.least(words, F.lit(40)), words)
    return audited.where("truncated").select("doc_id", (F.col("assistant_tokens_lost") > 0).alias("target_truncated"))


@query
def sorted_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed values written back as compact JSON."""
    v = j.strict_object(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", F.to_json(v).alias("json"))


def queries() -> dict[str, Query]:
    return _queries | roundtrips.QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLE | roundtrips.ORACLE
