"""What is wrong with a prediction: nine error types, per record and per occurrence."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseframe.functions import jsonvalue as j
from caseframe.functions import normalize as n
from caseframe.functions import records as r
from caseframe.functions.arrays import elements, once
from caseframe.schema import E2, Dialect

FAILURE = "array<struct<type:string,symptom:string,expected:string,predicted:string,count:int>>"


def _row(kind: str, symptom: Column | None = None, expected: Column | None = None, predicted: Column | None = None, count: Column | None = None) -> Column:
    null = F.lit(None).cast("string")
    plain = lambda c: null if c is None else F.substring(c.cast("string"), 2, 1 << 30)
    return F.struct(
        F.lit(kind).alias("type"),
        plain(symptom).alias("symptom"),
        plain(expected).alias("expected"),
        plain(predicted).alias("predicted"),
        (F.lit(1) if count is None else count).cast("int").alias("count"),
    )


def _first_entries(found: Column) -> Column:
    """The first entry of each name, sorted by name."""
    names = F.transform(found, lambda e: e["name"])
    kept = F.filter(F.transform(found, lambda e, i: F.struct(e["name"].alias("name"), e["status"].alias("status"), e["duration"].alias("duration"), i.alias("i"))), lambda e: F.array_position(names, e["name"]) == e["i"] + 1)
    return F.array_sort(kept)


def found_failures(p: Any, t: Any, d: Dialect = E2) -> list[tuple]:
    """The failures of a parsed prediction in plain Python, as rows of ``FAILURE``."""
    if p is None:
        return [("invalid_json", None, None, None, 1)]
    b = r.record_form(t, d)
    a = b if p is t else r.record_form(p, d)
    plain = lambda c: None if c is None else c[1:]
    joined = lambda c: None if c is None else ", ".join([x[1:] for x in c])
    out = [] if a.chief == b.chief else [("wrong_chief_complaint", None, plain(b.chief), plain(a.chief), 1)]
    firsts: list[dict[str, r.Entry]] = []
    for form in (a, b):
        first: dict[str, r.Entry] = {}
        for e in form.entries or ():
            first.setdefault(e.name, e)
        firsts.append(first)
    both = a.entries is not None and b.entries is not None
    pe, te = firsts
    given, wanted = sorted(pe), sorted(te)
    if both:
        out += [("missing_symptom", plain(x), None, None, 1) for x in wanted if x not in pe]
        out += [("extra_symptom", plain(x), None, None, 1) for x in given if x not in te]
    if len(pe) != len(a.entries or ()):
        names = [e.name for e in a.entries]
        out += [("duplicate_symptom", plain(x), None, None, names.count(x)) for x in given if names.count(x) > 1]
    common = [x for x in wanted if x in pe] if both else []
    out += [("wrong_symptom_status", plain(x), plain(te[x].status), plain(pe[x].status), 1) for x in common if te[x].status != pe[x].status]
    out += [("wrong_duration", plain(x), plain(te[x].duration), plain(pe[x].duration), 1) for x in common if te[x].duration != pe[x].duration]
    if a.medications != b.medications:
        out.append(("medication_error", None, joined(b.medications), joined(a.medications), 1))
    if a.allergies != b.allergies:
        out.append(("allergy_error", None, joined(b.allergies), joined(a.allergies), 1))
    return out


def failures(df: DataFrame, dialect: Dialect = E2, prediction: str = "prediction", target: str = "target") -> DataFrame:
    """``df`` with ``failures``, one entry for each occurrence, and ``errors``, each type once in fixed order.

    A prediction that can't be parsed has the one failure invalid_json; a
    correct one has none. Repeated names count as duplicates, and their first
    entries are compared. Text predictions go through a row function, a hundred
    rows at a time; VARIANT columns through expressions.
    """
    kinds = dict(df.dtypes)
    if kinds[prediction] != "string" or kinds[target] == "variant":
        return _failures_of_variants(df, dialect, prediction, target)
    text = kinds[target] == "string"

    def found(given: str | None, wanted: str | None) -> list[tuple]:
        truth = r.parse_object(wanted) if text else r.parse_struct(wanted)
        alike = type(truth) is dict and r.body(given) == wanted
        return found_failures(truth if alike else r.parse_object(given, dialect.brace_fallback), r.GONE if truth is None else truth, dialect)

    truth = F.col(target) if text else F.to_json(target, {"ignoreNullFields": "false"})
    out = df.withColumn("failures", F.udf(found, FAILURE, useArrow=False).asNondeterministic()(F.col(prediction), truth))
    return out.withColumn("errors", F.array_distinct(F.transform("failures", lambda f: f["type"])))


def _failures_of_variants(df: DataFrame, dialect: Dialect, prediction: str, target: str) -> DataFrame:
    """``failures`` by expressions."""
    kinds = dict(df.dtypes)
    text = j.parse_object(F.col(prediction), dialect.brace_fallback) if kinds[prediction] == "string" else F.col(prediction)
    truth = j.parse_object(F.col(target)) if kinds[target] == "string" else F.col(target) if kinds[target] == "variant" else j.from_struct(F.col(target))
    staged = df.withColumns({"_p": once(text), "_t": once(truth)})
    staged = staged.withColumns({"_pf": once(n.record_form(F.col("_p"), dialect)), "_tf": once(n.record_form(F.col("_t"), dialect))})
    p, t = F.col("_pf"), F.col("_tf")
    staged = staged.withColumns({"_pe": once(_first_entries(p["entries"])), "_te": once(_first_entries(t["entries"])), "_pn": once(F.transform(p["entries"], lambda e: e["name"]))})
    pe, te = F.col("_pe"), F.col("_te")
    names = lambda c: F.transform(c, lambda e: e["name"])
    of = lambda c, name: F.get(F.filter(c, lambda e: e["name"] == name), F.lit(0))
    common = F.array_intersect(names(te), names(pe))
    some = lambda cond, rows: F.when(cond, rows).otherwise(F.expr(f"cast(array() as {FAILURE})"))
    joined = lambda c: F.concat(F.lit(" "), F.array_join(F.transform(c, lambda x: F.substring(x, 2, 1 << 30)), ", "))
    copies = lambda name: F.size(F.filter("_pn", lambda x: x == name))
    parts = [
        some(~p["chief"].eqNullSafe(t["chief"]), F.array(_row("wrong_chief_complaint", None, t["chief"], p["chief"]))),
        F.transform(F.array_except(names(te), names(pe)), lambda x: _row("missing_symptom", x)),
        F.transform(F.array_except(names(pe), names(te)), lambda x: _row("extra_symptom", x)),
        F.transform(F.filter(names(pe), lambda x: copies(x) > 1), lambda x: _row("duplicate_symptom", x, count=copies(x))),
        F.transform(F.filter(common, lambda x: ~of(te, x)["status"].eqNullSafe(of(pe, x)["status"])), lambda x: _row("wrong_symptom_status", x, of(te, x)["status"], of(pe, x)["status"])),
        F.transform(F.filter(common, lambda x: ~of(te, x)["duration"].eqNullSafe(of(pe, x)["duration"])), lambda x: _row("wrong_duration", x, of(te, x)["duration"], of(pe, x)["duration"])),
        some(~p["medications"].eqNullSafe(t["medications"]), F.array(_row("medication_error", None, joined(t["medications"]), joined(p["medications"])))),
        some(~p["allergies"].eqNullSafe(t["allergies"]), F.array(_row("allergy_error", None, joined(t["allergies"]), joined(p["allergies"])))),
    ]
    blank = F.expr(f"cast(array() as {FAILURE})")
    found = F.when(F.col("_p").isNull(), F.array(_row("invalid_json"))).otherwise(F.concat(*[F.coalesce(x.cast(FAILURE), blank) for x in parts]))
    out = staged.withColumn("failures", once(found.cast(FAILURE))).drop("_p", "_t", "_pf", "_tf", "_pe", "_te", "_pn")
    return out.withColumn("errors", F.array_distinct(F.transform("failures", lambda f: f["type"])))


def is_correct() -> Column:
    return F.size("failures") == 0


def per_record(failed: DataFrame) -> DataFrame:
    """Records that have each error type."""
    return elements(failed, "errors", "error_type").groupBy("error_type").agg(F.count("*").alias("records"))


def per_occurrence(failed: DataFrame) -> DataFrame:
    """Occurrences of each error type."""
    return elements(failed, "failures.type", "error_type").groupBy("error_type").agg(F.count("*").alias("occurrences"))


def combinations(failed: DataFrame) -> DataFrame:
    """Sorted error types joined by `` + ``; ``unknown`` where a failing record has none."""
    name = F.when(F.size("errors") == 0, F.lit("unknown")).otherwise(F.array_join(F.array_sort("errors"), " + "))
    return failed.select(name.alias("combination")).groupBy("combination").agg(F.count("*").alias("records"))


def most_common(counts: DataFrame, term: str, count: str, k: int) -> DataFrame:
    """The ``k`` largest counts; ties go by the term."""
    return counts.orderBy(F.desc(count), term).limit(k)


def languages_per_case(failed: DataFrame) -> DataFrame:
    """For each failing case: its failing languages in order, how many they are, and whether it is one."""
    cases = failed.groupBy("case_id").agg(F.array_sort(F.collect_set("language")).alias("languages"))
    return cases.withColumn("n_languages", F.size("languages")).withColumn("kind", F.when(F.col("n_languages") == 1, F.lit("single")).otherwise(F.lit("multi")))


def language_combinations(cases: DataFrame) -> DataFrame:
    return cases.groupBy(F.array_join("languages", " + ").alias("combination")).agg(F.count("*").alias("cases"))


def cross_language(results: DataFrame, case: str = "case_id", language: str = "language", correct: str = "correct") -> DataFrame:
    """For each case: all_correct, all_failed or mixed, its failing languages, and their signature (``only_hi``, ``de+sw``)."""
    one = results.groupBy(case, language).agg(F.bool_and(correct).alias("_ok"))
    cases = one.groupBy(case).agg(F.bool_and("_ok").alias("_all"), F.bool_or("_ok").alias("_any"), F.array_sort(F.collect_set(F.when(~F.col("_ok"), F.col(language)))).alias("failing"))
    kind = F.when(F.col("_all"), F.lit("all_correct")).when(~F.col("_any"), F.lit("all_failed")).otherwise(F.lit("mixed"))
    signature = F.when(F.size("failing") == 1, F.concat(F.lit("only_"), F.get("failing", F.lit(0)))).when(F.size("failing") > 1, F.array_join("failing", "+"))
    return cases.select(case, kind.alias("class"), "failing", signature.alias("signature"))


def capped(cases: DataFrame, by: str, order: str, caps: dict[str, int] | int) -> DataFrame:
    """The first cases of each category, in order, up to the category's cap, or one for all."""
    from pyspark.sql.window import Window

    limit = F.lit(caps) if isinstance(caps, int) else F.create_map(*[F.lit(x) for pair in caps.items() for x in pair])[F.col(by)]
    ranked = cases.withColumn("_rank", F.row_number().over(Window.partitionBy(by).orderBy(order)))
    return ranked.where(F.col("_rank") <= limit).drop("_rank")
