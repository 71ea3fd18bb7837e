"""Validation of targets, cases and samples: every violation becomes a row of an error array."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseframe.functions import jsonvalue as j
from caseframe.functions import records as r
from caseframe.functions.arrays import elements, once
from caseframe.functions.text import strip, western_digits
from caseframe.schema import INFO_STATUSES, LANGUAGES, MISSING, SAMPLE_SOURCE, SCHEMA_VERSION, SPLITS, STATUSES, TARGET_FIELDS, UNITS

ERRORS = "array<struct<code:string,detail:string>>"


def _error(code: str, when: Column, detail: Column | None = None) -> Column:
    text = F.lit(None).cast("string") if detail is None else detail.cast("string")
    return F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(code).alias("code"), text.alias("detail")))


def _collect(*errors: Column) -> Column:
    return F.array_compact(F.array(*errors)).cast(ERRORS)


def _indexed(elements: Column, make) -> Column:
    """Errors of list elements, with their positions as the detail."""
    blank = F.expr(f"cast(array() as {ERRORS})")
    return F.coalesce(F.flatten(F.transform(elements, lambda x, i: _collect(*make(x, i)))).cast(ERRORS), blank)


def target_errors(v: Column) -> Column:
    """Errors (code, detail) of a target given as VARIANT. Missing top-level fields end the checks; all others add up."""
    symptoms, chief = j.get(v, "symptoms"), j.get(v, "chief_complaint")
    elements = j.items(symptoms)

    def symptom(x: Column, i: Column):
        name, status, duration = j.get(x, "name"), j.get(x, "status"), j.get(x, "duration")
        value, unit, held = j.get(duration, "value"), j.get(duration, "unit"), ~j.is_none(duration)
        bad_value = ~F.coalesce(j.number_type(value) == "int", F.lit(False)) | (F.try_variant_get(value, "$", "decimal(38,0)") <= 0)
        an_object = j.is_object(x)
        yield _error("symptom_not_object", ~an_object, i)
        yield _error("symptom_name", an_object & ~j.is_string(name), i)
        yield _error("symptom_status", an_object & ~F.coalesce(j.string(status).isin(*STATUSES), F.lit(False)), i)
        yield _error("duration_not_null", an_object & held & j.string(status).isin("absent", "uncertain"), i)
        yield _error("duration_not_object", an_object & held & ~j.is_object(duration), i)
        yield _error("duration_value", an_object & j.is_object(duration) & bad_value, i)
        yield _error("duration_unit", an_object & j.is_object(duration) & ~F.coalesce(j.string(unit).isin(*UNITS), F.lit(False)), i)

    names = F.filter(F.transform(F.filter(elements, j.is_object), lambda x: j.string(j.get(x, "name"))), lambda x: x.isNotNull())
    same = F.filter(elements, lambda x: j.is_object(x) & (j.canonical(j.get(x, "name")) == j.canonical(chief)))
    errors = [
        _error("chief_complaint_type", ~j.is_string(chief)),
        _error("symptoms_type", ~j.is_array(symptoms)),
    ]
    after = [
        _error("duplicate_symptoms", F.size(names) != F.size(F.array_distinct(names))),
        _error("chief_complaint_count", j.is_array(symptoms) & (F.size(same) != 1)),
        _error("chief_complaint_status", (F.size(same) == 1) & ~F.coalesce(j.string(j.get(F.get(same, F.lit(0)), "status")) == "present", F.lit(False))),
    ]
    for field in ("medications", "allergies"):
        group = j.get(v, field)
        status, listed = j.string(j.get(group, "status")), j.get(group, "items")
        count = F.size(j.items(listed))
        after += [
            _error(f"{field}_type", ~j.is_object(group)),
            _error(f"{field}_status", j.is_object(group) & ~F.coalesce(status.isin(*INFO_STATUSES), F.lit(False))),
            _error(f"{field}_items_type", j.is_object(group) & ~j.is_array(listed)),
            _error(f"{field}_items_not_empty", status.isin("unknown", "none") & (count > 0)),
            _error(f"{field}_items_empty", (status == "reported") & (count == 0)),
        ]
    missing = j.get(v, "missing_information")
    given = F.transform(j.items(missing), lambda x: j.canonical(x))
    allowed = F.array(*[F.lit("s" + m) for m in MISSING])
    unknown = lambda field: F.coalesce(j.string(j.get(j.get(v, field), "status")) == "unknown", F.lit(False))
    no_duration = F.coalesce(F.exists(same, lambda x: j.is_none(j.get(x, "duration"))), F.lit(False))
    expected = F.array_compact(F.array(F.when(unknown("allergies"), F.lit("sallergies")), F.when(no_duration, F.lit("sduration")), F.when(unknown("medications"), F.lit("smedications"))))
    after += [
        _error("missing_information_type", ~j.is_array(missing)),
        _error("missing_information_values", F.size(F.array_except(given, allowed)) > 0),
        _error("missing_information_mismatch", F.array_sort(F.array_distinct(given)) != expected, F.array_join(F.transform(expected, lambda x: F.substring(x, 2, 100)), ",")),
    ]
    absent = F.array_except(F.array(*[F.lit(x) for x in sorted(TARGET_FIELDS)]), F.coalesce(j.keys(v), F.expr("cast(array() as array<string>)")))
    gone = F.array(F.struct(F.lit("missing_fields").alias("code"), F.array_join(absent, ",").alias("detail"))).cast(ERRORS)
    return F.when(F.size(absent) > 0, gone).otherwise(F.concat(_collect(*errors), _indexed(elements, symptom), _collect(*after)))


def found_errors(v: Any) -> list[tuple[str, str | None]]:
    """``target_errors`` of a record in plain Python, as rows of ``ERRORS``."""
    absent = sorted(set(TARGET_FIELDS) - (v.keys() if type(v) is dict else set()))
    if absent:
        return [("missing_fields", ",".join(absent))]
    symptoms, chief = v["symptoms"], v["chief_complaint"]
    listed = [x for x in symptoms if type(x) is dict] if type(symptoms) is list else None
    out: list[tuple[str, str | None]] = []

    def add(code: str, when: bool, detail: object = None) -> None:
        if when:
            out.append((code, None if detail is None else str(detail)))

    add("chief_complaint_type", type(chief) is not str)
    add("symptoms_type", listed is None)
    for i, x in enumerate(symptoms if listed is not None else ()):
        if type(x) is not dict:
            add("symptom_not_object", True, i)
            continue
        status, duration = x.get("status"), x.get("duration")
        add("symptom_name", type(x.get("name")) is not str, i)
        add("symptom_status", type(status) is not str or status not in STATUSES, i)
        add("duration_not_null", duration is not None and status in ("absent", "uncertain"), i)
        if type(duration) is dict:
            value, unit = duration.get("value"), duration.get("unit")
            add("duration_value", r.number_type(value) != "int" or value <= 0, i)
            add("duration_unit", type(unit) is not str or unit not in UNITS, i)
        else:
            add("duration_not_object", duration is not None, i)
    if listed is not None:
        names, wanted = [x["name"] for x in listed if type(x.get("name")) is str], r.canonical(chief)
        same = [x for x in listed if r.canonical(x.get("name")) == wanted]
        add("duplicate_symptoms", len(names) != len(set(names)))
        add("chief_complaint_count", len(same) != 1)
        add("chief_complaint_status", len(same) == 1 and same[0].get("status") != "present")
    else:
        same = []
    unknown = {}
    for field in ("medications", "allergies"):
        group = v[field]
        status, held = r.get(group, "status"), r.get(group, "items")
        unknown[field] = status == "unknown"
        add(f"{field}_type", type(group) is not dict)
        if type(group) is dict:
            add(f"{field}_status", type(status) is not str or status not in INFO_STATUSES)
            add(f"{field}_items_type", type(held) is not list)
            if type(held) is list:
                add(f"{field}_items_not_empty", status in ("unknown", "none") and len(held) > 0)
                add(f"{field}_items_empty", status == "reported" and not held)
    missing = v["missing_information"]
    expected = [name for name, lacks in (("allergies", unknown["allergies"]), ("duration", any(x.get("duration") is None for x in same)), ("medications", unknown["medications"])) if lacks]
    add("missing_information_type", type(missing) is not list)
    if type(missing) is list:
        given = {r.canonical(x) for x in missing}
        add("missing_information_values", not given <= {"s" + m for m in MISSING})
        add("missing_information_mismatch", given != {"s" + x for x in expected}, ",".join(expected))
    return out


#: What each pattern promises of its cases, by the statuses and the number of symptoms.
def _promises(pattern: Column, chief: Column, symptoms: Column, medications: Column, allergies: Column, missing: Column) -> list[Column]:
    statuses = F.transform(symptoms, lambda s: s["status"])
    has = lambda *wanted: F.size(F.array_except(F.array(*[F.lit(w) for w in wanted]), statuses)) == 0
    lists = lambda name: F.array_contains(missing, name)
    timed = F.exists(symptoms, lambda s: (s["name"] == chief) & s["duration"].isNotNull())
    present = F.size(F.filter(statuses, lambda s: s == "present"))
    rules = {
        "simple": F.size(symptoms) == 1,
        "negation": has("absent"),
        "uncertainty": has("uncertain"),
        "mixed": has("present", "absent", "uncertain"),
        "missing_duration": lists("duration"),
        "missing_medications": lists("medications") & (medications["status"] == "unknown") & timed,
        "missing_allergies": lists("allergies") & (allergies["status"] == "unknown") & timed,
        "multiple_present": present >= 2,
    }
    return [_error(f"pattern_{name}", (pattern == name) & ~F.coalesce(rule, F.lit(False))) for name, rule in rules.items()]


def with_case_errors(cases: DataFrame) -> DataFrame:
    """``cases`` (of the case type) with ``errors``: those of the target, the pattern's promises, and a medication that is also an allergen."""
    target = F.struct(*[F.col(f) for f in TARGET_FIELDS])
    found = F.udf(lambda text: found_errors(r.parse_struct(text)), ERRORS, useArrow=False).asNondeterministic()
    staged = cases.withColumn("_found", found(F.to_json(target, {"ignoreNullFields": "false"})))
    both = F.array_intersect(F.col("medications")["items"], F.col("allergies")["items"])
    more = [
        _error("case_id", ~F.coalesce(F.col("case_id").rlike(r"^\S+$"), F.lit(False))),
        _error("medication_is_allergen", F.size(both) > 0, F.array_join(both, ",")),
    ]
    more += _promises(F.col("case_pattern"), F.col("chief_complaint"), F.col("symptoms"), F.col("medications"), F.col("allergies"), F.col("missing_information"))
    return staged.withColumn("errors", once(F.concat("_found", _collect(*more)))).drop("_found")


def with_sample_errors(samples: DataFrame, cases: DataFrame, splits: DataFrame) -> DataFrame:
    """``samples`` with ``errors``: fields, duplicates, language, split, utterance, source, version, known case, equal target, script.

    ``splits`` has (case_id, split), ``cases`` (case_id and the target's
    fields); each joins once by case_id.
    """
    from pyspark.sql.window import Window

    key = ["case_id", "split", "language"]
    known = cases.select("case_id", F.struct(*[F.col(f) for f in TARGET_FIELDS]).alias("_expected"))
    joined = samples.join(known, "case_id", "left").join(splits.select("case_id", F.col("split").alias("_split")), "case_id", "left")
    joined = joined.withColumn("_copies", F.count("*").over(Window.partitionBy(*key)))
    required = ("case_id", "split", "language", "utterance", "target", "source", "schema_version")
    gone = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]))
    digits = western_digits(F.col("utterance"))
    errors = _collect(
        _error("missing_sample_fields", F.size(gone) > 0, F.array_join(gone, ",")),
        _error("duplicate_sample", F.col("_copies") > 1),
        _error("language", ~F.coalesce(F.col("language").isin(*LANGUAGES), F.lit(False))),
        _error("split", ~F.coalesce(F.col("split").isin(*SPLITS), F.lit(False))),
        _error("case_without_split", F.col("_split").isNull()),
        _error("wrong_split", F.col("_split") != F.col("split"), F.col("_split")),
        _error("empty_utterance", strip(F.coalesce("utterance", F.lit(""))) == ""),
        _error("source", F.col("source") != SAMPLE_SOURCE, F.col("source")),
        _error("schema_version", F.col("schema_version") != SCHEMA_VERSION, F.col("schema_version")),
        _error("unknown_case", F.col("_expected").isNull()),
        _error("target_differs", F.col("_expected").isNotNull() & ~F.col("target").eqNullSafe(F.col("_expected"))),
        _error("western_digits", (F.col("language") == "ar_msa") & (F.size(digits) > 0), F.array_join(digits, "")),
    )
    own = F.when(F.col("target").isNotNull() & F.col("_expected").isNotNull(), target_errors(j.from_struct(F.col("target")))).otherwise(F.expr(f"cast(array() as {ERRORS})"))
    return joined.withColumn("errors", F.concat(errors, own)).drop("_expected", "_split", "_copies")


def case_coverage(samples: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """For each case: its languages and splits, the missing and extra languages, and whether it crosses splits."""
    wanted = F.array_sort(F.array(*[F.lit(x) for x in languages]))
    grouped = samples.groupBy("case_id").agg(F.array_sort(F.collect_set("language")).alias("languages"), F.array_sort(F.collect_set("split")).alias("splits"))
    return grouped.select("*", F.array_except(wanted, "languages").alias("missing_languages"), F.array_except("languages", wanted).alias("extra_languages"), (F.size("splits") != 1).alias("crosses_splits"))


def error_counts(df: DataFrame) -> DataFrame:
    """Occurrences of each error code."""
    return elements(df, "errors.code", "code").groupBy("code").agg(F.count("*").alias("occurrences"))
