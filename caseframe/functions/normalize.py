"""Normal forms of structured records, so that comparisons are plain equality.

Every leaf becomes a canonical string; entries of the symptom list keep their
order, and each dialect decides which of them form its map.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseframe.functions import jsonvalue as j
from caseframe.functions.text import normalize_string
from caseframe.schema import MISSING, UNITS, Dialect

NO_STRINGS = "cast(array() as array<string>)"


def _text(v: Column, d: Dialect) -> Column:
    """A normalized string field."""
    if d.other_to_empty:
        return F.coalesce(F.concat(F.lit("s"), normalize_string(j.string(v))), F.lit("s"))
    return j.canonical(v, lower=True)


def duration_form(v: Column, d: Dialect) -> Column:
    """Canonical duration; ``n`` is none."""
    return j.let(v, lambda x: _duration_form(x, d))


def _duration_form(v: Column, d: Dialect) -> Column:
    value, unit = j.get(v, "value"), j.get(v, "unit")
    form = F.concat(F.lit("o"), j.canonical(value), F.lit("|"), j.canonical(unit, lower=d.lower_status))
    if d.bad_duration_is_none:
        good = j.is_object(v) & j.number_type(value).isNotNull() & F.coalesce(j.string(unit).isin(*UNITS), F.lit(False))
        return F.when(good, form).otherwise(F.lit("n"))
    return F.when(j.is_object(v), form).otherwise(j.canonical(v))


def sorted_forms(v: Column, d: Dialect, missing_key_is_empty: bool = True) -> Column:
    """A list of strings, normalized and sorted. Lists of mixed types keep their order; other values are told apart."""
    return j.let(v, lambda x: _sorted_forms(x, d, missing_key_is_empty))


def _sorted_forms(v: Column, d: Dialect, missing_key_is_empty: bool) -> Column:
    elements = j.items(v)
    if d.other_to_empty:
        texts = F.filter(F.transform(F.coalesce(elements, F.expr("cast(array() as array<variant>)")), lambda x: F.concat(F.lit("s"), normalize_string(j.string(x)))), lambda x: x.isNotNull())
        return F.array_sort(texts)
    alike = lambda forms: F.size(F.array_distinct(F.transform(forms, lambda x: F.substring(x, 1, 1)))) <= 1
    listed = j.let(F.transform(elements, lambda x: j.canonical(x, lower=True)), lambda forms: F.when(alike(forms), F.array_sort(forms)).otherwise(forms))
    empty = F.when(v.isNull(), F.expr(NO_STRINGS)) if missing_key_is_empty else F.when(F.lit(False), F.expr(NO_STRINGS))
    return F.coalesce(listed, empty, F.array(F.concat(F.lit("!"), j.canonical(v))))


def group_form(v: Column, d: Dialect) -> Column:
    """{status, items} as one array: the status first. Other values are told apart."""
    return j.let(v, lambda x: _group_form(x, d))


def _group_form(v: Column, d: Dialect) -> Column:
    status = j.canonical(j.get(v, "status"), lower=d.lower_status)
    held = j.get(v, "items")
    form = F.concat(F.array(status), sorted_forms(held, d))
    if d.name == "e2":  # items that are no list leave the group as it is
        form = F.when(held.isNull() | j.is_array(held), form).otherwise(F.array(F.concat(F.lit("!"), j.canonical(v))))
    if d.name == "e1":  # a missing group is an empty one, another value never matches
        blank = F.concat(F.array(F.lit("n")), F.expr(NO_STRINGS))
        return F.when(v.isNull(), blank).when(j.is_object(v), form)
    return F.when(j.is_object(v), form).otherwise(F.array(F.concat(F.lit("!"), j.canonical(v))))


def entries(v: Column, d: Dialect) -> Column:
    """Symptom entries in order: name, status and duration forms. Null where the dialect can't read the list."""
    return j.let(v, lambda x: _entries(x, d))


def _entries(v: Column, d: Dialect) -> Column:
    elements = j.items(v)
    entry = lambda x: F.struct(
        _text(j.get(x, "name"), d).alias("name"),
        j.canonical(j.get(x, "status"), lower=d.lower_status).alias("status"),
        duration_form(j.get(x, "duration"), d).alias("duration"),
    )
    none = F.expr("cast(array() as array<struct<name:string,status:string,duration:string>>)")
    objects = F.filter(elements, j.is_object)
    if d.name == "e3":
        listed = F.when(F.size(objects) == F.size(elements), F.transform(elements, entry))
        return F.when(v.isNull(), none).otherwise(listed)
    named = F.filter(F.transform(objects, entry), lambda e: e["name"].startswith("s") & (e["name"] != "s") if d.name == "e1" else e["name"].startswith("s"))
    return F.coalesce(named, none)


def symptom_map(found: Column, d: Dialect) -> Column:
    """Entries sorted by name, one for each name, as the dialect has it for repeated names."""
    names = F.transform(found, lambda e: e["name"])
    single = F.size(F.array_distinct(names)) == F.size(names)
    if d.duplicates == "last":
        last = F.filter(F.transform(found, lambda e, i: F.struct(e["name"].alias("name"), e["status"].alias("status"), e["duration"].alias("duration"), i.alias("i"))), lambda e: ~F.array_contains(F.slice(names, e["i"] + 2, F.greatest(F.size(names) - e["i"] - 1, F.lit(0))), e["name"]))
        return F.array_sort(F.transform(last, lambda e: F.struct(e["name"].alias("name"), e["status"].alias("status"), e["duration"].alias("duration"))))
    void = F.slice(found, 1, 0) if d.duplicates == "void" else F.lit(None)
    return F.when(single, F.array_sort(found)).otherwise(void)


def derived_missing(v: Column) -> Column:
    """duration, medications and allergies that a record lacks, in this order.

    Duration is lacking if no symptom has the chief complaint's name, or if the
    first that has it has none; a group if its status is exactly ``unknown``.
    """
    same = lambda chief: F.filter(j.items(j.get(v, "symptoms")), lambda x: j.is_object(x) & (j.canonical(j.get(x, "name"), lower=True) == chief))
    no_duration = j.let(j.canonical(j.get(v, "chief_complaint"), lower=True), lambda chief: j.is_none(j.get(F.get(same(chief), F.lit(0)), "duration")))
    unknown = lambda key: F.coalesce(j.string(j.get(j.get(v, key), "status")) == "unknown", F.lit(False))
    flags = (no_duration, unknown("medications"), unknown("allergies"))
    return F.array_compact(F.array(*[F.when(f, F.lit(name)) for f, name in zip(flags, MISSING, strict=True)]))


def derived_missing_struct(target: Column) -> Column:
    """The same for a record of the target type."""
    same = F.filter(target["symptoms"], lambda s: normalize_string(s["name"]).eqNullSafe(normalize_string(target["chief_complaint"])))
    flags = (
        F.get(same, F.lit(0))["duration"].isNull(),
        F.coalesce(target["medications"]["status"] == "unknown", F.lit(False)),
        F.coalesce(target["allergies"]["status"] == "unknown", F.lit(False)),
    )
    return F.array_compact(F.array(*[F.when(f, F.lit(name)) for f, name in zip(flags, MISSING, strict=True)]))


def with_derived_missing(target: Column) -> Column:
    """The record with its missing fields derived anew."""
    return target.withField("missing_information", derived_missing_struct(target))


def record_form(v: Column, d: Dialect) -> Column:
    """Everything that the metrics of a dialect compare."""

    def form(found: Column, groups: Column) -> Column:
        return F.struct(
            _text(j.get(v, "chief_complaint"), d).alias("chief"),
            found.alias("entries"),
            symptom_map(found, d).alias("map"),
            F.get(groups, F.lit(0)).alias("medications"),
            F.get(groups, F.lit(1)).alias("allergies"),
            sorted_forms(j.get(v, "missing_information"), d, missing_key_is_empty=d.name != "e2").alias("missing"),
            F.array_sort(F.transform(derived_missing(v), lambda x: F.concat(F.lit("s"), x))).alias("derived"),
        )

    groups = F.transform(F.array(j.get(v, "medications"), j.get(v, "allergies")), lambda x: _group_form(x, d))
    return j.let(entries(j.get(v, "symptoms"), d), lambda found: j.let(groups, lambda g: form(found, g)))
