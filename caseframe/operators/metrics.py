"""Scoring of raw predictions against targets: 13 booleans for each row, in one of three dialects."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseframe.functions import jsonvalue as j
from caseframe.functions import normalize as n
from caseframe.functions import records as r
from caseframe.functions.arrays import once
from caseframe.schema import E2, INFO_STATUSES, METRICS, MISSING, STATUSES, TARGET_FIELDS, UNITS, Dialect



def _every(elements: Column, test: Callable[[Column], Column]) -> Column:
    """All elements pass; false where there is no list."""
    return F.coalesce(F.forall(elements, lambda x: F.coalesce(test(x), F.lit(False))), F.lit(False))


def _has_keys(v: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(j.keys(v) == F.array(*[F.lit(x) for x in sorted(names)]), F.lit(False))


def _one_of(v: Column, values: tuple[str, ...]) -> Column:
    return F.coalesce(j.string(v).isin(*values), F.lit(False))


def valid_duration(v: Column, d: Dialect) -> Column:
    return j.let(v, lambda x: _valid_duration(x, d))


def _valid_duration(v: Column, d: Dialect) -> Column:
    sound = _has_keys(v, ("value", "unit")) & F.coalesce(j.number_type(j.get(v, "value")).isin(*d.value_types), F.lit(False)) & _one_of(j.get(v, "unit"), UNITS)
    return j.is_none(v) | sound


def valid_group(v: Column) -> Column:
    return _has_keys(v, ("status", "items")) & _one_of(j.get(v, "status"), INFO_STATUSES) & _every(j.items(j.get(v, "items")), j.is_string)


def schema_valid(v: Column, d: Dialect = E2) -> Column:
    """The record has exactly the fields of its type, at every level, and allowed values."""

    def symptom(x: Column) -> Column:
        status, duration = j.get(x, "status"), j.get(x, "duration")
        sound = j.is_object(x) & _has_keys(x, ("name", "status", "duration")) & j.is_string(j.get(x, "name")) & _one_of(status, STATUSES) & valid_duration(duration, d)
        return sound if d.absent_may_have_duration else sound & ((j.string(status) == "present") | j.is_none(duration))

    missing = (lambda x: _one_of(x, MISSING)) if d.fixed_missing else j.is_string
    tests = [
        _has_keys(v, tuple(TARGET_FIELDS)),
        j.is_string(j.get(v, "chief_complaint")),
        _every(j.items(j.get(v, "symptoms")), symptom),
        valid_group(j.get(v, "medications")),
        valid_group(j.get(v, "allergies")),
        _every(j.items(j.get(v, "missing_information")), missing),
    ]
    return reduce(lambda a, b: a & b, tests)


def _names(form: Column) -> Column:
    return F.transform(form["entries"], lambda e: e["name"])


def _of_map(form: Column, *fields: str) -> Column:
    return F.transform(form["map"], lambda e: F.struct(*[e[f].alias(f) for f in fields]))


def comparisons(p: Column, t: Column, d: Dialect) -> dict[str, Column]:
    """The field metrics of two record forms."""
    if d.name == "e3":
        extraction = F.array_sort(_names(p)).eqNullSafe(F.array_sort(_names(t)))
    elif d.name == "e1":
        extraction = F.array_sort(F.array_distinct(_names(p))) == F.array_sort(F.array_distinct(_names(t)))
    else:
        extraction = _of_map(p, "name") == _of_map(t, "name")
    missing = (lambda f: F.array_sort(F.array_distinct(f["missing"]))) if d.name == "e1" else (lambda f: f["missing"])
    out = {
        "chief_complaint": p["chief"] == t["chief"],
        "symptom_extraction": extraction,
        "symptom_status": _of_map(p, "name", "status") == _of_map(t, "name", "status"),
        "duration": _of_map(p, "name", "duration") == _of_map(t, "name", "duration"),
        "medication": p["medications"] == t["medications"],
        "allergy": p["allergies"] == t["allergies"],
        "missing_information_raw": missing(p) == missing(t),
        "missing_information_derived": p["derived"] == t["missing"],
    }
    fields = ("chief_complaint", "symptom_extraction", "symptom_status", "duration", "medication", "allergy")
    if d.name == "e2":
        core = reduce(lambda a, b: a & b, (out[f] for f in fields))
    else:
        core = out["chief_complaint"] & F.array_sort(p["entries"]).eqNullSafe(F.array_sort(t["entries"])) & p["entries"].isNotNull() & out["medication"] & out["allergy"]
    out["core_exact"] = core
    out["raw_exact"] = core & (p["missing"] == t["missing"])
    out["pipeline_exact"] = core & out["missing_information_derived"]
    return out


_FIELDS, _SYMPTOM, _DURATION, _GROUP = (frozenset(x) for x in (TARGET_FIELDS, ("name", "status", "duration"), ("value", "unit"), ("status", "items")))


def _timed(x: Any, d: Dialect) -> bool:
    if type(x) is not dict:
        return x is None
    return x.keys() == _DURATION and r.number_type(x["value"]) in d.value_types and type(x["unit"]) is str and x["unit"] in UNITS


def _group(x: Any) -> bool:
    if type(x) is not dict or x.keys() != _GROUP or type(x["status"]) is not str or x["status"] not in INFO_STATUSES:
        return False
    return _texts(x["items"])


def _texts(x: Any) -> bool:
    return type(x) is list and all([type(y) is str for y in x])


def sound(v: Any, d: Dialect = E2) -> bool:
    """``schema_valid`` of a record in plain Python."""
    if type(v) is not dict or v.keys() != _FIELDS or type(v["chief_complaint"]) is not str or type(v["symptoms"]) is not list:
        return False
    for x in v["symptoms"]:
        if type(x) is not dict or x.keys() != _SYMPTOM or type(x["name"]) is not str or type(x["status"]) is not str or x["status"] not in STATUSES:
            return False
        duration = x["duration"]
        if duration is not None and not (_timed(duration, d) and (d.absent_may_have_duration or x["status"] == "present")):
            return False
    missing = v["missing_information"]
    return _group(v["medications"]) and _group(v["allergies"]) and _texts(missing) and (not d.fixed_missing or all([x in MISSING for x in missing]))


def matches(p: r.Form, t: r.Form, d: Dialect) -> dict[str, bool]:
    """``comparisons`` of two record forms in plain Python."""
    status = duration = mapped = p.map is not None and t.map is not None and len(p.map) == len(t.map)
    if mapped and p.map != t.map:
        mapped = all([a[0] == b[0] for a, b in zip(p.map, t.map, strict=True)])
        status = mapped and all([a[1] == b[1] for a, b in zip(p.map, t.map, strict=True)])
        duration = mapped and all([a[2] == b[2] for a, b in zip(p.map, t.map, strict=True)])
    if d.name == "e3":
        if p.entries is None or t.entries is None:
            mapped = p.entries is t.entries
        else:
            mapped = sorted([e[0] for e in p.entries]) == sorted([e[0] for e in t.entries])
    elif d.name == "e1":
        mapped = {e[0] for e in p.entries} == {e[0] for e in t.entries}
    chief = p.chief == t.chief
    medication = p.medications is not None and p.medications == t.medications
    allergy = p.allergies is not None and p.allergies == t.allergies
    derived = p.derived == t.missing
    if d.name == "e2":
        core = chief and mapped and status and duration and medication and allergy
    else:
        core = chief and medication and allergy and p.entries is not None and t.entries is not None and sorted(p.entries) == sorted(t.entries)
    return {
        "chief_complaint": chief,
        "symptom_extraction": mapped,
        "symptom_status": status,
        "duration": duration,
        "medication": medication,
        "allergy": allergy,
        "missing_information_raw": set(p.missing) == set(t.missing) if d.name == "e1" else p.missing == t.missing,
        "missing_information_derived": derived,
        "core_exact": core,
        "raw_exact": core and p.missing == t.missing,
        "pipeline_exact": core and derived,
    }


_BIT = {m: 1 << i for i, m in enumerate(METRICS)}


def _bits(target: Any, predictions: list[Any], d: Dialect) -> int:
    """The metrics of parsed predictions, 13 bits each."""
    out, form, known = 0, None, {}
    for at, p in enumerate(predictions):
        if type(p) is not dict:
            continue
        if id(p) not in known:
            form = r.record_form(target, d) if form is None else form
            found = _BIT["valid_json"] | (_BIT["schema_valid"] if sound(p, d) else 0)
            for m, right in matches(form if p is target else r.record_form(p, d), form, d).items():
                if right:
                    found |= _BIT[m]
            known[id(p)] = found
        out |= known[id(p)] << (at * len(METRICS))
    return out


def score(df: DataFrame, dialect: Dialect = E2, prediction: str = "prediction", target: str = "target") -> DataFrame:
    """``df`` with the 13 metric columns.

    ``prediction`` is raw text, a struct or VARIANT; ``target`` a struct, a
    VARIANT or JSON text. A prediction that is no JSON object fails every
    metric; nothing raises. Everything is a narrow projection.
    """
    return score_all(df, {"": prediction}, dialect, target)


def score_all(df: DataFrame, predictions: dict[str, str], dialect: Dialect = E2, target: str = "target") -> DataFrame:
    """``df`` with the 13 metric columns of each prediction column, by the prefix of their names.

    Texts and structs are scored by a row function that returns a bit for each
    metric, a hundred rows at a time; predictions that share a target are
    scored in one pass. VARIANT columns, whose numbers would lose their type as
    JSON text, are scored by expressions.
    """
    kinds = dict(df.dtypes)
    names = [*predictions.values(), target]
    if any(kinds[c] == "variant" for c in names):
        return _score_variants(df, predictions, dialect, target)
    if len(predictions) > 4:  # 13 bits each in a long
        first = dict(list(predictions.items())[:4])
        return score_all(score_all(df, first, dialect, target), {k: v for k, v in predictions.items() if k not in first}, dialect, target)
    texts = [kinds[c] == "string" for c in names]

    def bits(*given: str | None) -> int:
        known: dict[str | None, Any] = {}  # texts that are alike are parsed and normalized once
        parsed = []
        for x, text in zip(given, texts, strict=True):
            body = r.body(x) if text else x
            if body not in known:
                known[body] = r.parse_body(body, dialect.brace_fallback) if text else r.parse_struct(body)
            parsed.append(known[body])
        return _bits(r.GONE if parsed[-1] is None else parsed[-1], parsed[:-1], dialect)

    given = [F.col(c) if text else F.to_json(c, {"ignoreNullFields": "false"}) for c, text in zip(names, texts, strict=True)]
    staged = df.withColumn("_bits", F.udf(bits, "long", useArrow=False).asNondeterministic()(*given))
    found = {f"{prefix}{m}": F.col("_bits").bitwiseAND(F.lit(1 << (at * len(METRICS) + i))) != 0 for at, prefix in enumerate(predictions) for i, m in enumerate(METRICS)}
    return staged.withColumns(found).drop("_bits")


def _score_variants(df: DataFrame, predictions: dict[str, str], dialect: Dialect, target: str) -> DataFrame:
    """``score_all`` by expressions: the target is normalized once, and one expression normalizes all predictions."""
    kinds = dict(df.dtypes)

    def variant(name: str) -> Column:
        kind = kinds[name]
        if kind == "variant":
            return F.when(j.is_object(F.col(name)), F.col(name))
        if kind == "string":
            return j.parse_object(F.col(name), dialect.brace_fallback)
        return j.from_struct(F.col(name))

    parsed = {f"_p{i}": once(variant(name)) for i, name in enumerate(predictions.values())}
    staged = df.withColumns(parsed | {"_t": once(variant(target))})
    forms = F.transform(F.array(*parsed, "_t"), lambda v: n.record_form(v, dialect))
    sound = F.transform(F.array(*parsed), lambda v: schema_valid(v, dialect))
    staged = staged.withColumns({"_forms": once(forms), "_sound": once(sound)})
    columns = {}
    for i, prefix in enumerate(predictions):
        valid = F.col(f"_p{i}").isNotNull()
        found = comparisons(F.get("_forms", F.lit(i)), F.get("_forms", F.lit(len(parsed))), dialect)
        found |= {"valid_json": valid, "schema_valid": F.get("_sound", F.lit(i))}
        columns |= {f"{prefix}{m}": valid & F.coalesce(found[m], F.lit(False)) for m in METRICS}
    return staged.withColumns(columns).drop(*parsed, "_t", "_forms", "_sound")


#: Metrics by name, for callers that choose some of them.
REGISTRY: dict[str, Callable[[], Column]] = {m: (lambda m=m: F.col(m)) for m in METRICS}
