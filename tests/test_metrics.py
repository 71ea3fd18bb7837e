"""Edge rows of the three dialects."""

from __future__ import annotations

import copy
import json

import pytest

from caseframe.operators.failures import failures
from caseframe.operators.metrics import score
from caseframe.schema import E1, E2, E3, METRICS

T = {
    "chief_complaint": "cough",
    "symptoms": [
        {"name": "cough", "status": "present", "duration": {"value": 4, "unit": "days"}},
        {"name": "fever", "status": "absent", "duration": None},
        {"name": "shortness of breath", "status": "uncertain", "duration": None},
    ],
    "medications": {"status": "reported", "items": ["ibuprofen"]},
    "allergies": {"status": "unknown", "items": []},
    "missing_information": ["allergies"],
}


def change(f) -> str:
    t = copy.deepcopy(T)
    f(t)
    return json.dumps(t)


def symptom(i: int, **kw):
    return lambda t: t["symptoms"][i].update(kw)


def upper(t):
    for s in t["symptoms"]:
        s["name"] = "  " + s["name"].upper() + "  "
    t["symptoms"].reverse()


ROWS = {
    "same": json.dumps(T),
    "reordered": change(upper),
    "fenced": "```json\n" + json.dumps(T) + "\n```",
    "oneline_fence": "```" + json.dumps(T) + "```",
    "talk": "Here: " + json.dumps(T) + " ok",
    "brace": json.dumps(T) + "}",
    "list": "[" + json.dumps(T) + "]",
    "text": '"text"',
    "null": "null",
    "empty": "",
    "none": None,
    "single_quotes": json.dumps(T).replace('"', "'"),
    "dropped": change(lambda t: t["symptoms"].pop()),
    "extra": change(lambda t: t["symptoms"].append({"name": "rash", "status": "absent", "duration": None})),
    "duplicate": change(lambda t: t["symptoms"].append(dict(t["symptoms"][0]))),
    "status": change(symptom(1, status="uncertain")),
    "unit": change(symptom(0, duration={"value": 4, "unit": "hours"})),
    "float": json.dumps(T).replace('"value": 4', '"value": 4.0'),
    "exponent": json.dumps(T).replace('"value": 4', '"value": 4e0'),
    "true": change(symptom(0, duration={"value": True, "unit": "days"})),
    "quoted": change(symptom(0, duration={"value": "4", "unit": "days"})),
    "absent_duration": change(symptom(1, duration={"value": 1, "unit": "days"})),
    "missing_fever": change(lambda t: t.update(missing_information=["fever"])),
    "missing_case": change(lambda t: t.update(missing_information=["Allergies"])),
    "missing_twice": change(lambda t: t.update(missing_information=["allergies", "allergies"])),
    "extra_key": change(lambda t: t.update(note="x")),
    "status_case": change(lambda t: t["allergies"].update(status="UNKNOWN")),
    "med_null": change(lambda t: t.update(medications=None)),
    "two_keys": json.dumps(T)[:-1] + ', "chief_complaint": "fever"}',
    "object_status": change(lambda t: t["symptoms"][0].update(status={})),
}
E2_FALSE = {
    "dropped": {"symptom_extraction", "symptom_status", "duration"},
    "extra": {"symptom_extraction", "symptom_status", "duration"},
    "duplicate": {"symptom_extraction", "symptom_status", "duration"},
    "status": {"symptom_status"},
    "unit": {"duration"},
    "float": {"schema_valid"},
    "exponent": {"schema_valid"},
    "true": {"duration"},
    "quoted": {"schema_valid", "duration"},
    "absent_duration": {"schema_valid", "duration"},
    "missing_fever": {"schema_valid", "missing_information_raw"},
    "missing_case": {"schema_valid"},
    "missing_twice": {"missing_information_raw"},
    "extra_key": {"schema_valid"},
    "status_case": {"schema_valid", "missing_information_derived"},
    "med_null": {"schema_valid", "medication"},
    "two_keys": {"chief_complaint", "missing_information_derived"},
    "object_status": {"schema_valid", "symptom_status"},
}
E2_INVALID = {"oneline_fence", "talk", "brace", "list", "text", "null", "empty", "none", "single_quotes"}
CORE = {"chief_complaint", "symptom_extraction", "symptom_status", "duration", "medication", "allergy"}


@pytest.fixture(scope="module")
def rows(spark):
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return spark.createDataFrame([(k, v, json.dumps(T)) for k, v in ROWS.items()], "name string, prediction string, target string")


def results(df):
    return {r["name"]: {m for m in METRICS if not r[m]} for r in df.collect()}


def test_e2(rows):
    found = results(score(rows, E2))
    for name in ROWS:
        wrong = set(METRICS) if name in E2_INVALID else set(E2_FALSE.get(name, set()))
        if wrong & CORE:
            wrong |= {"core_exact", "raw_exact", "pipeline_exact"}
        if "missing_information_raw" in wrong:
            wrong.add("raw_exact")
        if "missing_information_derived" in wrong:
            wrong.add("pipeline_exact")
        assert found[name] == wrong, name


def test_e1(rows):
    found = results(score(rows, E1))
    assert found["talk"] == set() and found["same"] == set() and found["float"] == set()
    assert found["brace"] == set(METRICS) and found["list"] != set(METRICS)
    assert "duration" in found["quoted"] and "missing_information_raw" not in found["missing_twice"]
    assert "schema_valid" not in found["absent_duration"] and "schema_valid" not in found["missing_fever"]
    assert "symptom_extraction" not in found["duplicate"] and "raw_exact" in found["duplicate"]
    assert "allergy" in found["status_case"]


def test_e3(rows):
    found = results(score(rows, E3))
    assert found["talk"] == set() and found["float"] == set()
    assert {"symptom_extraction", "symptom_status", "duration"} <= found["duplicate"]
    assert "schema_valid" in found["true"] and "schema_valid" not in found["absent_duration"]
    assert "allergy" not in found["status_case"]


def test_duration_truth_value(spark):
    t = copy.deepcopy(T)
    t["symptoms"][0]["duration"] = {"value": 1, "unit": "days"}
    p = copy.deepcopy(t)
    p["symptoms"][0]["duration"]["value"] = True
    df = spark.createDataFrame([("x", json.dumps(p), json.dumps(t))], "name string, prediction string, target string")
    assert results(score(df, E2))["x"] == set()
    assert "schema_valid" in results(score(df, E3))["x"]


def test_failures(rows):
    found = {r["name"]: (r["errors"], [tuple(f) for f in r["failures"]]) for r in failures(rows).collect()}
    assert found["same"] == ([], []) and found["reordered"] == ([], [])
    assert found["talk"][0] == ["invalid_json"]
    assert found["dropped"][1] == [("missing_symptom", "shortness of breath", None, None, 1)]
    assert found["extra"][0] == ["extra_symptom"]
    assert found["duplicate"][1] == [("duplicate_symptom", "cough", None, None, 2)]
    assert found["status"][1] == [("wrong_symptom_status", "fever", "absent", "uncertain", 1)]
    assert found["unit"][0] == ["wrong_duration"] and found["med_null"][0] == ["medication_error"]
    assert found["two_keys"][1][0] == ("wrong_chief_complaint", None, "cough", "fever", 1)
