"""Generated patterns, case promises, labels, splits by buckets, reports, and queries that go through sinks."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from caseframe.functions import text as tx
from caseframe.operators import generate, qc, split, validate
from caseframe.plans import catalogue, roundtrips
from caseframe.schema import INFO_LABELS, MISSING_LABELS
from caseframe.sources import jsonl


@pytest.fixture(scope="module")
def cases(spark):
    return [r.asDict(recursive=True) for r in generate.generate_cases(spark, 2000).collect()]


def test_patterns(cases):
    by = {}
    for c in cases:
        by.setdefault(c["case_pattern"], []).append(c)
    rest = lambda p: [s for c in by[p] for s in c["symptoms"][1:]]
    share = lambda found: sum(found) / max(1, len(found))
    assert all(len(c["symptoms"]) == 2 for p in ("negation", "uncertainty") for c in by[p])
    assert {s["status"] for s in rest("negation")} == {"absent"} and {s["status"] for s in rest("uncertainty")} == {"uncertain"}
    for p in ("missing_duration", "missing_medications", "missing_allergies"):
        assert 0.35 < share([len(c["symptoms"]) == 2 for c in by[p]]) < 0.65
        assert {s["status"] for s in rest(p)} == {"present", "absent", "uncertain"}
        assert share([s["duration"] is not None for s in rest(p) if s["status"] == "present"]) < 0.6
        assert all((c["symptoms"][0]["duration"] is None) == (p == "missing_duration") for c in by[p])
    assert 0.35 < share([s["duration"] is not None for s in rest("multiple_present")]) < 0.65
    assert share([c["symptoms"][0]["duration"] is not None for c in by["multiple_present"]]) > 0.8


def test_missing_groups_must_not_imply_a_missing_duration(spark):
    cases = generate.generate_cases(spark, 400).where("case_pattern in ('missing_medications', 'missing_allergies')")
    assert validate.with_case_errors(cases).where("size(errors) > 0").count() == 0
    untimed = cases.withColumn("symptoms", F.transform("symptoms", lambda s: s.withField("duration", F.lit(None).cast("struct<value:int,unit:string>"))))
    untimed = untimed.withColumn("missing_information", F.concat(F.array(F.lit("duration")), "missing_information"))
    codes = validate.error_counts(validate.with_case_errors(untimed)).collect()
    assert {r["code"] for r in codes} == {"pattern_missing_medications", "pattern_missing_allergies"}


def test_labels(spark):
    df = spark.createDataFrame([("none",), ("unknown",), ("duration",), ("new_field",), (None,)], "v string")
    out = [tuple(r) for r in df.select(tx.display_label(F.col("v"), INFO_LABELS), tx.display_label(F.col("v"), MISSING_LABELS)).collect()]
    assert out == [("None reported", "none"), ("Not reported", "unknown"), ("duration", "symptom duration"), ("new field", "new field"), (None, None)]


def test_split_of_null_strata_and_repeated_ids(spark):
    df = spark.createDataFrame([(i, None if i % 3 else "a") for i in range(90)] + [(5, "a"), (5, "a")], "id long, s string")
    out = {(r["s"], r["split"]): r["total"] for r in split.distribution(split.stratified(df, "s", "id"), "s", "split").collect()}
    assert out == {("a", "train"): 26, ("a", "validation"): 3, ("a", "test"): 3, (None, "train"): 48, (None, "validation"): 6, (None, "test"): 6}


def test_report_numbers(spark):
    rows = [(i, ("test", "train", "other")[i % 3], None if i == 4 else ("fr", "de")[i % 2]) for i in range(30)]
    out = qc.report_order(spark.createDataFrame(rows, "case_id long, split string, language string").repartition(5)).collect()
    rank = {"train": 0, "validation": 1, "test": 2}
    want = sorted(rows, key=lambda r: (rank.get(r[1], 99), r[2] or "", r[0]))
    assert [(r["case_id"], r["total"]) for r in sorted(out, key=lambda r: r["ordinal"])] == [(r[0], 30) for r in want]
    assert sorted(r["ordinal"] for r in out) == list(range(1, 31))


def test_reports_are_never_cut(spark):
    with pytest.raises(ValueError):
        jsonl.table_text(spark.range(20), {"id": 4}, limit=19)
    assert len(jsonl.table_text(spark.range(20), {"id": 4}, limit=20).splitlines()) == 22


def test_every_query_of_the_catalogue_has_its_sql_or_none_on_purpose():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())
    assert set(catalogue.queries()) - set(catalogue.oracle_sql()) == {"generated_cases"}
    assert set(roundtrips.QUERIES) == set(roundtrips.ORACLE)
