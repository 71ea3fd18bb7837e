"""Row functions of scoring, failures and validation: as the expressions have it on odd records, and no tree of lambdas in the plan."""

from __future__ import annotations

import copy
import json
import random

import pytest
from pyspark.sql import functions as F

from caseframe.functions import records as r
from caseframe.operators import failures, metrics, validate
from caseframe.schema import DIALECTS, E2, METRICS
from test_metrics import ROWS, T

ODD = [None, True, False, 0, 1, 4, 4.5, -3, 1e300, "", " x ", "ß", "COUGH", "unknown", "days", [], {}, ["a", 1], ["b", "a", "a"], {"a": [1, 2]}, {"status": "none", "items": []}, {"value": True, "unit": "weeks"}, 12345678901234567890123]
NUMBERS = ["4.0", "4e0", "04", "NaN", "1E400", "-0.0", "9" * 45]


def mutated(rng: random.Random) -> dict:
    v = copy.deepcopy(T)
    for _ in range(rng.choice([1, 1, 2, 3])):
        spots, held = [], [v]
        while held:
            x = held.pop()
            spots += [(x, k) for k in (x if isinstance(x, dict) else range(len(x)))]
            held += [y for y in (x.values() if isinstance(x, dict) else x) if isinstance(y, (dict, list))]
        if not spots:
            break
        at, key = rng.choice(spots)
        if rng.random() < 0.7:
            at[key] = copy.deepcopy(rng.choice(ODD))
        elif isinstance(at, dict):
            del at[key]
        else:
            at.insert(key, copy.deepcopy(rng.choice(at)))
    return v


@pytest.fixture(scope="module")
def rows(spark):
    rng, out = random.Random(3), [(k, v, json.dumps(T)) for k, v in ROWS.items()]
    for i in range(250):
        text = json.dumps(mutated(rng), ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
        shape = rng.random()
        if shape < 0.15:
            text = "```json\n" + text + rng.choice(["\n```", "", "\n``` "])
        elif shape < 0.25:
            text = rng.choice(["ok ", "\x1c", ""]) + text[: rng.randrange(len(text))] + rng.choice(["\x85", "}", ""])
        elif shape < 0.4:
            text = text.replace("4", rng.choice(NUMBERS))
        out.append((f"m{i}", text, json.dumps(T if i % 2 else mutated(rng))))
    return spark.createDataFrame(out, "name string, prediction string, target string").repartition(4).cache()


@pytest.mark.parametrize("name", list(DIALECTS))
def test_rows_and_expressions_agree(rows, name):
    d = DIALECTS[name]
    kept = lambda df, *c: {x["name"]: [x[m] for m in c] for x in df.collect()}
    assert kept(metrics.score(rows, d), *METRICS) == kept(metrics._score_variants(rows, {"": "prediction"}, d, "target"), *METRICS)
    assert kept(failures.failures(rows, d), "failures") == kept(failures._failures_of_variants(rows, d, "prediction", "target"), "failures")


def test_validation_agrees(rows):
    found = F.udf(lambda t: validate.found_errors(r.parse_struct(t)), validate.ERRORS, useArrow=False)
    out = rows.select(found("target").alias("a"), validate.target_errors(F.parse_json("target")).alias("b")).collect()
    assert all(x["a"] == x["b"] for x in out) and any(x["a"] for x in out)


def test_plans_hold_no_lambda_trees(spark, rows):
    """An interpreted tree of lambdas took over a millisecond of CPU for each record."""
    trees = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("lambdafunction")
    assert trees(metrics.score(rows, E2)) == 0
    assert trees(failures.failures(rows, E2)) <= 1
    cases = spark.createDataFrame([("a", "simple", "g", *T.values())], "case_id string, case_pattern string, symptom_group string, " + ", ".join(f"{k} {v}" for k, v in validate_fields().items()))
    assert trees(validate.with_case_errors(cases)) < 10


def validate_fields() -> dict[str, str]:
    from caseframe.schema import TARGET_FIELDS

    return TARGET_FIELDS


def test_doubles_are_written_as_the_engine_writes_them(spark):
    values = [0.0, 4.0, 4.5, -3.25, 1e7, 9999999.0, 1e-3, 9.99e-4, 1.5e300, 123456789.125, 1e-5]
    out = spark.createDataFrame([(v,) for v in values], "v double").select("v", F.col("v").cast("string").alias("s")).collect()
    assert {x["v"]: x["s"] for x in out} == {v: r.double_text(v) for v in values}
