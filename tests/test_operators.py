"""Operators on small hand-made tables, and identities that must hold."""

from __future__ import annotations

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from caseframe.functions import text as tx
from caseframe.functions.arrays import elements
from caseframe.operators import audit, compare, evaluate, expectations, failures, generate, model_io, qc, repair, split, validate
from caseframe.operators.metrics import score
from caseframe.schema import LANGUAGES, METRICS, PATTERNS, SAMPLE, TARGET
from caseframe.sources import jsonl
from caseframe.streaming.resume import resume_stream


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(expr).first()[0]


@pytest.mark.parametrize(
    "text,tokens",
    [("foo_bar baz", ["baz"]), ("x-y", ["x", "y"]), (" A  b\x1c", ["a", "b"]), ("किताब", ["क", "त", "ब"]), ("", []), (None, None), ("x² 3", ["x²", "3"])],
)
def test_tokens(spark, text, tokens):
    assert one(spark, tx.tokenize(F.col("t")), t=text) == tokens


def test_text_functions(spark):
    tokens = F.split("t", " ")
    assert one(spark, tx.ngrams(tokens, 2), t="a b c") == ["a b", "b c"]
    assert one(spark, tx.ngrams(tokens, 4), t="a b c") == []
    assert one(spark, tx.normalize_string(F.col("t")), t=" \x1f Ab \n") == "ab"
    assert one(spark, tx.arabic_digits(F.col("t"), F.col("l")), t="a 409", l="ar_msa") == "a ٤٠٩"
    assert one(spark, tx.arabic_digits(F.col("t"), F.col("l")), t="a 409", l="en") == "a 409"
    assert one(spark, tx.safe_model_name(F.col("t")), t=" My Model+X/y ") == "my_modelplusx_y"
    assert one(spark, model_io.unquote(F.col("t")), t=' "a "b" c" ') == 'a "b" c'
    assert one(spark, tx.western_digits(F.col("t")), t="b31a1") == ["1", "3"]


def test_percentiles_and_entropy(spark):
    df = spark.createDataFrame([("a", v) for v in (1, 2, 3, 4, 10)], "g string, v int")
    r = audit.percentiles(df, F.col("v"), ("g",)).first()
    assert (r["median"], round(r["p95"], 9), r["max"]) == (3.0, 8.8, 10)
    texts = spark.createDataFrame([("a", "x x x"), ("b", "x y"), ("c", "")], "g string, t string")
    out = {r["g"]: r for r in audit.lexical_stats(texts, "t", ("g",)).collect()}
    assert out["a"]["normalized_entropy"] == 0 and abs(out["b"]["normalized_entropy"] - 1) < 1e-12
    assert (out["c"]["tokens"], out["c"]["type_token_ratio"]) == (0, 0.0)


def brute_terms(rows, k, n):
    totals: dict = {}
    for group, text in rows:
        words = (text or "").split()
        for i in range(len(words) - n + 1):
            totals.setdefault(group, Counter())[" ".join(words[i : i + n])] += 1
    return {(g, term, total, rank) for g, c in totals.items() for rank, (term, total) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:k], 1)}


@pytest.mark.parametrize("cells", [1, 64, 1000, 65_536])
@pytest.mark.parametrize("k,n", [(1, 1), (5, 3), (400, 2)])
def test_top_terms_are_exact_whatever_the_cells(spark, monkeypatch, cells, k, n):
    monkeypatch.setattr(audit, "CELLS", cells, raising=False)
    rng = random.Random(7)
    skewed = [(g, " ".join(rng.choice("abcdefgh"[: 2 + i % 7]) for _ in range(30))) for i, g in enumerate(["x", "y", None] * 10)]
    flat = [("flat", " ".join(f"w{i}" for i in range(300))), ("few", "a b c d"), ("none", "a"), ("none", ""), ("none", None), (None, None)]
    got = audit.top_terms(spark.createDataFrame(skewed + flat, "g string, t string"), "t", ("g",), k, n)
    assert {(r["g"], r["term"], r["total"], r["rank"]) for r in got.collect()} == brute_terms(skewed + flat, k, n)
    assert got.columns == ["g", "term", "total", "rank"]


def test_top_terms_shuffle_cells_and_not_every_term(spark, monkeypatch):
    monkeypatch.setattr(audit, "CELLS", 256, raising=False)
    rows = [("x", "a a a a a a a a b b b b b b b b " * 40 + " ".join(f"w{d}v{i}" for i in range(2000))) for d in range(10)]
    jvm = spark.sparkContext._jvm
    none, store = jvm.java.util.ArrayList(), spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: {s.stageId(): s.shuffleWriteRecords() for s in (lambda q: [q.apply(i) for i in range(q.size())])(store.stageList(none, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), none))}
    before = stages()
    got = audit.top_terms(spark.createDataFrame(rows, "g string, t string").repartition(2), "t", ("g",), 3, 3).collect()
    assert {(r["g"], r["term"], r["total"], r["rank"]) for r in got} == brute_terms(rows, 3, 3)
    written = sum(n for stage, n in stages().items() if stage not in before)
    assert 0 < written < 5_000  # of 20,000 distinct trigrams


@pytest.mark.parametrize("n,parts", [(150, (120, 15, 15)), (100, (80, 10, 10)), (5, (4, 0, 1)), (6, (5, 1, 0)), (1, (1, 0, 0))])
def test_split(spark, n, parts):
    df = spark.range(n).withColumn("g", F.lit("x"))
    out = split.stratified(df, "g", "id")
    counts = Counter(r["split"] for r in out.collect())
    assert tuple(counts[s] for s in ("train", "validation", "test")) == parts
    assert split.leakage(out, "id").count() == 0 and split.completeness(out, df, "id").count() == 0
    again = split.stratified(df.repartition(3), "g", "id")
    assert out.exceptAll(again).count() == 0


@pytest.fixture(scope="module")
def cases(spark):
    return generate.generate_cases(spark, 400).cache()


def test_generated_cases_are_valid(spark, cases):
    assert validate.with_case_errors(cases).where(F.size("errors") > 0).count() == 0
    counts = dict(split.distribution(cases, "case_pattern").collect())
    assert counts == generate.pattern_counts(400) and set(counts) == set(PATTERNS)
    assert cases.select("case_id").distinct().count() == 400
    assert cases.exceptAll(generate.generate_cases(spark, 400, partitions=7)).count() == 0
    assert cases.where(F.arrays_overlap("medications.items", "allergies.items")).count() == 0


def test_samples_validate_and_score(spark, cases):
    parts = split.stratified(cases, "case_pattern", "case_id")
    samples = generate.build_samples(parts).cache()
    checked = validate.with_sample_errors(samples, cases, parts)
    assert samples.count() == 400 * len(LANGUAGES) and checked.where(F.size("errors") > 0).count() == 0
    assert validate.case_coverage(samples).where("size(missing_languages) + size(extra_languages) > 0 or crosses_splits").count() == 0
    bad = samples.limit(3).withColumns({"split": F.lit("nowhere"), "language": F.lit("xx"), "source": F.lit("web"), "utterance": F.lit(" ")})
    codes = {r["code"] for r in elements(validate.with_sample_errors(bad, cases, parts), "errors.code", "code").collect()}
    assert {"split", "wrong_split", "language", "source", "empty_utterance"} <= codes
    # Perfect predictions pass every metric, and categories add up.
    perfect = score(samples.limit(60).withColumn("prediction", model_io.compact_json(F.col("target"))))
    broken = score(samples.limit(60).withColumn("prediction", F.when(F.crc32("case_id") % 2 == 0, model_io.compact_json(F.col("target"))).otherwise("no")))
    assert perfect.where(" and ".join(METRICS)).count() == 60
    for r in compare.outcomes(compare.paired(perfect, broken, check=True)).collect():
        assert r["both_correct"] + r["improved"] + r["regressed"] + r["both_wrong"] == r["total"] == 60
        assert r["base_correct"] == 60 and r["delta"] <= 0
    counts = {(r["scope"], r["metric"]): r for r in evaluate.long_counts(evaluate.metric_counts(broken)).collect()}
    languages = {s for s, _ in counts} - {"ALL"}
    for m in METRICS:
        assert sum(counts[(s, m)]["correct"] for s in languages) == counts[("ALL", m)]["correct"]
    with pytest.raises(expectations.ExpectationError):
        compare.paired(perfect, broken.limit(10), check=True)


def test_invalid_targets(spark):
    good = {"chief_complaint": "a", "symptoms": [{"name": "a", "status": "present", "duration": None}], "medications": {"status": "none", "items": []}, "allergies": {"status": "unknown", "items": []}, "missing_information": ["allergies", "duration"]}
    rows = {
        "good": (good, set()),
        "gone": ({k: v for k, v in good.items() if k != "symptoms"}, {"missing_fields"}),
        "twice": (good | {"symptoms": good["symptoms"] * 2}, {"duplicate_symptoms", "chief_complaint_count"}),
        "types": (good | {"chief_complaint": 3, "symptoms": {}, "missing_information": 1}, {"chief_complaint_type", "symptoms_type", "missing_information_type"}),
        "symptom": (good | {"symptoms": [{"name": "a", "status": "absent", "duration": {"value": 0, "unit": "years"}}, 5]}, {"duration_not_null", "duration_value", "duration_unit", "symptom_not_object", "chief_complaint_status", "missing_information_mismatch"}),
        "groups": (good | {"medications": {"status": "none", "items": ["x"]}, "allergies": {"status": "reported", "items": []}}, {"medications_items_not_empty", "allergies_items_empty", "missing_information_mismatch"}),
        "info": (good | {"medications": [], "allergies": {"status": "so", "items": 1}, "missing_information": ["duration", "fever"]}, {"medications_type", "allergies_status", "allergies_items_type", "missing_information_values", "missing_information_mismatch"}),
    }
    df = spark.createDataFrame([(k, json.dumps(v)) for k, (v, _) in rows.items()], "name string, t string")
    out = df.select("name", validate.target_errors(F.parse_json("t"))["code"].alias("codes")).collect()
    for r in out:
        assert set(r["codes"]) == rows[r["name"]][1], r


def test_quality_control(spark):
    samples = spark.createDataFrame([(i, "en") for i in range(4)], "case_id int, language string")
    verdicts = spark.createDataFrame([(0, "en", True, True), (1, "en", False, True), (2, "en", None, False)], "case_id int, language string, semantic_passed boolean, language_passed boolean")
    joined = qc.with_verdicts(samples, verdicts)
    assert [r["case_id"] for r in qc.accepted(joined).collect()] == [0] and qc.rejected(joined).count() == 3
    assert tuple(qc.failure_kinds(joined).first()) == (1, 0, 2)
    with pytest.raises(expectations.ExpectationError):
        qc.with_verdicts(samples, verdicts, check=True)
    with pytest.raises(expectations.ExpectationError):
        expectations.require_unique(samples.union(samples), ("case_id",))
    text = '```json\n{"semantic_passed": true, "language_passed": false, "semantic_errors": [], "language_errors": [{}]}```'
    assert one(spark, qc.parse_verdict(F.col("t")).isNotNull(), t=text) and not one(spark, qc.parse_verdict(F.col("t")).isNotNull(), t='{"semantic_passed": 1}')


def test_repair(spark, cases):
    fixed = repair.repair_cases(cases)
    report = repair.repair_report(fixed).first()
    assert report["total_cases"] == 400 and sum(report["changed_by_pattern"].values()) == report["changed_cases"] == len(report["changed_case_ids"])
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, None)], "k int, v string")
    assert sorted(map(tuple, repair.replace_by_key(old, new, ("k",)).collect())) == [(1, "a"), (2, None)]
    kept, removed = repair.invalidate(old, new, ("k",))
    assert kept.count() == removed.count() == 1 and repair.pending(old, new, ("k",)).first()["k"] == 1
    r = repair.repair_overlap(spark.createDataFrame([("c",)], "case_id string"), spark.createDataFrame([("c", "en"), ("d", "en")], "case_id string, language string")).first()
    assert tuple(r) == (7, 2, 8, 1)
    d = one(spark, generate.deterministic_duration(F.col("t")), t="case_0001")
    assert d["unit"] in ("hours", "days", "weeks") and 1 <= d["value"] <= 12


def test_cross_language(spark):
    rows = [("a", "hi", False), ("a", "de", True), ("b", "hi", False), ("b", "sw", False), ("b", "en", True), ("c", "en", True), ("d", "en", False)]
    out = {r["case_id"]: (r["class"], r["signature"]) for r in failures.cross_language(spark.createDataFrame(rows, "case_id string, language string, correct boolean")).collect()}
    assert out == {"a": ("mixed", "only_hi"), "b": ("mixed", "hi+sw"), "c": ("all_correct", None), "d": ("all_failed", "only_en")}


def test_jsonl(spark, tmp_path):
    at = str(tmp_path)
    (tmp_path / "a.jsonl").write_text('{"k": 1, "v": "é"}\n\n{"k": 1, "v": "z"}\nbroken\n', encoding="utf-8")
    good, bad = jsonl.read_jsonl_permissive(spark, at + "/a.jsonl", "k int, v string", ("k",))
    assert [tuple(r) for r in good.collect()] == [(1, "z")] and bad.count() == 1
    assert [(r["line"], r["text"]) for r in jsonl.numbered_errors(spark, at + "/a.jsonl").collect()] == [(4, "broken")]
    with pytest.raises(Exception, match="MALFORMED"):
        jsonl.read_jsonl(spark, at + "/a.jsonl", "k int, v string").collect()
    df = spark.createDataFrame([("train", 1, None), ("test", 2, "ü")], "split string, k int, v string")
    jsonl.write_jsonl(df, at + "/out", by=("split",))
    jsonl.write_jsonl(df.drop("split"), at + "/out/split=test", mode="append")
    tagged = jsonl.read_splits(spark, {"train": at + "/out/split=train", "test": at + "/out/split=test"}, "k int, v string")
    assert Counter(r["_split"] for r in tagged.collect()) == {"train": 1, "test": 3}
    jsonl.write_summary(df.groupBy().count(), at + "/s.json")
    assert json.loads((tmp_path / "s.json").read_text()) == {"count": 2} and jsonl.read_document(spark, at + "/s.json").first()["count"] == 2
    assert jsonl.back_up(spark, at + "/s.json") and not jsonl.back_up(spark, at + "/s.json")
    assert "train" in jsonl.table_text(df, {"split": 8, "k": 4})
    with pytest.raises(expectations.ExpectationError):
        jsonl.read_keyed(spark, at + "/out/split=test", "k int, v string", ("k",))


def test_model_calls(spark):
    tries = Counter()

    def flaky(prompts):
        tries["n"] += 1
        if tries["n"] < 3:
            raise OSError("later")
        return [p.upper() for p in prompts]

    assert model_io.with_retries(flaky, sleep=lambda s: None)(["a"]) == ["A"]
    df = spark.range(70).select("id", F.concat(F.lit("p"), "id").alias("prompt"))
    out = model_io.generate(df, "prompt", "answer", lambda ps: [p + "!" for p in ps])
    assert out.where("answer <> concat(prompt, '!')").count() == 0 and out.count() == 70
    target = '{"chief_complaint":"a","symptoms":[{"name":"a","status":"present","duration":{"value":"4","unit":"days"}}],"medications":{"status":"unknown","items":[]},"allergies":{"status":"none","items":[]},"missing_information":[],"more":1}'
    rows = spark.createDataFrame([("x", "en"), ("y", "en"), ("z", "en")], "text string, language string")
    answers = {"x": target, "y": "nothing", "z": "{}"}
    out = {r["text"]: r for r in model_io.structure_intake(rows, lambda ps: [answers[p] for p in ps]).collect()}
    assert out["x"]["result"]["missing_information"] == ["medications"] and out["x"]["result"]["symptoms"][0]["duration"]["value"] == 4
    assert (out["y"]["error"], out["z"]["error"]) == ("invalid_json", "invalid_fields")
    a = spark.createDataFrame([(0, "a"), (1, "b")], "i int, k string")
    assert model_io.aligned(a, a.withColumn("k", F.lit("a")), "i", ("k",)).collect()[0]["i"] == 1
    assert [tuple(r) for r in spark.range(1).select(F.inline(model_io.messages(F.lit("s"), F.lit("u"), F.lit("a")))).collect()] == [("system", "s"), ("user", "u"), ("assistant", "a")]


def test_resume_stream(spark, tmp_path):
    source, sink, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    rows = spark.createDataFrame([("c1", "train", "en"), ("c1", "train", "en"), ("c2", "train", "de")], "case_id string, split string, language string")
    rows.write.json(source)
    schema = "case_id string, split string, language string"
    for _ in range(2):
        resume_stream(spark, source, schema, sink, check, lambda df: df.withColumn("done", F.lit(True))).awaitTermination(60)
        rows.union(spark.createDataFrame([("c3", "test", "fr")], schema)).write.mode("append").json(source)
    resume_stream(spark, source, schema, sink, check, lambda df: df.withColumn("done", F.lit(True))).awaitTermination(60)
    assert sorted(r["case_id"] for r in spark.read.parquet(sink).collect()) == ["c1", "c2", "c3"]


def test_types_parse(spark):
    assert spark.createDataFrame([], SAMPLE).schema["target"].dataType.simpleString() == TARGET


def test_sorted_json_keeps_rows_without_json(spark, tmp_path):
    from caseframe.plans import catalogue

    rows = [(1, '{"a": 1}'), (2, None), (3, "no json"), (7, None)]
    spark.createDataFrame(rows, "event_id long, props string").write.parquet(str(tmp_path / "events.parquet"))
    out = {r["event_id"]: r["json"] for r in catalogue.sorted_json(spark, str(tmp_path)).collect()}
    assert out == {1: '{"a":1}', 2: None, 3: None, 7: None}
