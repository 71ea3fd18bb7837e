"""Queries that go through sinks and back, through model calls, and through assertions; with their DuckDB SQL."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseframe.operators import expectations, generate, model_io, repair, split
from caseframe.schema import INFO_STATUSES, LANGUAGES, PATTERN_WEIGHTS, PATTERNS
from caseframe.sources import jsonl, scratch
from caseframe.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


def query(sql: str | None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            ORACLE[function.__name__] = sql
        return function

    return register


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sink and a fail-fast scan."""
    path = scratch.new_path(spark, "jsonl")
    jsonl.write_jsonl(_documents(spark, sf_dir), path)
    return jsonl.read_jsonl(spark, path, DOCUMENT)


@query("SELECT doc_id, quality::BIGINT AS quality, toxic::BIGINT AS toxic FROM labels")
def jsonl_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bare scan that infers its types."""
    path = scratch.new_path(spark, "jsonl")
    jsonl.write_jsonl(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), path)
    return jsonl.read_jsonl(spark, path)


@query("""SELECT CASE WHEN toxic = 1 THEN 'bad' ELSE 'good' END AS side, CASE WHEN toxic = 1 THEN NULL ELSE doc_id END AS doc_id, count(*) AS total FROM labels GROUP BY ALL""")
def jsonl_permissive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: lines of toxic rows are cut off; they are set aside."""
    path = scratch.new_path(spark, "lines")
    line = F.to_json(F.struct("doc_id", "quality"))
    cut = F.when(F.col("toxic") == 1, F.rtrim(line, F.lit("}"))).otherwise(line)
    table(spark, sf_dir, "labels").select(cut.alias("value")).write.text(path)
    good, bad = jsonl.read_jsonl_permissive(spark, path, "doc_id long, quality int")
    rows = good.select(F.lit("good").alias("side"), "doc_id").unionByName(bad.select(F.lit("bad").alias("side"), F.lit(None).cast("long").alias("doc_id")))
    return split.distribution(rows, "side", "doc_id")


@query("SELECT doc_id, lang FROM documents")
def jsonl_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan whose key must be complete and unique."""
    path = scratch.new_path(spark, "jsonl")
    jsonl.write_jsonl(_documents(spark, sf_dir).select("doc_id", "lang"), path)
    return jsonl.read_keyed(spark, path, "doc_id long, lang string", ("doc_id",))


@query("SELECT CASE lang WHEN 'en' THEN 'test' ELSE 'train' END AS _split, lang, count(*) AS total FROM documents WHERE lang IN ('en', 'de') GROUP BY ALL")
def jsonl_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several files as one table, tagged with their splits."""
    paths = {s: scratch.new_path(spark, "jsonl") for s in ("train", "test")}
    for name, lang in (("train", "de"), ("test", "en")):
        jsonl.write_jsonl(_documents(spark, sf_dir).where(F.col("lang") == lang).select("doc_id", "lang"), paths[name])
    return split.distribution(jsonl.read_splits(spark, paths, "doc_id long, lang string"), "_split", "lang")


@query("SELECT lang, count(*) AS total FROM documents GROUP BY lang")
def summary_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small aggregate as one JSON document, and back."""
    path = scratch.new_path(spark, "summary") + "/summary.json"
    jsonl.write_summary(split.distribution(_documents(spark, sf_dir), "lang"), path)
    return jsonl.read_document(spark, path, "lang string, total long")


@query("SELECT doc_id, lang FROM documents")
def jsonl_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder for each language."""
    path = scratch.new_path(spark, "jsonl")
    jsonl.write_jsonl(_documents(spark, sf_dir).select("doc_id", "lang"), path, by=("lang",))
    return jsonl.read_jsonl(spark, path, "doc_id long, lang string")


@query("SELECT doc_id, 2::BIGINT AS total FROM labels")
def jsonl_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows added to a table that is there."""
    path, rows = scratch.new_path(spark, "jsonl"), table(spark, sf_dir, "labels").select("doc_id")
    for _ in range(2):
        jsonl.write_jsonl(rows, path, "append")
    return split.distribution(jsonl.read_jsonl(spark, path, "doc_id long"), "doc_id")


@query("""SELECT line FROM (SELECT 'lang        total' AS line UNION ALL SELECT '-----------------'
  UNION ALL SELECT rtrim(rpad(lang, 8, ' ') || '  ' || lpad(count(*)::VARCHAR, 7, ' ')) FROM documents GROUP BY lang)""")
def text_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed-width report."""
    path = scratch.new_path(spark, "report") + "/report.txt"
    jsonl.write_text(spark, jsonl.table_text(split.distribution(_documents(spark, sf_dir), "lang").orderBy("lang"), {"lang": 8, "total": 7}) + "\n", path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("SELECT doc_id, 'copied' AS state FROM labels")
def backup_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A copy beside the table; a second call leaves it alone."""
    path = scratch.new_path(spark, "jsonl")
    scratch.adopt(path + ".backup")
    jsonl.write_jsonl(table(spark, sf_dir, "labels").select("doc_id"), path)
    done = jsonl.back_up(spark, path) and not jsonl.back_up(spark, path)
    return jsonl.read_jsonl(spark, path + ".backup", "doc_id long").withColumn("state", F.lit("copied" if done else "not copied"))


@query("SELECT o_orderkey AS row, o_custkey AS visible, 1::BIGINT AS fields FROM orders")
def prompt_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model may see of a case; ids, split, pattern and group are hidden."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_orderpriority").alias("case_pattern"), F.col("o_orderstatus").alias("symptom_group"), F.lit("train").alias("_split"), "o_custkey")
    seen = model_io.prompt_case(rows)
    return rows.select(F.col("case_id").alias("row"), *[F.col(c).alias("visible") for c in seen], F.lit(len(seen)).cast("long").alias("fields"))


@query("""SELECT l_orderkey, l_linenumber, md5('Say in en, in one or two plain sentences of a patient, exactly what this case says and nothing else: {"l_partkey":' || l_partkey || ',"l_returnflag":"' || l_returnflag || '"}') AS prompt_md5 FROM lineitem""")
def utterance_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt for an utterance."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    seen = rows.select("l_partkey", "l_returnflag")
    return rows.select("l_orderkey", "l_linenumber", F.md5(model_io.utterance_prompt(seen, F.lit("en"))).alias("prompt_md5"))


def _lengths(prompts: list[str]) -> list[str]:
    """A stand-in for a model: it answers with a prompt's length."""
    return [str(len(p)) for p in prompts]


@query("SELECT doc_id, length(text)::VARCHAR AS answer FROM documents")
def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M-call, T8: a batch function over whole texts, 32 at a time."""
    return model_io.generate(_documents(spark, sf_dir).select("doc_id", "text"), "text", "answer", _lengths, keep=("doc_id",))


def _intake(prompts: list[str]) -> list[str]:
    """A stand-in for a model: bare JSON, prose, or JSON without a field, by the prompt's length."""
    found = {"chief_complaint": "cough", "symptoms": [{"name": "cough", "status": "present", "duration": None}]}
    found |= {g: {"status": "unknown", "items": []} for g in ("medications", "allergies")} | {"missing_information": []}
    short = {k: v for k, v in found.items() if k != "allergies"}
    return [(json.dumps(found), "no idea", json.dumps(short))[len(p) % 3] for p in prompts]


@query("""SELECT doc_id, CASE length(text) % 3 WHEN 0 THEN 'cough' END AS chief, CASE length(text) % 3 WHEN 0 THEN 'duration,medications,allergies' END AS missing,
  CASE length(text) % 3 WHEN 1 THEN 'invalid_json' WHEN 2 THEN 'invalid_fields' END AS error FROM documents""")
def intake_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to structures, their missing fields derived anew."""
    out = model_io.structure_intake(_documents(spark, sf_dir).select("doc_id", "text"), _intake)
    return out.select("doc_id", F.col("result.chief_complaint").alias("chief"), F.array_join("result.missing_information", ",").alias("missing"), "error")


@query("SELECT 'simple' AS case_pattern, 150::BIGINT AS total UNION ALL VALUES ('negation', 150), ('uncertainty', 150), ('mixed', 150), ('missing_duration', 100), ('missing_medications', 100), ('missing_allergies', 100), ('multiple_present', 100)")
def asserted_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts that are checked before they are returned."""
    cases = generate.generate_cases(spark, 1000)
    expectations.require_counts(cases, "case_pattern", {p: round(1000 * w) for p, w in zip(PATTERNS, PATTERN_WEIGHTS, strict=True)})
    return split.distribution(cases, "case_pattern")


@query("SELECT unnest(['en', 'de', 'ar_msa', 'fr', 'es', 'hi', 'sw']) AS language, 1000::BIGINT AS total")
def asserted_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every case in every language."""
    rows = generate.expand_languages(generate.generate_cases(spark, 1000).select("case_id"))
    expectations.require_same_values(rows, "language", LANGUAGES)
    return split.distribution(rows, "language")


@query("SELECT doc_id, quality FROM labels")
def asserted_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that must be within another table."""
    rows = table(spark, sf_dir, "labels").select("doc_id", "quality")
    repair.require_subset(rows, table(spark, sf_dir, "documents"), ("doc_id",))
    return rows


SHAPES = {"simple": "1", "negation": "2", "uncertainty": "2", "mixed": "4", "missing_duration": "1-2", "missing_medications": "1-2", "missing_allergies": "1-2", "multiple_present": "2-4"}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{n}')" for p, n in SHAPES.items()) + ") t(case_pattern, symptoms)")
def generated_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least and the most symptoms of each pattern's cases."""
    n = F.size("symptoms")
    rows = generate.generate_cases(spark, 4000).groupBy("case_pattern").agg(F.min(n).cast("string").alias("a"), F.max(n).cast("string").alias("b"))
    return rows.select("case_pattern", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.concat_ws("-", "a", "b")).alias("symptoms"))


@query("""SELECT * FROM (VALUES ('medications', 'missing_medications', 'unknown'), ('allergies', 'missing_allergies', 'unknown'),
  ('medications', 'other', 'none'), ('medications', 'other', 'reported'), ('medications', 'other', 'unknown'), ('allergies', 'other', 'none'), ('allergies', 'other', 'reported'), ('allergies', 'other', 'unknown')) t(field, case_pattern, status)""")
def generated_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statuses that medications and allergies take."""
    cases, parts = generate.generate_cases(spark, 4000), []
    for field in ("medications", "allergies"):
        forced = F.col("case_pattern") == f"missing_{field}"
        parts.append(cases.select(F.lit(field).alias("field"), F.when(forced, F.col("case_pattern")).otherwise("other").alias("case_pattern"), F.col(field)["status"].alias("status")))
    return parts[0].unionByName(parts[1]).where(F.col("status").isin(*INFO_STATUSES)).distinct()


@query("SELECT * FROM (VALUES ('hours', 1, 12), ('days', 1, 7), ('weeks', 1, 3)) t(unit, least, most)")
def generated_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranges of random durations."""
    rows = generate.generate_cases(spark, 4000).select(F.explode("symptoms").alias("s")).where("s.duration is not null")
    return rows.groupBy(F.col("s.duration.unit").alias("unit")).agg(F.min("s.duration.value").alias("least"), F.max("s.duration.value").alias("most"))
