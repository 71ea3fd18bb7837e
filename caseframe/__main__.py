"""Command line: evaluate predictions, compare two models, analyse failures.

    python -m caseframe evaluate --predictions P --name N --output-dir D [--dialect e2] [--only-split test]
    python -m caseframe compare --base P --candidate P --output-dir D [--metric core_exact]
    python -m caseframe failures --input P --output-dir D
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseframe.functions.text import safe_model_name
from caseframe.operators import compare, evaluate, failures, metrics
from caseframe.operators.expectations import require_some, require_split, require_unique
from caseframe.schema import DIALECTS, METRICS, PREDICTION
from caseframe.session import build_session
from caseframe.sources.jsonl import read_jsonl, table_text, write_jsonl, write_summary, write_text

KEY = ("case_id", "language")


def _read(spark: SparkSession, path: str) -> DataFrame:
    df = read_jsonl(spark, path, PREDICTION)
    require_some(df, path)
    require_unique(df, KEY)
    return df


def _name(spark: SparkSession, name: str) -> str:
    return spark.range(1).select(safe_model_name(F.lit(name))).first()[0]


def run_evaluate(spark: SparkSession, args: argparse.Namespace) -> None:
    df = _read(spark, args.predictions)
    if args.only_split:
        require_split(df, args.only_split)
    dialect = DIALECTS[args.dialect]
    scored = metrics.score(df, dialect)
    at = f"{args.output_dir}/{_name(spark, args.name)}"
    write_jsonl(scored.select(*KEY, F.struct(*METRICS).alias("metrics")), f"{at}_samples")
    rows = evaluate.long_counts(evaluate.metric_counts(scored), dialect.accuracy).orderBy("scope", "metric")
    write_summary(rows, f"{at}_metrics.json")
    write_text(spark, table_text(rows, {"scope": 10, "metric": 28, "correct": 9, "total": 9, "accuracy": 22}) + "\n", f"{at}_metrics.txt")


def run_compare(spark: SparkSession, args: argparse.Namespace) -> None:
    pairs = compare.paired(metrics.score(_read(spark, args.base)), metrics.score(_read(spark, args.candidate)), check=True)
    at = args.output_dir
    write_summary(compare.outcomes(pairs).orderBy("metric"), f"{at}/summary.json")
    write_summary(compare.outcomes(pairs, "language").orderBy("language", "metric"), f"{at}/by_language.json")
    columns = [c for c in pairs.columns if c.startswith("category_")]
    write_jsonl(pairs.select(*KEY, *columns), f"{at}/samples")
    for wanted in ("improved", "regressed", "both_wrong"):
        write_jsonl(compare.in_category(pairs, wanted, args.metric).select(*KEY), f"{at}/{wanted}")


def run_failures(spark: SparkSession, args: argparse.Namespace) -> None:
    failed = failures.failures(_read(spark, args.input)).where(~failures.is_correct())
    at = args.output_dir
    write_jsonl(failed.select(*KEY, "errors", "failures"), f"{at}/records")
    counts = failures.per_record(failed).join(failures.per_occurrence(failed), "error_type", "full").orderBy(F.desc("records"), "error_type")
    write_summary(counts, f"{at}/error_types.json")
    write_text(spark, table_text(counts, {"error_type": 24, "records": 9, "occurrences": 12}) + "\n", f"{at}/error_types.txt")
    write_summary(failures.most_common(failures.combinations(failed), "combination", "records", 15), f"{at}/combinations.json")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="caseframe")
    commands = top.add_subparsers(dest="command", required=True)
    one = commands.add_parser("evaluate")
    one.add_argument("--predictions", required=True)
    one.add_argument("--name", required=True)
    one.add_argument("--dialect", choices=sorted(DIALECTS), default="e2")
    one.add_argument("--only-split")
    two = commands.add_parser("compare")
    two.add_argument("--base", required=True)
    two.add_argument("--candidate", required=True)
    two.add_argument("--metric", choices=METRICS, default="core_exact")
    three = commands.add_parser("failures")
    three.add_argument("--input", required=True)
    for p in (one, two, three):
        p.add_argument("--output-dir", required=True)
    return top


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(arguments)
    session = spark or SparkSession.getActiveSession() or build_session()
    {"evaluate": run_evaluate, "compare": run_compare, "failures": run_failures}[args.command](session, args)


if __name__ == "__main__":
    main()
