from __future__ import annotations

import json

from pyspark.sql import functions as F

from caseframe.__main__ import main
from caseframe.operators import generate, model_io, split


def test_command_line(spark, tmp_path):
    at = str(tmp_path)
    cases = split.stratified(generate.generate_cases(spark, 20), "case_pattern", "case_id")
    rows = generate.build_samples(cases).withColumn("split", F.lit("test"))
    good = rows.withColumn("prediction", model_io.compact_json(F.col("target"))).drop("source", "schema_version")
    bad = good.withColumn("prediction", F.when(F.col("language") == "hi", "no").otherwise(F.col("prediction")))
    for name, df in (("good", good), ("bad", bad)):
        df.write.option("ignoreNullFields", "false").json(f"{at}/{name}")
    main(["evaluate", "--predictions", f"{at}/bad", "--name", "My Model+1", "--output-dir", at, "--only-split", "test"], spark)
    found = {(r["scope"], r["metric"]): r for r in json.loads((tmp_path / "my_modelplus1_metrics.json").read_text())}
    assert found[("hi", "core_exact")]["correct"] == 0 and found[("en", "core_exact")]["accuracy"] == 1.0 and found[("ALL", "valid_json")]["failed"] == 20
    assert "valid_json" in (tmp_path / "my_modelplus1_metrics.txt").read_text()
    main(["compare", "--base", f"{at}/bad", "--candidate", f"{at}/good", "--output-dir", f"{at}/cmp"], spark)
    summary = {r["metric"]: r for r in json.loads((tmp_path / "cmp/summary.json").read_text())}
    assert summary["core_exact"]["improved"] == 20 and summary["core_exact"]["regressed"] == 0
    assert spark.read.json(f"{at}/cmp/improved").count() == 20
    main(["failures", "--input", f"{at}/bad", "--output-dir", f"{at}/fail"], spark)
    assert json.loads((tmp_path / "fail/error_types.json").read_text()) == {"error_type": "invalid_json", "records": 20, "occurrences": 20}
