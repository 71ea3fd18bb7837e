"""A model call's worker holds one call's prompts, not a frame of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseframe.operators import model_io


def test_whole_texts_do_not_pile_up(spark):
    def largest(prompts: list[str]) -> list[str]:
        import resource

        return [str(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024) for _ in prompts]

    def peak(n: int) -> int:
        rows = spark.range(0, n, 1, 1).select("id", F.repeat(F.lit("ü"), 50_000).alias("text"))
        return model_io.generate(rows, "text", "answer", largest, keep=("id",)).agg(F.max(F.col("answer").cast("int")), F.count("*")).first()[0]

    least = peak(1)
    assert peak(3000) < least + 230


def test_null_prompts_and_kept_columns(spark):
    rows = spark.createDataFrame([(i, None if i % 7 == 0 else "x" * i, [i]) for i in range(100)], "i int, t string, l array<int>").coalesce(1)
    out = model_io.generate(rows, "t", "a", lambda ps: [None if p is None else str(len(p)) for p in ps]).orderBy("i").collect()
    assert [tuple(r) for r in out] == [(i, None if i % 7 == 0 else "x" * i, [i], None if i % 7 == 0 else str(i)) for i in range(100)]
