from __future__ import annotations

import math
import re

import pytest
from pyspark.sql import functions as F

from caseframe.llm import mixing, sharding

DOCS = "doc_id long, text string, lang string, source string, size string, _bucket int"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, "clash", 7) for i, t, s in rows], DOCS)


def test_mix_targets_and_edges(spark):
    rows = [(i, "w " * (1 + i % 7), "ab"[i % 2]) for i in range(60)] + [(100, None, "a"), (101, "", None), (102, "x y\tz\u00a0q", None), (None, "null id", "c"), (5, "w w w w w w", "b"), (5, "w w w w w w", "b")]
    out = mixing.mix(documents(spark, rows)).collect()
    assert len(out) == len(rows) and "_bucket" in out[0].asDict() and out[0]["_bucket"] == 7
    size = {}
    for r in out:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        assert 0 <= r["taken"] <= 2 * r["size"]
        size[r["source"]] = size.get(r["source"], 0) + r["size"]
    total = sum(size.values())
    goals = {r["source"]: r["target"] for r in out}
    assert math.isclose(sum(goals.values()), 1.5 * total) and all(goals[s] <= 2 * size[s] + 1e-9 for s in size)
    for s in size:
        assert abs(sum(r["taken"] for r in out if r["source"] == s) - goals[s]) <= 1
    again = mixing.mix(documents(spark, rows[::-1]).repartition(5)).collect()
    key = lambda r: (str(r["doc_id"]), str(r["text"]), r["taken"], r["target"])
    assert sorted(map(key, out)) == sorted(map(key, again))


def test_mix_empty(spark):
    assert mixing.mix(documents(spark, []).limit(0)).count() == 0


def test_repeated_texts(spark):
    rows = documents(spark, [(1, " a b  c\nd ", "s"), (2, "e f g", "s"), (3, None, "s")])
    mixed = rows.drop("size").withColumns({"size": F.when(F.col("doc_id") == 1, 4).when(F.col("doc_id") == 2, 3).otherwise(0), "source_size": F.lit(7), "target": F.lit(9.0)})
    mixed = mixed.withColumn("taken", F.when(F.col("doc_id") == 1, 6).when(F.col("doc_id") == 2, 3).otherwise(0).cast("long"))
    out = sorted((r["doc_id"], r["text"]) for r in mixing.repeated(mixed).collect())
    assert out == [(1, " a b"), (1, " a b  c\nd "), (2, "e f g")]


def test_water_filling(spark):
    sizes = spark.createDataFrame([(True, "a", 100), (True, "b", 1000), (True, "c", 10), (False, "", 50), (True, "z", 0)], "_known boolean, _source string, source_size long")
    out = {r["_source"]: r["target"] for r in mixing.targets(sizes, (5, 2, 1), 1.5, 2).collect()}
    weights = dict(zip(["a", "b", "c", "z", ""], [5, 2, 1, 5, 2], strict=True))
    caps = {"a": 200, "b": 2000, "c": 20, "": 100, "z": 0}
    goal, left, got = 1.5 * 1160, set(caps), {}
    while True:  # share, stop what is above, share the excess again
        level = (goal - sum(got.values())) / sum(weights[s] for s in left)
        above = {s for s in left if weights[s] * level > caps[s]}
        if not above:
            break
        got |= {s: caps[s] for s in above}
        left -= above
    got |= {s: weights[s] * level for s in left}
    assert all(math.isclose(out[s], got[s], abs_tol=1e-9) for s in caps)


@pytest.mark.parametrize("good,bad,sample", [(6, 9, 5), (40, 25, 30), (300, 80, 200), (5, 400, 100)])
def test_hypergeometric_law(spark, good, bad, sample):
    n = 4000
    draw = sharding.hypergeometric(f"{good}L", f"{bad}L", f"{sample}L", "'t'", "id")
    counts = dict(spark.range(n).select(F.expr(draw).alias("x")).groupBy("x").count().collect())
    whole = math.comb(good + bad, sample)
    chi, cells, rest_seen, rest = 0.0, 0, 0, 0.0
    for x in range(max(0, sample - bad), min(good, sample) + 1):
        expected = n * math.comb(good, x) * math.comb(bad, sample - x) / whole
        if expected < 8:
            rest, rest_seen = rest + expected, rest_seen + counts.get(x, 0)
            continue
        chi += (counts.get(x, 0) - expected) ** 2 / expected
        cells += 1
    assert sum(counts.values()) == n and all(max(0, sample - bad) <= x <= min(good, sample) for x in counts)
    assert chi < cells + 5 * math.sqrt(2 * cells) + 5 and rest_seen <= rest + 6 * math.sqrt(rest + 1) + 3


def test_hypergeometric_ends(spark):
    for good, bad, sample, want in [(0, 5, 3, 0), (5, 0, 3, 3), (5, 5, 0, 0), (5, 7, 12, 5), (1, 0, 1, 1), (0, 0, 0, 0)]:
        assert spark.range(1).select(F.expr(sharding.hypergeometric(f"{good}L", f"{bad}L", f"{sample}L", "'t'", "id"))).first()[0] == want


@pytest.mark.parametrize("n", [0, 1, 39, 1234])
def test_shards_exact(spark, n):
    rows = spark.range(n).select(F.when(F.col("id") % 50 == 3, F.lit(None).cast("long")).otherwise(F.floor(F.col("id") / 2)).alias("doc_id"), F.lit("x").alias("shard"), F.lit(1).alias("_row2"))
    out = sharding.shuffle_shards(rows, 40, rows_per_block=16).collect()
    assert len(out) == n
    sizes = [0] * 40
    slots = {}
    for r in out:
        sizes[r["shard"]] += 1
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_shards_are_stable_and_mixed(spark):
    a = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shuffle_shards(spark.range(2000).withColumnRenamed("id", "doc_id"), 8, rows_per_block=64).collect()}
    b = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shuffle_shards(spark.range(2000).withColumnRenamed("id", "doc_id").repartition(7), 8, rows_per_block=64).collect()}
    assert a == b
    # Neighbours fall together about one time in eight.
    together = sum(a[i][0] == a[i + 1][0] for i in range(1999))
    assert 170 < together < 340
