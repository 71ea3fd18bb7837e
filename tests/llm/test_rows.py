"""Rows that share ids, ids of any size, clashing columns, and large families of near copies."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from caseframe.llm import neardup
from test_neardup_pipeline import brute, edited

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, k):
    return ["w%d" % rng.randrange(10**6) for _ in range(k)]


def test_ids_of_any_size(spark):
    rng = random.Random(1)
    base = words(rng, 60)
    ids = [2**63 - 1 - i for i in range(20)] + [-(2**63) + i for i in range(20)] + [2**62 + i for i in range(20)]
    rows = [(i, edited(rng, base, 1)) for i in ids]
    out = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(out) == set(ids) and set(out.values()) == {-(2**63)}


def test_rows_that_share_an_id_are_told_apart(spark):
    rng = random.Random(2)
    a, one, two = " ".join(words(rng, 50)), words(rng, 50), None
    two = " ".join(one[:-1] + ["other"])
    rows = [(5, a), (5, " ".join(one)), (9, a), (11, two)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = Counter((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(df).collect())
    assert out == Counter([(5, 5, True), (5, 5, True), (9, 5, False), (11, 5, False)])
    kept = sorted((r["doc_id"], r["text"]) for r in neardup.one_of_each(df).collect())
    assert kept == sorted([(5, a), (5, " ".join(one))])


def test_no_group_is_lost_when_its_first_row_shares_an_id(spark):
    rng = random.Random(3)
    a, other = " ".join(words(rng, 50)), words(rng, 50)
    rows = [(5, a, 1), (9, a, 2), (5, " ".join(other), 3), (3, " ".join(other), 4), (None, a, 5), (None, "x y", 6), (None, "x y", 7), (8, None, 8), (8, None, 9)]
    out = sorted(r["n"] for r in neardup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, n int")).collect())
    assert out[:2] == [1, 4] and len(out) == 5 and out[2] in (6, 7) and out[3:] == [8, 9]


def test_columns_of_clashing_names_pass_every_stage(spark):
    rng = random.Random(4)
    made = ["row", "rep", "size", "target", "taken", "source_size", "kept", "n_words", "d2", "digest", "component_id", "first", "mix:part"]
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "epsi"]) + str(rng.randrange(50)) for _ in range(80)), "en", "s", 5) for i in range(30)]
    docs = spark.createDataFrame(rows, DOCS)
    docs = docs.select("*", *[F.lit(f"own {c}").alias(c) for c in made])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        got = out.collect()
        assert got and all(r[c] == f"own {c}" for r in got for c in made), name
    assert stage(spark, docs, "").count() and corpus_pipeline.STAGES[-1][1](spark, docs, "").count() >= 30


def test_stages_take_nulls_and_repeats(spark):
    rng = random.Random(5)
    text = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(90)) for _ in range(90))
    same = text()
    rows = [(i, text(), "en", "s", 5) for i in range(40)] + [(None, None, None, None, None), (700, "", "en", None, 0), (70, same, None, "s", 3), (70, same, None, "s", 3), (None, same, None, "s", 3), (2**62, text(), "en", "s", None)]
    rows += [(90, "long " * 30_000 + same, "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    stages = dict(corpus_pipeline.STAGES)
    quality = [r["doc_id"] for r in stages["quality"](spark, docs, "").collect()]
    assert quality.count(70) == 2 and None in quality and 700 not in quality and 90 not in quality
    dedup = Counter(r["doc_id"] for r in stages["near_dedup"](spark, docs, "").collect())
    assert dedup[70] == 1 and dedup[None] == 1 and dedup[700] == 1 and dedup[2**62] == 1
    redacted = Counter(tuple(r) for r in stages["secrets"](spark, docs, "").collect())
    assert redacted == Counter(rows)
    mixed = [r["doc_id"] for r in stages["mixing"](spark, docs, "").collect()]
    assert 2**62 in mixed and 700 not in mixed
    packed = Counter(r["doc_id"] for r in stages["packing"](spark, docs, "").collect() if r["piece"] == 0)
    assert packed == Counter(r[0] for r in rows)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_links_of_sets_connect_what_all_links_connect(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 90, dtype=np.uint64)
    sets = []
    for _ in range(120):
        own = base[: rng.integers(20, 90)] if rng.random() < 0.7 else rng.integers(0, 2**63, 30, dtype=np.uint64)
        sets.append(np.unique(np.where(rng.random(len(own)) < 0.04, rng.integers(0, 2**63, len(own), dtype=np.uint64), own)))
    up = neardup._Forest(len(sets))
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                up.join(i, j)
    got = neardup._Forest(len(sets))
    for i, j in neardup._linked(sets):
        both = len(np.intersect1d(sets[i], sets[j]))
        assert 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both)
        assert got.join(i, j)  # a forest: no link closes a ring
    assert [up.root(i) for i in range(len(sets))] == [got.root(i) for i in range(len(sets))]


def test_heavy_groups_are_cut_by_weight(spark, monkeypatch):
    """Groups of few but long texts are cut too; several texts stay outside of the largest group."""
    monkeypatch.setattr(neardup, "WEIGHT", 900)
    monkeypatch.setattr(neardup, "PIVOTS", 2)
    rng = random.Random(6)
    base, rows = words(rng, 90), []
    for i in range(30):
        rows.append((i, edited(rng, base, 1)))
    other = base[:60] + words(rng, 30)  # like the others, but no link
    rows += [(100 + i, edited(rng, other, 1)) for i in range(12)] + [(200, " ".join(base[:58] + words(rng, 32)))]
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == brute(rows)
