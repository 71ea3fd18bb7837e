from __future__ import annotations

import random
import re
import string
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from caseframe.llm import neardup, secrets

UPPER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    """component of each doc_id by comparing all pairs."""
    sets = {i: shingle_set(t) for i, t in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def edited(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        words[rng.randrange(len(words))] = "new" + str(rng.randrange(10**6))
    return " ".join(words)


def corpus(seed, n=260):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    text = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    rows, bases = [], [text(rng.choice([4, 6, 20, 80, 150])) for _ in range(12)]
    passage = text(60)
    for i in range(n):
        kind = i % 5
        if kind < 2:
            base = rng.choice(bases)
            rows.append((i, edited(rng, base, rng.choice([0, 0, 1, 1, 2, 3]) if len(base) > 10 else 0)))
        elif kind == 2:
            rows.append((i, " ".join(text(20) + passage + text(rng.randint(1, 30)))))
        else:
            rows.append((i, " ".join(text(rng.randint(1, 60)))))
    return rows + [(1000, None), (1001, ""), (1002, " \n"), (1003, "One Two"), (1004, "one two"), (1005, "ONE two")]


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_equal_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "doc_id long, text string, component_id string, node int").repartition(6)
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df).collect()}
    assert out == brute(rows)


def test_large_nodes_branch_and_exchange(spark, monkeypatch):
    """Small limits send groups through every path: branching, exchanges, and groups too large for a task."""
    monkeypatch.setattr(neardup, "GROUP", 12)
    rng = random.Random(9)
    base = ["w%d" % rng.randrange(10**6) for _ in range(80)]
    rows = [(i, edited(rng, base, rng.choice([0, 1]))) for i in range(60)] + [(100 + i, " ".join("u%d" % rng.randrange(10**6) for _ in range(30))) for i in range(20)]
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == brute(rows)


def test_streamed_runs_cross_batches():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    tokens = rng.integers(0, 16, (10, neardup.SIZE), dtype=np.uint8)
    rows = [(1, 1, 0), (1, 2, 0), (2, 3, 1), (3, 4, 2), (3, 5, 2), (3, 6, 2), (4, 7, 3)]
    for size in (1, 2, 3, 7):
        batches = []
        for at in range(0, len(rows), size):
            part = rows[at : at + size]
            packed = [(tokens[k][::2] | (tokens[k][1::2] << 4)).tobytes() for _, _, k in part]
            batches.append(pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.int64()), pa.array(packed, pa.binary())], ["node", "rep", "nibbles"]))
        found = {(a, b) for out in neardup._level(0)(iter(batches)) for a, b in zip(out.column(1).to_pylist(), out.column(2).to_pylist(), strict=True)}
        assert found == {(1, 2), (4, 5), (4, 6)}, size


def test_oversized_runs_go_to_children(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(neardup, "FITS", 100)
    rng = np.random.default_rng(2)
    tokens = rng.integers(0, 16, (400, neardup.SIZE), dtype=np.uint8)
    packed = tokens[:, ::2] | (tokens[:, 1::2] << 4)
    batches = [pa.RecordBatch.from_arrays([pa.array(np.full(40, 5)), pa.array(np.arange(at, at + 40)), neardup._fixed(packed[at : at + 40])], ["node", "rep", "nibbles"]) for at in range(0, 400, 40)]
    out = list(neardup._level(0)(iter(batches)))
    reps = Counter(r for b in out for k, r in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True) if k == 1)
    assert set(reps) == set(range(400)) and len(set(reps.values())) == 1
    out = list(neardup._level(neardup.EXCHANGES)(iter(batches)))
    assert all(k == 0 for b in out for k in b.column(0).to_pylist())


def test_nulls_repeats_and_empty(spark):
    rows = [(None, "a b c d e f g"), (None, "a b c d e f g"), (3, "a b c d e f g"), (3, "a b c d e f g"), (1, "A b c d e f g"), (8, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(df).collect())
    assert out == Counter([(None, 3, None, True)] * 2 + [(3, 3, 1, False)] * 2 + [(1, 3, 1, True), (8, 0, 8, True)])
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (200, 200)] + [(300, 300 + i) for i in range(1, 50)]
    out = {r["node"]: r["component"] for r in neardup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(out[i] == 1 for i in range(1, 41)) and {out[i] for i in (90, 95, 100)} == {90} and all(out[300 + i] == 300 for i in range(50))
    assert neardup.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out.append(spark.createDataFrame(stage(spark, out[-1], "").collect(), docs.schema))
    return out, corpus_pipeline.STAGES[-1][1](spark, out[-1], "").collect()


def test_pipeline_stages(spark, stages):
    (docs, quality, dedup, redacted, mixed), packed = stages
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    assert ids(quality) < ids(docs)
    texts = {r["doc_id"]: r["text"] for r in quality.collect()}
    groups = brute(sorted(texts.items()))
    assert ids(dedup) == {i for i, (_, c) in groups.items() if i == c}
    clean = {r["doc_id"]: r for r in redacted.collect()}
    assert set(clean) == ids(dedup)
    for i, r in clean.items():
        assert not secrets.base_spans(r["text"]) and r["n_chars"] == len(r["text"])
        assert r["text"] == texts[i] or secrets.base_spans(texts[i]) or "[secret]" in r["text"]
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    taken = Counter()
    for r in mixed.collect():
        taken[r["doc_id"]] += words(r["text"])
        assert r["n_chars"] == len(r["text"])
    whole = sum(words(r["text"]) for r in clean.values())
    assert abs(sum(taken.values()) - 1.5 * whole) <= 20 and all(n <= 2 * words(clean[i]["text"]) for i, n in taken.items())
    assert {r["doc_id"] for r in packed} == set(taken)
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter(r["doc_id"] for r in mixed.collect())
    assert labels.count() and docs.columns == mixed.columns
    assert mixed.where(F.col("source").isNull()).count() == 0


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0


def test_groups_too_large_for_a_task_are_compared_whole(spark, monkeypatch):
    """Pairs of near copies among texts of one template, which is plausible with itself but no link."""
    monkeypatch.setattr(neardup, "GROUP", 4)
    rng = random.Random(11)
    fresh = lambda k: ["w%d" % rng.randrange(10**6) for _ in range(k)]
    passage, rows = fresh(60), []
    for i in range(0, 80, 2):
        words = passage + fresh(20)
        rows += [(i, " ".join(words)), (i + 1, " ".join(words[:-1] + fresh(1)) + (" more" * (i % 3)))]
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == brute(rows) and sorted(Counter(c for _, c in out.values()).values()) == [2] * 40


@pytest.mark.parametrize("equal", [16, 48])
def test_nodes_over_the_task_lose_no_pairs_at_the_last_exchange(spark, monkeypatch, equal):
    """200 pairs among 400 rows of the same root nodes; with 48 equal positions of 128 many branches don't part them."""
    monkeypatch.setattr(neardup, "FITS", 100)
    monkeypatch.setattr(neardup, "EXCHANGES", 0)
    rng = np.random.default_rng(3)
    tokens = np.tile(rng.integers(0, 2**32, (200, neardup.SIZE), dtype=np.uint32), (2, 1))
    fixed = np.arange(neardup.SIZE) % 8 < equal // 16
    tokens[:, fixed] = 7
    classes = spark.createDataFrame([(i, bytearray(t.tobytes())) for i, t in enumerate(tokens)], "rep long, tokens binary")
    # A run that ends within a batch is compared as it is; small batches make the runs stream.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 40)
    try:
        found = {(r["a"], r["b"]) for r in neardup._rounds(classes).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == {(i, i + 200) for i in range(200)}
