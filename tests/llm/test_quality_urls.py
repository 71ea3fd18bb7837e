from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseframe.llm import quality, urls

random.seed(3)
WORDS = ["al", "be", "cen", "dor", "eli", "fun", "gar", "hol", "ims", "jet"]


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c, covered, seen, dup = Counter(grams), set(), set(), 0
    for i, g in enumerate(grams):
        if c[g] > 1:
            covered |= {i, i + 1, i + 2}
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed)


def prose(n, rng=random):
    return " ".join("".join(rng.choice(WORDS) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_statistics_and_edges(spark):
    repeated = "same words here again\n" * 300
    texts = [None, "", " \n\t ", "a", "a b", "a b c a b c", "x\ny\nx\n\n \nx", repeated, prose(3000) + "\n" + repeated, "\u00a0\u2003é 😀 #*|<>&%$", prose(60), prose(60), "a " * 20000]
    rows = spark.createDataFrame([(i, t, None if i % 3 else "en", None, 9.0, True) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, d2 double, kept boolean")
    out = quality.judge(rows, carry=("doc_id", "text")).collect()
    assert len(out) == len(texts)
    for r in out:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute(r["text"])
        assert r["kept"] == (not r["base_failed"])  # groups this small reject nothing


def test_empty(spark):
    assert quality.judge(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0


def test_outliers_are_rejected_and_clean_kept(spark):
    rng = random.Random(5)
    clean = [(i, prose(rng.randint(60, 900), rng), "en", "a" if i % 3 else None) for i in range(360)]
    junk = [(1000 + i, " ".join(w + "###" for w in prose(200, rng).split()), "en", "a" if i % 3 else None) for i in range(60)]
    out = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string")).collect()}
    assert all(not out[1000 + i]["kept"] for i in range(60))
    assert all(out[i]["kept"] for i in range(360) if not out[i]["base_failed"])


def test_chi_square():
    assert math.isclose(quality._chi_cdf(11.0705, 5), 0.95, abs_tol=1e-5)
    assert math.isclose(quality._chi_quantile(0.975, 5), 12.8325, abs_tol=1e-3)


RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "org", "/es/"))


def test_urls(spark):
    cases = {
        "https://A.Example.COM/en/71?x": ("a.example.com", "/en/71", "example.com/en/7", "allow"),
        "http://b.com/en/": ("b.com", "/en/", "com/en/", "block"),
        "http://bcom/en/": ("bcom", "/en/", None, "allow"),
        "http://com/en/x": ("com", "/en/x", "com/en/", "block"),
        "http://bad.net/p/1.html?ref=z#q": ("bad.net", "/p/1.html", None, "block"),
        "https://www.bad.net/p/1/": ("www.bad.net", "/p/1/", None, "block"),
        "https://www.bad.net/p/1?a=1": ("www.bad.net", "/p/1", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "x://h?p://q/r": ("h", "", None, "allow"),
        "://h/a#b": ("h", "/a", None, "allow"),
        "http://İ.com/x": ("İ.com", "/x", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(cases)] + [(99, "http://bad.net/p/1", "old")] * 2, "page_id long, url string, host string")
    listed = spark.createDataFrame([("http://bad.net/p/1",), (None,), ("nothing",)], "url string")
    out = urls.judge(pages, listed, RULES).collect()
    assert len(out) == len(cases) + 2
    for r in out:
        if r["page_id"] != 99:
            assert (r["host"], r["path"], r["rule"], r["verdict"]) == cases[r["url"]], r
        else:
            assert r["verdict"] == "block"


def test_urls_without_list_or_rows(spark):
    none = spark.createDataFrame([], "url string")
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    assert [r["verdict"] for r in urls.judge(pages, none).collect()] == ["allow"]
    assert urls.judge(pages.limit(0), none, RULES).count() == 0


def test_filter_has_no_false_negative(spark):
    listed = spark.range(5000).select(F.concat(F.lit("http://h.x/"), "id").alias("url"))
    pages = spark.range(10000).select(F.col("id").alias("page_id"), F.concat(F.lit("https://www.h.x/"), "id").alias("url"))
    out = urls.judge(pages, listed)
    assert out.where("verdict = 'block'").count() == 5000 and out.where("(page_id < 5000) <> (verdict = 'block')").count() == 0


def test_small_groups_get_a_verdict(spark):
    """A small source is judged by its language, and a small language by the table."""
    rng = random.Random(8)
    rows = [(i, prose(rng.randint(60, 900), rng), "en", "big") for i in range(240)]
    rows += [(1000 + i, prose(rng.randint(60, 900), rng), *place) for i, place in enumerate([("en", "small"), ("rare", "x"), (None, None)] * 3)]
    rows += [(2000 + i, " ".join(w + "###" for w in prose(200, rng).split()), *place) for i, place in enumerate([("en", "small"), ("rare", "x"), (None, None)] * 2)]
    out = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert len(out) == len(rows) and all(r["base_failed"] or r["d2"] is not None for r in out.values())
    assert not any(r["kept"] for i, r in out.items() if i >= 2000)
    assert all(r["kept"] for i, r in out.items() if i < 2000 and not r["base_failed"])


def fast_mcd(x, share, factor, floors, rng, starts=60):
    """Smallest log determinant of regularized core covariances, from random starts concentrated until they stand still."""
    n, best = len(x), None
    h = math.ceil(share * n)
    for _ in range(starts):
        core = rng.choice(n, 6, replace=False)
        for _ in range(60):
            mean, cov = x[core].mean(axis=0), factor * np.cov(x[core].T, bias=True) + np.diag(np.square(floors))
            d2 = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            new = np.argsort(d2, kind="stable")[:h]
            if set(new) == set(core):
                break
            core = new
        logdet = np.linalg.slogdet(factor * np.cov(x[core].T, bias=True) + np.diag(np.square(floors)))[1]
        if best is None or logdet < best[0]:
            best = (logdet, x[core].mean(axis=0))
    return best


@pytest.mark.parametrize("seed,outliers", [(1, 0), (2, 40), (3, 50)])
def test_estimates_are_as_good_as_those_of_many_random_starts(spark, seed, outliers):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (240, quality.DIMS)) @ rng.normal(0, 1, (quality.DIMS, quality.DIMS)) + 5
    x[:outliers] = rng.normal(0, 0.3, (outliers, quality.DIMS)) + rng.normal(0, 12, quality.DIMS)
    rows = [("=en", "=a", *map(int, np.round(r * quality.UNIT))) for r in x]
    df = spark.createDataFrame(rows, "_lang string, _source string, " + ", ".join(f"x{i} long" for i in range(quality.DIMS)))
    got = quality.raw_estimates(df).collect()
    assert len(got) == 1
    want, mean = fast_mcd(np.round(x * quality.UNIT) / quality.UNIT, quality.CORE, quality._consistency(quality.CORE), quality.FLOORS, rng)
    # A core is of whole bins of distances, so it may hold some documents more.
    assert got[0]["logdet"] <= want + 0.35
    assert max(abs(got[0][f"m{i}"] - mean[i]) / x[outliers:, i].std() for i in range(quality.DIMS)) < 0.35


def test_factor_and_distance(spark):
    rng = np.random.default_rng(4)
    cov = np.cov(rng.normal(0, 1, (quality.DIMS, 40)) * np.arange(1, quality.DIMS + 1)[:, None]) + np.eye(quality.DIMS)
    mean, x = rng.normal(0, 3, quality.DIMS), rng.normal(0, 3, quality.DIMS)
    row = ["=en", "=a", *map(float, mean), *[float(cov[i, j]) for i, j in quality.PAIRS]]
    df = spark.createDataFrame([tuple(row)], ", ".join(["_lang string", "_source string", *[f"{c} double" for c in quality.MEANS + quality.COVARIANCES]]))
    out = quality._triangle(df)
    assert math.isclose(out.first()["logdet"], np.linalg.slogdet(cov)[1], abs_tol=1e-9)
    fixed = np.round(x * quality.UNIT).astype(int)
    d2 = quality._distance(out.withColumns({f"x{i}": F.lit(int(v)) for i, v in enumerate(fixed)})).first()["d2"]
    apart = fixed / quality.UNIT - mean
    assert math.isclose(d2, apart @ np.linalg.inv(cov) @ apart, rel_tol=1e-9)


def test_small_groups_lean_on_their_language(spark):
    """The verdict says which documents the own estimate was made from; a group of few leans on the others."""
    rng = random.Random(12)
    rows = [(i, prose(rng.randint(60, 900), rng), "en", "big") for i in range(150)] + [(1000 + i, prose(rng.randint(60, 900), rng), "en", f"s{i}") for i in range(8)]
    out = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(out[1000 + i]["estimate_rows"] == 1 and out[1000 + i]["d2"] < 30 for i in range(8))
    assert 100 <= out[0]["estimate_rows"] <= 150
