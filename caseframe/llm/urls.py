"""URL filter: host/path rules, then a blocked Bloom filter backed by an exact join.

DataFrame and SQL functions only.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseframe.llm.columns import shield

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A block is a cache line: eight 64-bit words, one bit in each for every key.
WORDS = 8
MADE = ("host", "path", "rule", "verdict")
#: At most so many blocks: the filter that goes to every task is 8 MB at most, whatever the list's length.
MAX_BLOCKS = 1 << 17
#: Query parameters that don't tell pages apart.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "fbclid", "gclid")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or end, A-Z in lower case; empty without ``://``."""
    host = F.regexp_extract(url, r"^(?s)(?:(?!://).)*://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"^(?s)(?:(?!://).)*://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """host without ``www.`` + path without its last slash or ``.html`` + sorted non-tracking parameters; null without a host."""
    host = F.regexp_replace(host_of(url), r"^www\.", "")
    path = F.regexp_replace(path_of(url), r"(/|\.html)$", "")
    query = F.regexp_extract(url, r"^(?s)[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(*TRACKING)))
    return F.when(host != "", F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule (verdict, host, path) that fits, as a struct (rule, verdict); null if none does.

    A rule fits its host and all subdomains where the path starts with its own.
    """
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, at, start in reversed(ordered):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(at + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _masks() -> list[Column]:
    """For each word of a block the bit that the key with hash ``_bits`` sets."""
    return [F.expr(f"shiftleft(1L, cast(shiftright(_bits, {6 * i}) & 63 as int))") for i in range(WORDS)]


def bloom_filter(keys: DataFrame, column: str, blocks: int) -> DataFrame:
    """One row, one array of ``blocks * WORDS`` longs: a blocked Bloom filter of ``keys[column]``.

    Masks are or-ed per block, first within each task. The array's length is
    fixed by ``blocks``, so its size is bounded; more keys only cost precision.
    """
    masks = _masks()
    rows = keys.select(F.pmod(F.xxhash64(column), F.lit(blocks)).alias("_block"), F.xxhash64(column, F.lit(1)).alias("_bits"))
    rows = rows.select("_block", *[m.alias(f"w{i}") for i, m in enumerate(masks)]).groupBy("_block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])
    # An array in block order: used blocks are sorted and empty ones fall between them.
    packed = rows.agg(F.array_sort(F.collect_list(F.struct("_block", F.array(*[f"w{i}" for i in range(WORDS)]).alias("w")))).alias("used"))
    empty = F.array_repeat(F.lit(0).cast("long"), WORDS)
    # Gaps are written as runs of zeros, so building takes one pass.
    runs = F.transform(
        F.col("used"),
        lambda x, i: F.concat(
            F.flatten(F.array_repeat(empty, (x["_block"] - F.when(i > 0, F.try_element_at("used", F.greatest(i, F.lit(1)))["_block"]).otherwise(-1) - 1).cast("int"))),
            x["w"],
        ),
    )
    last = F.coalesce(F.try_element_at("used", F.lit(-1))["_block"], F.lit(-1))
    tail = F.flatten(F.array_repeat(empty, (F.lit(blocks) - 1 - last).cast("int")))
    return packed.select(F.concat(F.flatten(runs), tail).alias("filter"))


def judge(
    pages: DataFrame,
    listed: DataFrame,
    rules: Sequence[tuple[str, str, str]] = (),
    bits_per_key: int = 16,
) -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    The longest fitting rule decides. Without one, a page is blocked if its
    canonical URL is that of a row of ``listed`` (url). The filter of the
    listed URLs sorts out the pages that can't be listed; the others meet the
    list in an exact join, which removes false positives, so the verdicts are
    exact. Null, empty and hostless URLs have empty host and path and are
    allowed unless a rule fits; repeated pages are judged alike; an empty list
    blocks nothing. Own columns of these names are replaced.
    """
    keys = listed.select(canonical(F.col("url")).alias("_canonical")).where(F.col("_canonical").isNotNull()).distinct()
    wanted = max(1, keys.count() * bits_per_key // (64 * WORDS))
    blocks = min(MAX_BLOCKS, 1 << (wanted - 1).bit_length())
    masks = _masks()
    rows, original = shield(pages, ("url",), MADE)
    rows = rows.select("*", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), canonical(F.col("url")).alias("_canonical"))
    rows = rows.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("_bits", F.xxhash64("_canonical", F.lit(1)))
    rows = rows.withColumn("_at", (F.pmod(F.xxhash64("_canonical"), F.lit(blocks)) * WORDS).cast("int"))
    words = bloom_filter(keys, "_canonical", blocks).scalar()
    hits = [F.element_at(words, F.col("_at") + i + 1).bitwiseAND(m) == m for i, m in enumerate(masks)]
    possible = F.coalesce(F.col("_rule").isNull() & F.col("_canonical").isNotNull() & reduce(lambda a, b: a & b, hits), F.lit(False))
    decided = lambda df, other: df.select(*original(), "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", other).alias("verdict"))
    sure = decided(rows.where(~possible), F.lit("allow"))
    checked = rows.where(possible).join(keys.withColumn("_listed", F.lit("block")), "_canonical", "left")
    checked = decided(checked, F.coalesce("_listed", F.lit("allow")))
    return sure.unionByName(checked)
