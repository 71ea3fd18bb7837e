"""Queries over the synthetic tables, one for each operator of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from caseframe.llm import chat, fingerprints, html, mixing, neardup, packing, quality, secrets, sharding, urls

WORD_BPE = "word_bpe_49k.json"
#: The rules of query op4: verdict, host, path.
URL_RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: The listed URLs of query op4: every page numbered under 1,000 of these hosts in each language.
LISTED_HOSTS = ("cheap-pills", "spam-farm", "free-bets", "adult-x")
LISTED_ENDS = ("com", "net", "org")
LISTED_LANGUAGES = ("en", "de", "fr", "es")
LISTED_PAGES = 1000


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs, carry=("doc_id",)).select("doc_id", "size", "source_size", "target", "taken")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    utf8 = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    rows = _read(spark, sf_dir, "documents").select("doc_id", (F.octet_length(utf8) + 16).cast("long").alias("size"), F.crc32(utf8).alias("text_crc32"))
    dealt = sharding.shuffle_shards(rows)
    return dealt.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), carry=("doc_id",))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def listed_urls(spark: SparkSession) -> DataFrame:
    literals = lambda values: F.explode(F.array(*[F.lit(v) for v in values]))
    rows = spark.range(LISTED_PAGES).withColumn("host", literals(LISTED_HOSTS)).withColumn("end", literals(LISTED_ENDS)).withColumn("lang", literals(LISTED_LANGUAGES))
    return rows.select(F.format_string("https://www.%s.example.%s/%s/%d", "host", "end", "lang", "id").alias("url"))


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, listed_urls(spark), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.versions(_read(spark, sf_dir, "documents"))
    counts = [F.size(c).cast("long").alias(f"n_{c}") for c in ("only_text", "only_edited")]
    return found.select("*", *counts).drop("only_text", "only_edited")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_read(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.windows(rows.unionByName(more)))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_read(spark, sf_dir, "pages"))


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": op1_mixing,
        "op2_sharding": op2_sharding,
        "op3_quality": op3_quality,
        "op4_urls": op4_urls,
        "op5_fingerprints": op5_fingerprints,
        "op6_secrets": op6_secrets,
        "op7_packing": op7_packing,
        "op8_chat": op8_chat,
        "op9_neardup": op9_neardup,
        "op10_html": op10_html,
        "pipeline": corpus_pipeline.run,
    }


OP1_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(length(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, md5(text), '')), 1, 15))::BIGINT AS k
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank, 2 * source_size AS cap,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT] AS weight FROM sizes),
levels AS (
  SELECT *, cap / weight AS ratio,
    (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER w, 0)::DOUBLE)
      / ((sum(weight) OVER ())::DOUBLE - coalesce(sum(weight) OVER w, 0)::DOUBLE) AS level
  FROM ranked WINDOW w AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goals AS (
  SELECT *, CASE WHEN ratio <= level THEN cap::DOUBLE
    ELSE weight * (SELECT arg_min(level, (ratio, rank)) FROM levels WHERE ratio > level) END AS target FROM levels),
placed AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, round(g.target)::BIGINT AS budget,
    (coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start
  FROM docs d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
  (CASE WHEN source_size > 0 THEN size * (budget // source_size)
    + greatest(0, least(size, budget % source_size - start)) ELSE 0 END)::BIGINT AS taken
FROM placed
"""

OP4_SQL = r"""
WITH parts AS (
  SELECT page_id, url, position('://' IN url) > 0 AS ok, substr(url, position('://' IN url) + 3) AS rest FROM pages),
split AS (
  SELECT page_id, url,
    CASE WHEN ok THEN translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN ok THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path,
    regexp_extract(coalesce(url, ''), '^[^?#]*\?([^#]*)', 1) AS query
  FROM parts),
kept AS (
  SELECT *, list_sort(list_filter(string_split(query, '&'), lambda p: p <> '' AND NOT list_contains(
    ['utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'ref', 'fbclid', 'gclid'], split_part(p, '=', 1)))) AS params
  FROM split),
keyed AS (
  SELECT *, regexp_replace(host, '^www\.', '') || regexp_replace(path, '(/|\.html)$', '')
    || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS canonical
  FROM kept),
listed AS (
  SELECT h || '.example.' || e || '/' || l || '/' || n AS canonical
  FROM unnest(['cheap-pills', 'spam-farm', 'free-bets', 'adult-x']) a(h), unnest(['com', 'net', 'org']) b(e),
    unnest(['en', 'de', 'fr', 'es']) c(l), range(1000) d(n)),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/en/7') THEN 'example.com/en/7'
    WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND prefix(path, '/de/8') THEN 'example.net/de/8'
    WHEN (host = 'com' OR suffix(host, '.com')) AND prefix(path, '/en/') THEN 'com/en/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/de/') THEN 'net/de/'
    WHEN (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/es/') THEN 'org/es/' END AS rule
  FROM keyed)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.com/en/7', 'net/de/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN host <> '' AND canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""

OP9_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingled AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
rows AS (SELECT doc_id, len(s)::BIGINT AS n, unnest(s) AS h FROM shingled),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM rows a JOIN rows b ON a.h = b.h AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
lowest AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM shingled JOIN lowest ON a = doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mixing": OP1_SQL,
        "op4_urls": OP4_SQL,
        "op9_neardup": OP9_SQL,
    }
