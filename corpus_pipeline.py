"""The corpus pipeline: quality rules, near-dedup, secret scans, mixing, packing.

Each stage works on what the one before it kept, and its decisions take effect.
All but the last return the columns of documents. The operators carry the
columns under names of their own, so that none clashes with what they make.
"""

from __future__ import annotations

import functools
import threading
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from caseframe.llm import mixing, neardup, packing, quality, secrets
from caseframe.sources import scratch

_waiting = threading.local()


def _stage(function: Callable, first: bool = False) -> Callable:
    """A later stage reads what the one before it returned as a table, so that one's scratch tables can go.

    They are kept for each thread, so that pipelines in one session are apart.
    """

    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not first:
            scratch.drop(spark, getattr(_waiting, "paths", []))
        with scratch.recorded() as _waiting.paths:
            return function(spark, docs, sf_dir)

    return run_stage


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and are no outliers of their language and source.

    A null or empty text fails the base rule and goes; a null language or
    source is a group of its own; repeated rows are judged alike; texts of any
    length are read whole; an empty table gives an empty result.
    """
    return quality.keep(docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of the smallest doc_id, nulls last.

    Of repeated rows, and of rows that share text and doc_id, one stays; rows
    that share a doc_id alone both stay; texts without words all stay; an empty
    table gives an empty result.
    """
    return neardup.one_of_each(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without its secrets; n_chars follows.

    Null texts stay null, other columns and repeated rows stay as they are; an
    empty table gives an empty result.
    """
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's documents: repeated by epoch, the last one of a source cut at its budget; n_chars follows.

    Null and empty texts have no words and are in no mix; a null source is the
    last source; a null doc_id is keyed by its text; repeated rows are
    documents of their own; an empty table gives an empty result.
    """
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mix's documents with their places in the sequences.

    A null or empty text is one piece of the closing id; a longer text than a
    sequence is cut; a null doc_id stays null; repeated rows are packed each;
    other columns are left behind; an empty table gives an empty result.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", _stage(keep_quality, first=True)),
    ("near_dedup", _stage(keep_one_of_each)),
    ("secrets", _stage(redact_secrets)),
    ("mixing", _stage(mix_sources)),
    ("packing", _stage(pack_sequences)),
]

#: Robust estimates, the similarity join and the tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
