"""Mixing sources to target weights.

Every document gets a hash-random key; within each source documents are
range-sorted by it, a distributed prefix sum of sizes is taken, and the source
is cut at its exact budget. A budget above the source's size repeats epochs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caseframe.llm.columns import shield
from caseframe.llm.prefix import bits_for, bucket_of, hash_key, offsets
from caseframe.sources import scratch

WORD = r"[^\x20\x09-\x0D]+"
MADE = ("size", "source_size", "target", "taken")


def word_count(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: int) -> DataFrame:
    """Water-filling: weighted shares of ``share`` times all sizes, each at most ``cap`` times its source's size.

    ``sizes`` has a row for each source (_known, _source, source_size). Sources
    in code-point order, null last, take the weights in turn. A share over its
    cap stops there and the excess is shared again by weight; the fixed point
    has one level: target = min(cap * size, weight * level).
    """
    every = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(F.desc("_known"), "_source"))
    table = (
        sizes.withColumn("_rank", rank)
        .withColumn("_weight", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("_rank") - 1) % len(weights) + 1).cast("int")).cast("long"))
        .withColumn("_cap", F.col("source_size") * cap)
    )
    order = Window.orderBy(F.col("_cap") / F.col("_weight"), "_rank").rowsBetween(Window.unboundedPreceding, -1)
    table = (
        table.withColumn("_caps", F.coalesce(F.sum("_cap").over(order), F.lit(0)))
        .withColumn("_weights", F.coalesce(F.sum("_weight").over(order), F.lit(0)))
        .withColumn("_all", F.sum("source_size").over(every))
        .withColumn("_every", F.sum("_weight").over(every))
        .withColumn("_level", (F.lit(share) * F.col("_all") - F.col("_caps")) / (F.col("_every") - F.col("_weights")))
        .withColumn("_full", F.col("_cap") / F.col("_weight") <= F.col("_level"))
    )
    first = F.min(F.when(~F.col("_full"), F.struct(F.col("_cap") / F.col("_weight"), F.col("_rank"), F.col("_level").alias("level")))).over(every)
    return table.withColumn("target", F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(F.col("_weight") * first["level"])).select(
        "_known", "_source", "source_size", "target"
    )


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    cap: int = 2,
    seed: str = "mix",
    size: Column | None = None,
    rows_per_bucket: int = 128,
    carry: tuple[str, ...] | None = None,
) -> DataFrame:
    """``docs`` with size, source_size, target and taken (units of the document that the mix takes).

    ``docs`` needs doc_id, text and source; the columns in ``carry``, or else
    all, stay. Without the text among them texts are read once. Reruns give the
    same rows. Texts of any length are counted whole. A null source is a source of its own and comes last; a null
    or empty text has size 0 and nothing is taken of it; a null doc_id is keyed
    by its text; repeated rows are rows of their own; an empty table gives an
    empty result. A source of size 0 has target 0. Own columns named size,
    source_size, target or taken are replaced.
    """
    size = word_count(F.col("text")) if size is None else size
    bits = bits_for(docs.count(), rows_per_bucket)
    key = hash_key(F.coalesce(F.col("doc_id").cast("string"), F.md5("text")), seed=seed)
    wanted = docs if carry is None else docs.select(*dict.fromkeys((*carry, "doc_id", "text", "source")))
    inside, original = shield(wanted, ("doc_id", "text", "source"), MADE)
    names = [c for c in wanted.columns if c.lower() not in MADE]
    back = [c for c, name in zip(original(), names, strict=True) if carry is None or name in carry]
    rows = inside.select(
        "*",
        size.alias("size"),
        F.col("source").isNotNull().alias("_known"),
        F.coalesce("source", F.lit("")).alias("_source"),
        key.alias("_key"),
        F.xxhash64("text").alias("_tie"),
    )
    rows = rows.withColumn("_bucket", bucket_of(F.col("_key"), bits))
    if carry is not None and "text" not in carry:
        rows = scratch.keep(rows.drop("text"), "sizes")
    by = ["_known", "_source"]
    stats = scratch.keep(rows.groupBy(*by, "_bucket").agg(F.sum("size").alias("_size")), "mix")
    sizes = stats.groupBy(*by).agg(F.sum("_size").alias("source_size"))
    goals = targets(sizes, weights, share, cap)
    starts = offsets(stats, by, "_bucket", "_size", "_start").drop("_size").join(goals, by)
    bucket = Window.partitionBy(*by, "_bucket").orderBy("_key", "doc_id", "_tie")
    rows = rows.join(starts, [*by, "_bucket"]).withColumn("_end", F.col("_start") + F.sum("size").over(bucket.rowsBetween(Window.unboundedPreceding, 0)))
    budget = F.round("target").cast("long")
    rest = budget % F.greatest("source_size", F.lit(1))
    taken = F.col("size") * F.floor(budget / F.greatest("source_size", F.lit(1))) + F.greatest(F.lit(0), F.least(F.col("size"), rest - (F.col("_end") - F.col("size"))))
    return rows.withColumn("taken", F.when(F.col("source_size") > 0, taken).otherwise(0).cast("long")).select(*back, *MADE)


def repeated(mixed: DataFrame, words_column: str = "text") -> DataFrame:
    """The mix as documents: a row for each epoch of a document, its last one cut to the words still taken.

    A document taken whole twice is there twice; one of which nothing is taken,
    as of a null or empty text, is gone. A cut text keeps its first words and
    the white space between them. Repeated rows are repeated each; other columns
    stay; an empty table gives an empty result.
    """
    whole = F.floor(F.col("taken") / F.greatest("size", F.lit(1))).cast("int")
    rest = (F.col("taken") - whole * F.col("size")).cast("int")
    parts = F.when(F.col("taken") > 0, F.concat(F.array_repeat(F.col("size").cast("int"), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>"))))
    rows = mixed.withColumn("mix:part", F.explode(parts))
    pieces = F.expr(rf"regexp_extract_all({words_column}, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+', 0)")
    cut = F.array_join(F.slice(pieces, 1, F.col("mix:part")), "")
    return rows.withColumn(words_column, F.when(F.col("mix:part") < F.col("size"), cut).otherwise(F.col(words_column))).drop("mix:part", *MADE)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix of ``docs`` as documents with the same columns: ``mix``, then ``repeated``.

    n_chars, where it is there, is the number of characters of the text in the
    mix. Columns of any name are carried; repeated rows are documents of their
    own; documents without words are in no mix.
    """
    inside, original = shield(docs, ("doc_id", "text", "source"), ())
    out = repeated(mix(inside, **options)).select(*original())
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"]))
    return out
