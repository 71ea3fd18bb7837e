"""Distributed prefix sums over hash-bucketed rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Hash keys have so many bits, so that they stay positive and exact in any engine.
KEY_BITS = 60


def hash_key(*parts: Column, seed: str) -> Column:
    """A uniform 60-bit key of the parts, the same in any SQL engine that has md5."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("long")


def bits_for(rows: int, per_bucket: int) -> int:
    """Bits of the bucket number that leave about ``per_bucket`` rows in each bucket."""
    return min(KEY_BITS, max(0, (max(rows, 1) // max(per_bucket, 1)).bit_length()))


def bucket_of(key: Column, bits: int) -> Column:
    """The bucket of a hash key: its first ``bits`` bits, so buckets are ranges of the key."""
    return F.shiftright(key, KEY_BITS - bits).cast("long")


def offsets(stats: DataFrame, group: list[str], bucket: str, value: str, out: str, fan: int = 10) -> DataFrame:
    """For each (group, bucket): the sum of ``value`` over the group's earlier buckets.

    Two levels keep every window small: 2**fan buckets form a coarse bucket,
    coarse sums are prefix-summed for the whole group, fine ones within their
    coarse bucket. One group may hold all rows.
    """
    stats = stats.withColumn("_coarse", F.shiftright(F.col(bucket), fan))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    fine = Window.partitionBy(*group, "_coarse").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    coarse = (
        stats.groupBy(*group, "_coarse")
        .agg(F.sum(value).alias("_sum"))
        .withColumn("_base", F.coalesce(F.sum("_sum").over(before.partitionBy(*group).orderBy("_coarse")), F.lit(0)))
        .drop("_sum")
    )
    inner = stats.withColumn("_inner", F.coalesce(F.sum(value).over(fine), F.lit(0)))
    return inner.join(coarse, [*group, "_coarse"]).withColumn(out, (F.col("_base") + F.col("_inner")).cast("long")).drop("_base", "_inner", "_coarse")


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
