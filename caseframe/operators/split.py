"""Stratified splits without leakage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caseframe.functions.arrays import elements
from caseframe.schema import SEED

TRAIN, VALIDATION = 0.8, 0.1


def shuffle_key(id_column: str, seed: int = SEED) -> Column:
    """A reproducible shuffle order, the same in any engine with md5."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_column).cast("string")))


def stratified(df: DataFrame, stratum: str, id_column: str, seed: int = SEED) -> DataFrame:
    """``df`` with ``split``: in each stratum, in shuffled order, the first 80 % (half-even) train, 10 % validate, the rest test.

    Ranks are taken within buckets of the shuffle order (its first 16 bits) and
    added to the sizes of the buckets before, so a stratum may hold all rows.
    """
    keyed = df.withColumn("_key", shuffle_key(id_column, seed)).withColumn("_bucket", F.substring("_key", 1, 4))
    sizes = keyed.groupBy(stratum, "_bucket").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(stratum).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumns({"_before": F.coalesce(F.sum("_size").over(before), F.lit(0)), "_n": F.sum("_size").over(Window.partitionBy(stratum))})
    sizes = sizes.select(F.col(stratum).alias("_stratum"), F.col("_bucket").alias("_of"), "_before", "_n")
    placed = keyed.join(sizes, F.col(stratum).eqNullSafe(F.col("_stratum")) & (F.col("_bucket") == F.col("_of")))
    rank = F.row_number().over(Window.partitionBy(stratum, "_bucket").orderBy("_key", id_column)) + F.col("_before")
    train, validation = F.bround(F.col("_n") * F.lit(TRAIN)), F.bround(F.col("_n") * F.lit(VALIDATION))
    split = F.when(F.col("_rank") <= train, F.lit("train")).when(F.col("_rank") <= train + validation, F.lit("validation")).otherwise(F.lit("test"))
    return placed.withColumn("_rank", rank).withColumn("split", split).drop("_key", "_bucket", "_stratum", "_of", "_before", "_n", "_rank")


def leakage(df: DataFrame, id_column: str) -> DataFrame:
    """Ids in more than one split, with their splits."""
    return df.groupBy(id_column).agg(F.array_sort(F.collect_set("split")).alias("splits")).where(F.size("splits") > 1)


def completeness(parts: DataFrame, original: DataFrame, id_column: str) -> DataFrame:
    """Ids that the parts lack or have beyond the original, with the side."""
    left, right = original.select(id_column), parts.select(id_column)
    return left.exceptAll(right).withColumn("side", F.lit("missing")).unionByName(right.exceptAll(left).withColumn("side", F.lit("extra")))


def repeated_within(df: DataFrame, id_column: str) -> DataFrame:
    """Rows and distinct ids of each split."""
    return df.groupBy("split").agg(F.count("*").alias("total"), F.count_distinct(id_column).alias("ids"))


def distribution(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("total"))


def exploded_distribution(df: DataFrame, array: str, name: str) -> DataFrame:
    return elements(df, array, name).groupBy(name).agg(F.count("*").alias("total"))
