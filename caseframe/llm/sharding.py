"""Uniform shuffle into shards of exact sizes, with DataFrame and SQL functions only.

Rows are dealt to hash blocks. A communication matrix says how many rows of
each block go to each shard; it is drawn from the exact multivariate
hypergeometric law, with the block sizes as row sums and the shard sizes as
column sums. Each block is permuted locally, its rows go to the shards as the
matrix says, and each shard is permuted again, which numbers its slots.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caseframe.llm.columns import shield
from caseframe.llm.prefix import bits_for, bucket_of, hash_key, offsets
from caseframe.sources import scratch

TRIES = 64
MADE = ("law", "shard", "slot")
#: ln(n!) for n under 10; Stirling's series serves the rest to about 1e-11.
LOG_FACTORIALS = ", ".join(f"{math.lgamma(n + 1)!r}D" for n in range(10))


def _log_factorial(n: str) -> str:
    return (
        f"if({n} < 10, element_at(array({LOG_FACTORIALS}), cast(greatest({n}, 0) as int) + 1), "
        f"({n} + 0.5D) * ln({n}) - {n} + 0.9189385332046727D + 1D / (12D * {n}) - 1D / (360D * {n} * {n} * {n}) + 1D / (1260D * {n} * {n} * {n} * {n} * {n}))"
    )


def _uniform(*parts: str) -> str:
    """A number in (0, 1) that depends on the parts alone."""
    return f"((shiftrightunsigned(xxhash64({', '.join(parts)}), 11) + 0.5D) / 9007199254740992D)"


def _let(name: str, value: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def hypergeometric(good: str, bad: str, sample: str, *salt: str) -> str:
    """SQL for an exact draw: how many of ``good`` items are among ``sample`` of ``good + bad``.

    Up to ten draws are played out; beyond, Stadlober's ratio-of-uniforms
    rejection takes constant time. The chance that all tries are rejected is
    below 1e-20; the mode would stand in.
    """
    urn = (
        "aggregate(sequence(1, cast(q.m as int)), named_struct('left', q.good, 'hit', 0L), "
        f"(a, k) -> {_let('hit', f'if({_uniform(*salt, "k")} * (q.pop - k + 1) < a.left, 1L, 0L)', "named_struct('left', a.left - hit, 'hit', a.hit + hit)")}, a -> a.hit)"
    )
    terms = lambda z: f"aggregate(array({z}, q.small - {z}, q.m - {z}, q.large - q.m + {z}), 0D, (a, x) -> a + {_log_factorial('x')})"
    accept = (
        f"named_struct('x', {_uniform(*salt, 'k', '0')}, 'y', {_uniform(*salt, 'k', '1')})",
        _let(
            "w",
            "r.d6 + r.d8 * (u.y - 0.5D) / u.x",
            "if(w < 0 or w >= r.d11, cast(null as bigint), "
            + _let("z", "cast(floor(w) as bigint)", f"if(2 * ln(u.x) <= s - {terms('z')}, z, cast(null as bigint))")
            + ")",
        ),
    )
    spread = "sqrt((q.pop - q.m) * cast(q.m as double) * q.p * (1 - q.p) / (q.pop - 1) + 0.5D)"
    ratio = _let(
        "r",
        f"named_struct('d6', q.m * q.p + 0.5D, 'd8', 1.7155277699214135D * {spread} + 0.8989161620588988D, "
        "'mode', cast(floor((q.m + 1D) * (q.small + 1D) / (q.pop + 2D)) as bigint), "
        f"'d11', least(least(q.m, q.small) + 1D, floor(q.m * q.p + 0.5D + 16 * {spread})))",
        _let(
            "s",
            terms("r.mode"),
            f"coalesce(aggregate(sequence(1, {TRIES}), cast(null as bigint), (got, k) -> coalesce(got, {_let('u', *accept)})), r.mode)",
        ),
    )
    # The rejection counts items of the rarer kind among the smaller of the drawn and the undrawn part.
    turned = _let("t", ratio, "if(q.good > q.bad, q.m - t, t)")
    drawn = f"if(q.m <= 10, {urn}, {turned})"
    whole = _let("t", drawn, "if(q.m < q.sample, q.good - t, t)")
    return _let(
        "q",
        f"named_struct('good', {good}, 'bad', {bad}, 'sample', {sample}, 'pop', {good} + {bad}, 'm', least({sample}, {good} + {bad} - {sample}), "
        f"'small', least({good}, {bad}), 'large', greatest({good}, {bad}), 'p', least({good}, {bad}) / cast(greatest({good} + {bad}, 1) as double))",
        f"if(q.good = 0 or q.sample = 0, 0L, if(q.bad = 0, q.sample, if(q.m = 0, q.good, {whole})))",
    )


def split_counts(shards: str, children: str, seed: str) -> str:
    """SQL: array of one array of shard counts for each child, which add up to ``shards``.

    ``children`` is an array of structs (id, n). Children draw one after the
    other from what is left; each draws its shards one after the other.
    """
    draw = hypergeometric("element_at(acc.left, s)", "b.pool - element_at(acc.left, s)", "b.need", seed, "child.id", "s")
    inner = (
        f"aggregate(sequence(1, {{n}}), named_struct('need', child.n, 'pool', aggregate(acc.left, 0L, (a, x) -> a + x), 'got', cast(array() as array<bigint>)), "
        f"(b, s) -> {_let('h', draw, "named_struct('need', b.need - h, 'pool', b.pool - element_at(acc.left, s), 'got', concat(b.got, array(h)))")}, b -> b.got)"
    )
    step = _let("got", inner, "named_struct('left', zip_with(acc.left, got, (x, y) -> x - y), 'out', concat(acc.out, array(got)))")
    return f"aggregate({children}, named_struct('left', {shards}, 'out', cast(array() as array<array<bigint>>)), (acc, child) -> {step}, acc -> acc.out)"


def communication_matrix(blocks: DataFrame, rows: int, shards: int, seed: str, bits: int) -> DataFrame:
    """``blocks`` (_block, _n) with _counts: rows of the block for each shard.

    Two levels: blocks form about sqrt(blocks) super-blocks. One row draws the
    super-blocks' counts, then each super-block draws its blocks' counts in its
    own task, so no array holds more than about sqrt(blocks) entries.
    """
    low = (bits + 1) // 2
    sizes = F.array(*[F.lit(rows // shards + (s < rows % shards)).cast("long") for s in range(shards)])
    blocks = blocks.withColumn("_super", F.shiftright("_block", low))
    member = lambda key: F.array_sort(F.collect_list(F.struct(F.col(key).alias("id"), F.col("_n").alias("n"))))
    top = blocks.groupBy("_super").agg(F.sum("_n").alias("_n"))
    top = top.groupBy().agg(member("_super").alias("_children")).where(F.size("_children") > 0).withColumn("_shards", sizes)
    split = lambda df, salt: df.select(F.explode(F.arrays_zip("_children", F.expr(split_counts("_shards", "_children", f"'{seed}{salt}'").replace("{n}", str(shards))).alias("got"))).alias("_c"))
    top = split(top, "a").select(F.col("_c._children.id").alias("_super"), F.col("_c.got").alias("_shards"))
    groups = blocks.groupBy("_super").agg(member("_block").alias("_children")).join(top, "_super")
    return split(groups, "b").select(F.col("_c._children.id").alias("_block"), F.col("_c.got").alias("_counts"))


def shuffle_shards(rows: DataFrame, shards: int = 40, seed: str = "shards", key: str = "doc_id", rows_per_block: int = 256) -> DataFrame:
    """``rows`` with law (``rows``), shard and slot: a uniform random order cut into shards of sizes at most one apart.

    Every row is one row of the result; slots of a shard run from 0 without a
    gap. Reruns give the same shards. Rows are dealt by their key and a hash of
    the whole row, so many rows of one key, or with a null one, are spread;
    rows that are equal in all columns are rows of their own. Texts are hashed
    whole. An empty table gives an empty result. All columns are carried, so
    pass those that are needed; columns named law, shard or slot are replaced.
    """
    n = rows.count()
    bits = bits_for(n, rows_per_block)
    rows, original = shield(rows, (key,), MADE)
    # Equal keys, of which there may be many, are spread by a hash of the whole row.
    first, second, third = (hash_key(F.col(key), F.col("_row"), seed=f"{seed}{i}") for i in range(3))
    columns = [F.col(f"`{c}`") for c in rows.columns]
    rows = rows.withColumn("_row", F.xxhash64(*columns)).withColumn("_block", bucket_of(first, bits))
    blocks = scratch.keep(rows.groupBy("_block").agg(F.count("*").alias("_n")), "blocks")
    matrix = communication_matrix(blocks, n, shards, seed, bits)
    local = Window.partitionBy("_block").orderBy(second, "_row")
    dealt = (
        rows.join(matrix, "_block")
        .withColumn("_rank", F.row_number().over(local))
        .withColumn("_ends", F.expr("transform(_counts, (x, i) -> aggregate(slice(_counts, 1, i + 1), 0L, (a, y) -> a + y))"))
        .withColumn("shard", F.expr("size(filter(_ends, e -> e < _rank))"))
        .drop("_counts", "_ends", "_rank", "_block")
    )
    fine = max(0, bits - (shards - 1).bit_length() + 1)
    dealt = scratch.keep(dealt.withColumn("_again", third).withColumn("_part", bucket_of(F.col("_again"), fine)), "dealt")
    starts = offsets(dealt.groupBy("shard", "_part").agg(F.count("*").alias("_n")), ["shard"], "_part", "_n", "_start").drop("_n")
    inside = Window.partitionBy("shard", "_part").orderBy("_again", "_row")
    return (
        dealt.join(starts, ["shard", "_part"])
        .withColumn("slot", (F.col("_start") + F.row_number().over(inside) - 1).cast("long"))
        .withColumn("law", F.lit("rows"))
        .select(*original(), *MADE)
    )
