"""Quality rules: robust multivariate outliers of document statistics, per language and source.

DataFrame and SQL functions only. Every document gets a vector of transformed
statistics in fixed point, so that sums are exact and reruns agree. For each
language and source, for each language, and for the whole table the
minimum-covariance-determinant estimate is found from six deterministic starts
by concentration steps. An estimate leans on that of the level above, half of it
at PRIOR documents, so small groups need no rule of their own. Documents whose
Mahalanobis distance exceeds a chi-square cutoff are rejected.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caseframe.llm.columns import shield
from caseframe.sources import scratch

SPACE = r"[\x20\x09-\x0D]+"
#: Fixed point: a unit of a statistic. Statistics are under 20, so sums of products fit a long up to 2e10 documents; more raise an error.
UNIT = 1000
#: Standard deviations that are added to every estimate, by statistic (length, word length, symbols, repeated lines,
#: repeated words). They stand for what one word, line or symbol more changes in a text of some hundred words, since
#: statistics that are zero nearly everywhere have no spread of their own to be measured by.
FLOORS = (0.25, 0.08, 0.35, 0.25, 0.25)
DIMS = len(FLOORS)
#: Share of a group's documents that the estimate is made from.
CORE = 0.75
#: Concentration steps of all starts, and further ones of the BEST.
STEPS, FURTHER, BEST = 2, 2, 2
#: An estimate from so many documents counts as much as that of the level above; the ratio goes with the square of the
#: documents, since an estimate from fewer than some ten is worth next to nothing.
PRIOR = 100
MADE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2", "estimate_rows")
#: Distances are put in bins this many to a factor of e; a step keeps whole bins.
BINS = 24
#: Documents are rejected at a distance that a normal vector exceeds with this chance. The statistics' tails are much
#: heavier than normal ones; the cutoff (about 8.7 standard deviations) is meant for junk and leaves odd prose alone.
TAIL = 1e-14


def _chi_cdf(x: float, df: float) -> float:
    """Regularized lower incomplete gamma function by its series."""
    a, z = df / 2, x / 2
    if z <= 0:
        return 0.0
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= z / n
        total += term
    return min(1.0, total * math.exp(-z + a * math.log(z) - math.lgamma(a)))


def _chi_quantile(p: float, df: float) -> float:
    low, high = 0.0, 400.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi_cdf(mid, df) < p else (low, mid)
    return high


def _consistency(share: float) -> float:
    """Factor that makes the covariance of the ``share`` nearest normal vectors unbiased."""
    return share / _chi_cdf(_chi_quantile(share, DIMS), DIMS + 2)


def with_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of the whole text."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.withColumns(
        {
            "_w": F.filter(F.split(text, SPACE), lambda w: w != ""),
            "_lines": lines,
            "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
        }
    )
    grams = "if(size(_w) >= 3, transform(sequence(0, size(_w) - 3), i -> xxhash64(get(_w, i), get(_w, i + 1), get(_w, i + 2))), cast(array() as array<bigint>))"
    df = df.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.expr("aggregate(_w, 0L, (a, w) -> a + char_length(w))"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_g": F.expr(grams),
        }
    ).drop("_w", "_lines")
    df = df.withColumn("_s", F.sort_array("_g"))
    df = df.withColumn("_d", F.expr("if(size(array_distinct(_s)) = size(_s), cast(array() as array<bigint>), array_distinct(filter(_s, (x, i) -> i > 0 and x = get(_s, i - 1))))")).drop("_s")
    # Starts of repeated windows in order: few repeated windows are looked up, many are found by sorting.
    few = "filter(sequence(0, size(_g) - 1), i -> array_contains(_d, get(_g, i)))"
    pairs = "sort_array(transform(_g, (x, i) -> named_struct('x', x, 'i', i)))"
    many = f"element_at(transform(array({pairs}), p -> sort_array(transform(filter(p, (y, j) -> (j > 0 and get(p, j - 1).x = y.x) or (j < size(p) - 1 and get(p, j + 1).x = y.x)), y -> y.i))), 1)"
    starts = f"if(size(_d) = 0, cast(array() as array<int>), if(size(_d) <= 24, {few}, {many}))"
    covered = f"aggregate({starts}, named_struct('last', -3, 'n', 0L), (a, i) -> named_struct('last', i, 'n', a.n + least(3, i - a.last)), a -> a.n)"
    return df.withColumn("n_repeat_words", F.expr(covered)).drop("_g", "_d")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _vector() -> list[Column]:
    """The transformed statistics in fixed point: length, word length, and rates per word on a log scale."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    log = lambda c: F.log1p(c.cast("double"))
    values = [
        log(F.col("n_words")),
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words),
        log(100 * F.col("n_symbols") / words),
        log(100 * F.col("n_dup_lines") / words),
        log(20 * F.col("n_repeat_words") / words),
    ]
    return [F.round(v * UNIT).cast("long").alias(f"x{i}") for i, v in enumerate(values)]


PAIRS = [(i, j) for i in range(DIMS) for j in range(i + 1)]
COVARIANCES = [f"c{i}{j}" for i, j in PAIRS]
GROUP = ["_lang", "_source"]


#: A guess of a group: its mean, and the inverse of its covariance's Cholesky factor.
MEANS = [f"m{i}" for i in range(DIMS)]
FACTOR = [f"w{i}{j}" for i, j in PAIRS]


#: A guess of a group: its mean, and the inverse of its covariance's Cholesky factor.
MEANS = [f"m{i}" for i in range(DIMS)]
FACTOR = [f"w{i}{j}" for i, j in PAIRS]


def _triangle(df: DataFrame, *carry: str) -> DataFrame:
    """GROUP, ``carry``, the mean and the inverse w00, w10, ... of the Cholesky factor of c00, c10, ..., and its log determinant."""
    steps = []
    for i in range(DIMS):  # each entry by the ones before it
        for j in range(i):
            steps.append(f"(c{i}{j}" + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j)) + f") / l{j}{j} as l{i}{j}")
        steps.append(f"sqrt(greatest(c{i}{i}" + "".join(f" - l{i}{k} * l{i}{k}" for k in range(i)) + f", 1e-12)) as l{i}{i}")
        steps += [f"-(" + " + ".join(f"l{i}{k} * w{k}{j}" for k in range(j, i)) + f") / l{i}{i} as w{i}{j}" for j in range(i)]
        steps.append(f"1 / l{i}{i} as w{i}{i}")
    df = df.selectExpr(*GROUP, *carry, *MEANS, *steps, " + ".join(f"2 * ln(l{i}{i})" for i in range(DIMS)) + " as logdet")
    return df.select(*GROUP, *carry, *MEANS, *FACTOR, "logdet")


def _distance(df: DataFrame) -> DataFrame:
    """``df`` with the squared Mahalanobis distance ``d2``."""
    held = [f"`{c}`" for c in df.columns]
    apart = [f"x{i} / {UNIT}D - m{i} as _d{i}" for i in range(DIMS)]
    turned = [" + ".join(f"w{i}{k} * _d{k}" for k in range(i + 1)) + f" as _y{i}" for i in range(DIMS)]
    df = df.selectExpr(*held, *apart, *turned, " + ".join(f"_y{i} * _y{i}" for i in range(DIMS)) + " as d2")
    return df.select(*held, "d2")


def _sums() -> list[Column]:
    """Exact sums: count, first and second moments."""
    return [F.expr(e) for e in ("count(*) as n", *[f"sum(x{i}) as s{i}" for i in range(DIMS)], *[f"sum(x{i} * x{j}) as q{i}{j}" for i, j in PAIRS])]


def _again() -> list[Column]:
    return [F.expr(f"sum({c}) as {c}") for c in ("n", *[f"s{i}" for i in range(DIMS)], *[f"q{i}{j}" for i, j in PAIRS])]


def _moments(df: DataFrame, factor: float, *carry: str) -> DataFrame:
    """GROUP, n, ``carry``, mean m0.. and regularized covariance c00.. from exact sums."""
    floor = lambda i, j: f" + {FLOORS[i] ** 2!r}D" if i == j else ""
    mean = [f"double(s{i}) / n / {UNIT}D as m{i}" for i in range(DIMS)]
    return df.selectExpr(*GROUP, "n", *carry, *mean, *[f"{factor!r}D * (double(q{i}{j}) / n / {UNIT * UNIT}D - m{i} * m{j}){floor(i, j)} as c{i}{j}" for i, j in PAIRS])


def _bin(d2: Column) -> Column:
    return F.floor(F.log(d2 + 1e-3) * (BINS / 2)).cast("int")


#: Tables of estimates go to every task up to so many rows of 24 numbers (20 MB); beyond, the engine chooses the join.
SENT = 100_000


def _sendable(estimates: DataFrame) -> DataFrame:
    return F.broadcast(estimates) if estimates.count() <= SENT else estimates


def _levels(x: DataFrame) -> DataFrame:
    """Every row for its own group, its language ("*" as the source) and the table; names of the others begin with "=" or are empty."""
    level = lambda a, b: F.struct(a.alias("_lang"), b.alias("_source"))
    every = F.array(level(F.col("_lang"), F.col("_source")), level(F.col("_lang"), F.lit("*")), level(F.lit("*"), F.lit("*")))
    return x.select(F.explode(every).alias("_g"), *[f"x{i}" for i in range(DIMS)]).select("_g.*", *[f"x{i}" for i in range(DIMS)])


def _middle(x: DataFrame) -> DataFrame:
    """Median m0.. and scale r0.. (from the interquartile range, and a floor) of each group."""
    width = UNIT // 50
    long = x.select(*GROUP, F.posexplode(F.array(*[F.floor(F.col(f"x{i}") / width) for i in range(DIMS)])).alias("dim", "bin"))
    # Counts are dealt by all of their keys first, so that a large group is counted by many tasks.
    counts = long.groupBy(*GROUP, "dim", "bin").agg(F.count("*").alias("n")).repartition(*GROUP, "dim")
    up = Window.partitionBy(*GROUP, "dim").orderBy("bin")
    counts = counts.withColumn("upto", F.sum("n").over(up)).withColumn("all", F.sum("n").over(Window.partitionBy(*GROUP, "dim")))
    at = lambda p: F.min(F.when(F.col("upto") >= p * F.col("all"), F.col("bin"))) / F.lit(UNIT / width)
    quart = counts.groupBy(*GROUP, "dim").agg(at(0.25).alias("a"), at(0.5).alias("b"), at(0.75).alias("c"))
    pick = lambda i, c: F.max(F.when(F.col("dim") == i, c))
    return quart.groupBy(*GROUP).agg(
        *[pick(i, F.col("b") + 0.5 * width / UNIT).alias(f"m{i}") for i in range(DIMS)],
        *[pick(i, F.sqrt(F.pow((F.col("c") - F.col("a")) / 1.349, 2) + FLOORS[i] ** 2)).alias(f"r{i}") for i in range(DIMS)],
    )


#: Starts: 0 scales alone; 1 hyperbolic tangents, 2 signs and 3 clipped values of the scaled statistics; 4 the half nearest to the median; 5 the plain covariance.
SCALES, TANH, SIGN, CLIP, NEAR, PLAIN = range(6)


def _starts(x: DataFrame, middle: DataFrame) -> DataFrame:
    """Six guesses for each group: GROUP, start, m0.., w00.., logdet."""
    floor = lambda i, j: f" + {FLOORS[i] ** 2!r}D" if i == j else ""
    flat = middle.select("*", *[F.expr(f"r{i} * r{i}" if i == j else "0D").alias(f"c{i}{j}") for i, j in PAIRS])
    scales = _triangle(flat.withColumn("start", F.lit(SCALES)), "start")
    scaled = x.join(middle, GROUP, "left").select(*GROUP, *[F.expr(f"(x{i} / {UNIT}D - m{i}) / r{i}").alias(f"z{i}") for i in range(DIMS)])
    scaled = scaled.withColumn("_z", F.expr("sqrt(" + " + ".join(f"z{i} * z{i}" for i in range(DIMS)) + ") + 1e-9D"))
    bend = {TANH: "tanh(z{i})", SIGN: "z{i} / _z", CLIP: "greatest(-1.5D, least(1.5D, z{i}))"}
    rows = [f"struct({start} as start, " + ", ".join(f"cast(round({f.format(i=i)} * {UNIT}) as bigint) as x{i}" for i in range(DIMS)) + ")" for start, f in bend.items()]
    bent = scaled.select(*GROUP, F.expr(f"inline(array({', '.join(rows)}))")).groupBy(*GROUP, "start").agg(*_sums())
    # Correlations of the bent values about the median, on the robust scales.
    share = lambda i, j: f"double(q{i}{j}) / sqrt(greatest(double(q{i}{i}), 1D) * greatest(double(q{j}{j}), 1D)) * r{i} * r{j}"
    bent = bent.join(middle, GROUP).select(*GROUP, "start", *MEANS, *[F.expr(share(i, j) + floor(i, j)).alias(f"c{i}{j}") for i, j in PAIRS])
    near = _concentrate(x, scales, 0.5).withColumn("start", F.lit(NEAR))
    plain = _triangle(_moments(x.groupBy(*GROUP).agg(*_sums()), 1.0).withColumn("start", F.lit(PLAIN)), "start")
    return scales.unionByName(_triangle(bent, "start")).unionByName(near).unionByName(plain)


def _concentrate(x: DataFrame, guess: DataFrame, share: float = CORE) -> DataFrame:
    """One concentration step: the moments of the ``share`` of each group that is nearest to the guess."""
    # An outer join, whose broadcast side can only be the guesses: every group has one.
    near = _distance(x.join(guess, GROUP, "left")).withColumn("bin", _bin(F.col("d2")))
    # Bins are dealt by all of their keys first, so that a large group is summed by many tasks.
    bins = near.groupBy(*GROUP, "start", "bin").agg(*_sums()).repartition(*GROUP, "start")
    up = Window.partitionBy(*GROUP, "start").orderBy("bin")
    before = F.coalesce(F.sum("n").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    every = F.sum("n").over(Window.partitionBy(*GROUP, "start"))
    bins = bins.withColumn("_in", before < share * every).where("_in")
    return _triangle(_moments(bins.groupBy(*GROUP, "start").agg(*_again()), _consistency(share), "start"), "start")


def _best(guess: DataFrame, n: int) -> DataFrame:
    """The ``n`` guesses of each group with the smallest determinants."""
    order = Window.partitionBy(*GROUP).orderBy("logdet", "start")
    return guess.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= n).drop("_rank")


def raw_estimates(x: DataFrame) -> DataFrame:
    """For each group (_lang, _source) of ``x`` the minimum-covariance-determinant estimate: m0.., w00.., logdet."""
    guess = scratch.keep(_starts(x, _sendable(scratch.keep(_middle(x), "middle"))), "starts")
    for _ in range(STEPS):
        guess = scratch.keep(_concentrate(x, _sendable(guess)), "step")
    guess = scratch.keep(_best(guess, BEST), "best")
    for _ in range(FURTHER):
        guess = scratch.keep(_concentrate(x, _sendable(guess)), "step")
    return _sendable(scratch.keep(_best(guess, 1).drop("start"), "chosen"))


def _lean(own: DataFrame, above: DataFrame, keys: list[str]) -> DataFrame:
    """``own`` estimates (GROUP, n, m0.., c00..) leaning on those ``above``, which they share ``keys`` with."""
    both = own.join(above.select(*keys, *[F.col(c).alias(f"_{c}") for c in (*MEANS, *COVARIANCES)]), keys) if keys else own.crossJoin(above.select(*[F.col(c).alias(f"_{c}") for c in (*MEANS, *COVARIANCES)]))
    return both.select(*GROUP, "n", *[F.expr(f"(n * n * {c} + {PRIOR**2}D * _{c}) / (n * n + {PRIOR**2}D)").alias(c) for c in (*MEANS, *COVARIANCES)])


def estimates(x: DataFrame) -> DataFrame:
    """For each group (_lang, _source) of ``x`` (and x0..): m0.., w00.. and estimate_rows, the documents of its own estimate.

    Raw estimates are reweighted: made anew from the documents within the 97.5 %
    quantile. A group leans on its language, a language on the table (one row).
    """
    x = _levels(x)
    share = 0.975
    inside = _distance(x.join(raw_estimates(x), GROUP, "left")).where(F.col("d2") <= _chi_quantile(share, DIMS))
    robust = scratch.keep(_moments(inside.groupBy(*GROUP).agg(*_sums()), _consistency(share)), "robust")
    language = _lean(robust.where("_source = '*' and _lang <> '*'"), robust.where("_lang = '*'"), [])
    group = _lean(robust.where("_source <> '*'"), language, ["_lang"])
    return scratch.keep(_triangle(group, "n").withColumnRenamed("n", "estimate_rows").drop("logdet"), "leaning")


def _judged(inside: DataFrame, held: list[str], tail: float) -> DataFrame:
    """The columns ``held`` of ``inside`` (text, lang, source and others that clash with nothing), with MADE."""
    base = with_statistics(inside).withColumn("base_failed", base_failed())
    named = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit(""))
    rows = scratch.keep(base.select(*[F.col(f"`{c}`") for c in held], *MADE[:6], *_vector(), named(F.col("lang")).alias("_lang"), named(F.col("source")).alias("_own")), "statistics")
    x = rows.where("not base_failed").select("_lang", F.col("_own").alias("_source"), *[f"x{i}" for i in range(DIMS)])
    found = estimates(x).withColumnRenamed("_source", "_own")
    out = _distance(rows.join(_sendable(found), ["_lang", "_own"], "left"))
    within = F.col("d2") <= _chi_quantile(1 - tail, DIMS)
    return out.select(*[F.col(f"`{c}`") for c in held], *MADE[:6], (~F.col("base_failed") & within).alias("kept"), "d2", "estimate_rows")


def judge(docs: DataFrame, tail: float = TAIL, carry: tuple[str, ...] | None = None) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, d2 and estimate_rows.

    ``docs`` needs text, lang and source; the columns in ``carry``, or else
    all, are in the result. Documents that fail the base rule are rejected and
    left out of the estimates; d2 is the squared distance of the others from
    their group, and estimate_rows the documents that the group's own estimate
    was made from. A null text has no words and fails; null languages and
    sources form groups of their own; a small group leans on its language, and
    a small language on the table, so every document that passes the base rule
    is judged. Documents at one distance are all within a core or all without.
    Texts of any length are read whole. Repeated rows count each; an empty table
    gives an empty result. Own columns of these names are replaced.
    """
    wanted = docs if carry is None else docs.select(*dict.fromkeys((*carry, "text", "lang", "source")))
    inside, original = shield(wanted, ("text", "lang", "source"), MADE)
    # Texts move on only where they are asked for.
    held = [c for c in inside.columns if c != "text" or carry is None or "text" in carry]
    names = [c for c in wanted.columns if c.lower() not in MADE]
    back = [c for c, name in zip(original(), names, strict=True) if carry is None or name in carry]
    return _judged(inside, held, tail).select(*back, *MADE)


def keep(docs: DataFrame, tail: float = TAIL) -> DataFrame:
    """The rows of ``docs``, as they are, that ``judge`` keeps. Columns of any name are carried."""
    inside, original = shield(docs, ("text", "lang", "source"), ())
    return _judged(inside, inside.columns, tail).where("kept").select(*original())
