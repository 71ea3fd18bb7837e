"""Synthetic cases: every value is a function of the case's number and a seed, so any partition makes the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseframe.functions.normalize import derived_missing_struct
from caseframe.functions.text import arabic_digits
from caseframe.schema import ALLERGENS, DURATION, GROUPS, INFO, LANGUAGES, MEDICATIONS, PATTERN_WEIGHTS, PATTERNS, SAMPLE_SOURCE, SCHEMA_VERSION, SEED, STATUSES, SYMPTOM, TARGET_FIELDS, UNITS

LONGEST = {"hours": 12, "days": 7, "weeks": 3}


class Draw:
    """Independent uniform draws for a row, told apart by name."""

    def __init__(self, row: Column, seed: int = SEED) -> None:
        self.row, self.seed = row, seed

    def number(self, name: str, *more: Column) -> Column:
        return F.xxhash64(F.lit(self.seed), F.lit(name), self.row, *more)

    def below(self, name: str, n: Column | int, *more: Column) -> Column:
        return F.pmod(self.number(name, *more), F.lit(n) if isinstance(n, int) else n).cast("int")

    def uniform(self, name: str, *more: Column) -> Column:
        return F.shiftrightunsigned(self.number(name, *more), 11) / F.lit(float(1 << 53))

    def pick(self, name: str, options: Column) -> Column:
        return F.get(options, self.below(name, F.size(options)))

    def order(self, name: str, options: Column) -> Column:
        """The options in random order."""
        keyed = F.transform(options, lambda x: F.struct(self.number(name, x).alias("k"), x.alias("x")))
        return F.transform(F.array_sort(keyed), lambda y: y["x"])


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.expr("cast(array() as array<string>)")


def pattern_counts(n: int) -> dict[str, int]:
    """Cases of each pattern: rounded shares (half to even), the last pattern takes what remains."""
    counts = {p: round(n * w) for p, w in zip(PATTERNS[:-1], PATTERN_WEIGHTS[:-1], strict=True)}
    return counts | {PATTERNS[-1]: n - sum(counts.values())}


def pattern_of(position: Column, n: int) -> Column:
    """The pattern of a 0-based position in the schedule."""
    out, upto = F.lit(PATTERNS[-1]), n
    counts = pattern_counts(n)
    for p in reversed(PATTERNS[:-1]):
        upto -= counts[PATTERNS[PATTERNS.index(p) + 1]]
        out = F.when(position < upto, F.lit(p)).otherwise(out)
    return out


def random_duration(draw: Draw, name: str, *more: Column) -> Column:
    """hours 1-12, days 1-7 or weeks 1-3."""
    unit = F.get(strings(UNITS), draw.below(name + ":unit", len(UNITS), *more))
    longest = F.when(unit == "hours", LONGEST["hours"]).when(unit == "days", LONGEST["days"]).otherwise(LONGEST["weeks"])
    return F.struct((draw.below(name + ":value", longest, *more) + 1).alias("value"), unit.alias("unit")).cast(DURATION)


def optional_duration(draw: Draw, name: str, chance: float, *more: Column) -> Column:
    return F.when(draw.uniform(name + ":has", *more) < chance, random_duration(draw, name, *more))


def deterministic_duration(id_column: Column) -> Column:
    """From the id's SHA-256: the first byte picks the unit, the second the value."""
    digest = F.sha2(id_column.cast("string"), 256)
    byte = lambda at: F.conv(F.substring(digest, at, 2), 16, 10).cast("int")
    unit = F.get(strings(UNITS), byte(1) % 3)
    longest = F.when(unit == "hours", LONGEST["hours"]).when(unit == "days", LONGEST["days"]).otherwise(LONGEST["weeks"])
    return F.struct((byte(3) % longest + 1).alias("value"), unit.alias("unit")).cast(DURATION)


def symptom(name: Column, status: Column, duration: Column) -> Column:
    """A symptom that isn't present has no duration."""
    return F.struct(name.alias("name"), status.alias("status"), F.when(status == "present", duration).alias("duration")).cast(SYMPTOM)


def candidate_pool(complaints: Column, related: Column, chief: Column) -> Column:
    """Other complaints of the group, then its related symptoms, each once."""
    return F.array_distinct(F.filter(F.concat(complaints, related), lambda x: x != chief))


def medications(draw: Draw, force_unknown: Column) -> Column:
    u = draw.uniform("med")
    status = F.when(force_unknown, F.lit("unknown")).when(u < 0.35, F.lit("unknown")).when(u < 0.65, F.lit("none")).otherwise(F.lit("reported"))
    item = draw.pick("med:item", strings(MEDICATIONS))
    return F.struct(status.alias("status"), F.when(status == "reported", F.array(item)).otherwise(strings(())).alias("items")).cast(INFO)


def allergies(draw: Draw, force_unknown: Column, taken: Column) -> Column:
    """Never a medication that the case reports; without an allergen left, none."""
    u = draw.uniform("alg")
    left = F.array_except(strings(ALLERGENS), taken)
    status = F.when(force_unknown, F.lit("unknown")).when(u < 0.35, F.lit("unknown")).when(u < 0.70, F.lit("none")).when(F.size(left) == 0, F.lit("none")).otherwise(F.lit("reported"))
    return F.struct(status.alias("status"), F.when(status == "reported", F.array(draw.pick("alg:item", left))).otherwise(strings(())).alias("items")).cast(INFO)


def generate_cases(spark: SparkSession, n: int, seed: int = SEED, partitions: int | None = None) -> DataFrame:
    """``n`` cases in the planned numbers of each pattern, in a random order.

    The order is a keyed bijection of 0..n-1 for the pattern schedule, so no
    global shuffle is needed.
    """
    rows = spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    step = next(s for s in range(n * 5 // 8 + 1, 2 * n + 2) if _coprime(s, n)) if n > 1 else 1
    position = F.pmod(F.col("id") * F.lit(step) + F.lit(seed), F.lit(max(n, 1)))
    draw = Draw(F.col("id"), seed)
    groups = list(GROUPS)
    df = rows.select("id", pattern_of(position, n).alias("case_pattern"), F.get(strings(groups), draw.below("group", len(groups))).alias("symptom_group"))
    choose = lambda k: F.coalesce(*[F.when(F.col("symptom_group") == g, strings(GROUPS[g][k])) for g in groups])
    df = df.withColumns({"_complaints": choose(0), "_related": choose(1)})
    df = df.withColumn("chief_complaint", draw.pick("chief", F.col("_complaints")))
    df = df.withColumn("_pool", draw.order("pool", candidate_pool(F.col("_complaints"), F.col("_related"), F.col("chief_complaint"))))
    pattern, pool = F.col("case_pattern"), F.col("_pool")
    gaps = pattern.isin("missing_duration", "missing_medications", "missing_allergies")
    # How many further symptoms each pattern takes.
    extra = (
        F.when(pattern.isin("negation", "uncertainty"), 1)
        .when(pattern == "mixed", 3)
        .when(pattern == "multiple_present", draw.below("extra", 3) + 1)
        .when(gaps & (draw.uniform("extra") < 0.5), 1)
        .otherwise(0)
    )
    mixed, any_status = draw.order("statuses", strings(STATUSES)), draw.pick("status", strings(STATUSES))
    status = lambda i: F.when(pattern == "negation", "absent").when(pattern == "uncertainty", "uncertain").when(pattern == "mixed", F.get(mixed, i)).when(gaps, any_status).otherwise("present")
    chance = F.when(pattern == "mixed", 0.4).when(pattern == "multiple_present", 0.5).otherwise(0.3)
    more = F.transform(
        F.slice(pool, 1, F.least(extra, F.size(pool))),
        lambda name, i: symptom(name, status(i), F.when(draw.uniform("more:has", name) < chance, random_duration(draw, "more", name))),
    )
    forced = pattern.isin("missing_medications", "missing_allergies")
    own = F.when(pattern == "missing_duration", F.lit(None).cast(DURATION)).when(forced, random_duration(draw, "own"))
    own = own.when(pattern == "multiple_present", optional_duration(draw, "own", 0.9)).otherwise(optional_duration(draw, "own", 0.85))
    df = df.withColumn("symptoms", F.concat(F.array(symptom(F.col("chief_complaint"), F.lit("present"), own)), more))
    df = df.withColumn("medications", medications(draw, pattern == "missing_medications"))
    df = df.withColumn("allergies", allergies(draw, pattern == "missing_allergies", F.col("medications")["items"]))
    df = df.withColumn("missing_information", derived_missing_struct(F.struct("chief_complaint", "symptoms", "medications", "allergies")))
    return df.select(F.format_string("case_%04d", F.col("id") + 1).alias("case_id"), "case_pattern", "symptom_group", *TARGET_FIELDS)


def _coprime(a: int, b: int) -> bool:
    while b:
        a, b = b, a % b
    return a == 1


def build_target() -> Column:
    """The five-field target of a case row."""
    return F.struct(*[F.col(f) for f in TARGET_FIELDS])


def expand_languages(df: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """Each row once for each language."""
    return df.withColumn("language", F.explode(strings(languages)))


def template_utterance(target: Column) -> Column:
    """A deterministic sentence that says what the target says; the default where no model is plugged in."""
    said = F.transform(
        target["symptoms"],
        lambda s: F.concat(
            F.when(s["status"] == "absent", F.lit("no ")).when(s["status"] == "uncertain", F.lit("maybe ")).otherwise(F.lit("")),
            s["name"],
            F.when(s["duration"].isNull(), F.lit("")).otherwise(F.concat(F.lit(" for "), s["duration"]["value"].cast("string"), F.lit(" "), s["duration"]["unit"])),
        ),
    )
    group = lambda field, name: F.when(target[field]["status"] == "reported", F.concat(F.lit(f"; {name}: "), F.array_join(target[field]["items"], ", "))).when(target[field]["status"] == "none", F.lit(f"; no {name}")).otherwise(F.lit(""))
    return F.concat(F.array_join(said, ", "), group("medications", "medication"), group("allergies", "allergies"), F.lit("."))


def build_samples(cases: DataFrame, utterance: Column | None = None) -> DataFrame:
    """Samples of cases with ``split``: every language, the target, an utterance in the language's digits."""
    rows = expand_languages(cases.withColumn("target", build_target()))
    said = template_utterance(F.col("target")) if utterance is None else utterance
    return rows.select(
        "case_id",
        "split",
        "language",
        arabic_digits(said, F.col("language")).alias("utterance"),
        "target",
        F.lit(SAMPLE_SOURCE).alias("source"),
        F.lit(SCHEMA_VERSION).alias("schema_version"),
    )
