"""Views of the driver tables as cases, predictions, samples and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseframe.functions.arrays import once
from caseframe.functions.normalize import derived_missing_struct
from caseframe.operators.generate import strings
from caseframe.operators.model_io import compact_json
from caseframe.schema import DURATION, INFO, LANGUAGES, SYMPTOM, TARGET_FIELDS
from caseframe.sources.tables import table

BASE, CANDIDATE = 0, 3


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as cases, their lines as symptoms in a fixed order; names repeat now and then."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag"]

    def symptom(x: Column) -> Column:
        """Of a line, after the lines have been moved and sorted: what is derived from them isn't."""
        status = F.when(x["l_returnflag"] == "N", "present").when(x["l_returnflag"] == "A", "absent").otherwise("uncertain")
        unit = F.get(strings(("hours", "days", "weeks")), x["l_linenumber"] % 3)
        duration = F.when(x["l_returnflag"] == "N", F.struct((x["l_quantity"].cast("int") % 12 + 1).alias("value"), unit.alias("unit")).cast(DURATION))
        return F.struct(F.concat(F.lit("sym_"), (x["l_partkey"] % 23).cast("string")).alias("name"), status.alias("status"), duration.alias("duration")).cast(SYMPTOM)

    listed = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*order))).alias("_s"))
    joined = listed.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    df = joined.select(F.col("o_orderkey").alias("case_id"), F.col("o_orderpriority").alias("case_pattern"), F.col("o_orderstatus").alias("_o"), once(F.transform("_s", symptom)).alias("symptoms"))
    info = lambda s, item: F.struct(s.alias("status"), F.when(s == "reported", F.array(F.lit(item))).otherwise(strings(())).alias("items")).cast(INFO)
    medication = F.when(F.col("_o") == "F", "reported").when(F.col("_o") == "O", "none").otherwise("unknown")
    allergy = F.get(strings(("unknown", "none", "reported")), (F.col("case_id") % 3).cast("int"))
    df = df.withColumns({"chief_complaint": F.get("symptoms", F.lit(0))["name"], "medications": info(medication, "ibuprofen"), "allergies": info(allergy, "penicillin")})
    df = df.withColumn("missing_information", derived_missing_struct(F.struct("chief_complaint", "symptoms", "medications", "allergies")))
    return df.select("case_id", "case_pattern", *TARGET_FIELDS)


def predictions(spark: SparkSession, sf_dir: str, shift: int = BASE, source: DataFrame | None = None) -> DataFrame:
    """Raw texts for the cases: perfect, with one defect of seven kinds, fenced, with trailing text, or cut off, by the case's number."""
    rows = (cases(spark, sf_dir) if source is None else source).withColumn("_k", ((F.col("case_id") * 7 + F.floor(F.col("case_id") / 11) + shift) % 10).cast("int"))
    k, symptoms = F.col("_k"), F.col("symptoms")
    first = F.get(symptoms, F.lit(0))
    rest = F.slice(symptoms, 2, F.greatest(F.size(symptoms) - 1, F.lit(0)))
    none = F.lit(None).cast(DURATION)
    extra = F.struct(F.lit("sym_extra").alias("name"), F.lit("absent").alias("status"), none.alias("duration")).cast(SYMPTOM)
    flipped = first.withField("status", F.when(first["status"] == "absent", "uncertain").otherwise("absent")).withField("duration", none)
    longer = first.withField("duration", F.when(first["duration"].isNotNull(), F.struct((first["duration"]["value"] + 1).alias("value"), first["duration"]["unit"].alias("unit")).cast(DURATION)))
    changed = (
        F.when(k == 3, F.slice(symptoms, 1, F.size(symptoms) - 1))
        .when(k == 4, F.concat(symptoms, F.array(extra)))
        .when(k == 5, F.concat(F.array(flipped), rest))
        .when(k == 6, F.concat(F.array(longer), rest))
        .otherwise(symptoms)
    )
    text = compact_json(F.struct(*[changed.alias(f) if f == "symptoms" else F.col(f) for f in TARGET_FIELDS]))
    rows, x = rows.withColumn("_x", once(text)), F.col("_x")
    raw = F.when(k == 7, F.concat(F.lit("```json\n"), x, F.lit("\n```"))).when(k == 8, F.concat(x, F.lit(" ok"))).when(k == 9, F.expr("substring(_x, 1, length(_x) - 1)")).otherwise(x)
    rows = rows.withColumn("prediction", raw)
    language = F.get(strings(LANGUAGES), (F.col("case_id") % 7).cast("int"))
    return rows.select("case_id", language.alias("language"), F.struct(*[F.col(f) for f in TARGET_FIELDS]).alias("target"), "prediction")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as samples."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"), F.col("lang").alias("language"), F.col("text").alias("utterance"), "source")


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as verdicts: quality is semantic, no toxicity is language."""
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("case_id"), (F.col("quality") == 1).alias("semantic_passed"), (F.col("toxic") == 0).alias("language_passed"))


def language_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as results: a user is a case, an event type a language, correct if its largest value is over 60."""
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("case_id"), F.col("event_type").alias("language"))
    return rows.agg((F.max("value") > 60).alias("correct"))
