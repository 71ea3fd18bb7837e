"""JSON Lines sources and sinks."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caseframe.operators.expectations import require_unique

CORRUPT = "_corrupt"


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Fail-fast scan: a malformed line ends the job. Blank lines are skipped. Give a schema on large inputs; inference reads them twice."""
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def read_jsonl_permissive(spark: SparkSession, path: str, schema: str, key: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad lines): malformed lines are set aside.

    With a key, the last row of each key stays: by file, then by position in it.
    """
    parsed = F.from_json("value", f"{schema}, {CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at")]
    lines = spark.read.text(path).select("value", parsed.alias("_row"), *place).where(F.trim("value") != "")
    bad = lines.where(F.col(f"_row.{CORRUPT}").isNotNull()).select(F.col("value").alias(CORRUPT))
    good = lines.where(F.col(f"_row.{CORRUPT}").isNull()).select("_row.*", "_file", "_block", "_at").drop(CORRUPT)
    if key:
        good = keep_last(good, key, ("_file", "_block", "_at"))
    return good.drop("_file", "_block", "_at"), bad


def numbered_errors(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text) of the lines that hold no JSON value; whole files are read in order, so it serves diagnosis of single files."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("pos", "text"))
    blank = F.trim("text") == ""
    return text.where(~blank & F.expr("try_parse_json(text)").isNull()).select("file", (F.col("pos") + 1).alias("line"), "text")


def keep_last(df: DataFrame, key: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """The last row of each key by the order."""
    last = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_rank", F.row_number().over(last)).where("_rank = 1").drop("_rank")


def keep_first(df: DataFrame, key: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """The first row of each key by the order."""
    first = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(first)).where("_rank = 1").drop("_rank")


def read_keyed(spark: SparkSession, path: str, schema: str, key: tuple[str, ...]) -> DataFrame:
    """A scan whose key must be complete and unique, of a table that must not be empty."""
    df = read_jsonl(spark, path, schema)
    require_unique(df, key)
    return df


def read_splits(spark: SparkSession, paths: dict[str, str], schema: str | None = None, limit: int | None = None) -> DataFrame:
    """Several files as one table, each row tagged with its split; ``limit`` takes so many rows of each."""
    parts = []
    for split, path in paths.items():
        df = read_jsonl(spark, path, schema)
        parts.append((df.limit(limit) if limit else df).withColumn("_split", F.lit(split)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One JSON document that spans lines."""
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite", by: tuple[str, ...] = (), null_fields: bool = True) -> None:
    """UTF-8 JSON Lines; with ``by``, a folder for each value. ``append`` needs no lock: tasks write files of their own."""
    writer = df.write.mode(mode).option("ignoreNullFields", str(not null_fields).lower())
    (writer.partitionBy(*by) if by else writer).json(path)


def write_summary(df: DataFrame, path: str, limit: int = 10_000) -> None:
    """A small aggregate as one pretty JSON document, written through the cluster's file system."""
    rows = [r.asDict(recursive=True) for r in df.limit(limit + 1).collect()]
    if len(rows) > limit:
        raise ValueError(f"a summary has at most {limit} rows")
    text = json.dumps(rows[0] if len(rows) == 1 else rows, indent=2, ensure_ascii=False, default=str)
    write_text(df.sparkSession, text, path)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()


def back_up(spark: SparkSession, path: str, suffix: str = ".backup", overwrite: bool = False) -> bool:
    """Copy a file or folder beside itself; an existing copy stays unless told otherwise. Tells whether it copied."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    source, copy = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + suffix)
    fs = source.getFileSystem(conf)
    if fs.exists(copy) and not overwrite:
        return False
    return bool(jvm.org.apache.hadoop.fs.FileUtil.copy(fs, source, fs, copy, False, True, conf))


def table_text(df: DataFrame, widths: dict[str, int], limit: int = 1000) -> str:
    """A fixed-width report of a small table: numbers to the right, texts to the left; laid out by the engine. A larger table raises."""
    kinds = dict(df.dtypes)
    cell = lambda c, w: (F.rpad if kinds[c] == "string" else F.lpad)(F.coalesce(F.col(c).cast("string"), F.lit("")), w, " ")
    lines = df.limit(limit + 1).select(F.concat_ws("  ", *[cell(c, w) for c, w in widths.items()]).alias("line")).collect()
    if len(lines) > limit:
        raise ValueError(f"a report has at most {limit} rows")
    head = "  ".join(c[:w].ljust(w) if kinds[c] == "string" else c[:w].rjust(w) for c, w in widths.items())
    return "\n".join([head, "-" * len(head), *[r["line"].rstrip() for r in lines]])
