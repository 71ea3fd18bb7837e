"""Session defaults shared by tests, benchmarks and scripts."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(cores: int | str = "*", app: str = "caseframe", **conf: str) -> SparkSession:
    """A local session; on a cluster use the session that is already there."""
    n = 8 if cores == "*" else int(cores)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.variant.allowDuplicateKeys", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
