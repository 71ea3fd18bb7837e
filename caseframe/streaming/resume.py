"""Resumable processing of a growing folder of rows: each key is done once, across restarts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from caseframe.operators.repair import KEY, pending


def resume_stream(
    spark: SparkSession,
    source: str,
    schema: str,
    sink: str,
    checkpoint: str,
    work: Callable[[DataFrame], DataFrame],
    key: tuple[str, ...] = KEY,
    fmt: str = "json",
) -> StreamingQuery:
    """Reads new files of ``source``, drops keys that ``sink`` has, and appends what ``work`` makes of the rest.

    The checkpoint remembers files, the sink remembers keys: a batch that is
    run again after a failure finds its keys done.
    """

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.dropDuplicates(list(key))
        try:
            done = rows.sparkSession.read.parquet(sink)
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
                raise
            done = None
        work(rows if done is None else pending(rows, done, key)).write.mode("append").parquet(sink)

    stream = spark.readStream.schema(schema).format(fmt).load(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
