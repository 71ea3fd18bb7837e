"""Intermediate tables in the shared folder that the cluster names in ``spark.checkpoint.dir``.

A table is written as Parquet, so lineage is cut by files that every executor
can read, and later plans get real sizes and column pruning.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_written: set[str] = set()
_own: list[str] = []
_recorder: ContextVar[list[str] | None] = ContextVar("recorder", default=None)


def folder(spark: SparkSession) -> str:
    """The shared scratch folder; an own one only where the setting is absent and the session is local, as in tests."""
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="caseframe-"))
    return _own[0]


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the scratch folder for one table; it is deleted at exit."""
    path = f"{folder(spark)}/caseframe/{name}-{uuid.uuid4().hex}"
    adopt(path)
    return path


def adopt(path: str) -> None:
    """Have a path deleted with the others."""
    _written.add(path)
    if (paths := _recorder.get()) is not None:
        paths.append(path)


def keep(df: DataFrame, name: str = "part") -> DataFrame:
    """Write ``df`` to the scratch folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def recorded() -> Iterator[list[str]]:
    """Lists the tables that this thread writes within; an outer list gets those that are left."""
    paths: list[str] = []
    token = _recorder.set(paths)
    try:
        yield paths
    finally:
        _recorder.reset(token)
        if (outer := _recorder.get()) is not None:
            outer += [p for p in paths if p in _written]


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch tables that no frame needs any more."""
    context = spark.sparkContext
    for path in paths:
        if path in _written:
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
            _written.discard(path)


def _clear() -> None:
    """At exit: an own folder goes as a whole, tables in the cluster's folder one by one while the session lasts."""
    for own in _own:
        shutil.rmtree(own.removeprefix("file://"), ignore_errors=True)
    spark = SparkSession.getActiveSession()
    if spark is not None and not _own:
        try:
            drop(spark, list(_written))
        except (Py4JError, OSError):  # the session ended first; the folder is the cluster's to clear
            return


atexit.register(_clear)
