"""Where intermediate results go."""

from __future__ import annotations

import functools
import tempfile
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Spark deletes the shuffle files of plans that are made while this is on as soon as they have run.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_SCOPES = threading.local()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``, or a checkpoint folder set otherwise.

    A local one is made only where none is set and Spark runs in one process, as in tests; on a cluster that is an error.
    """
    context = spark.sparkContext
    named, held = spark.conf.get("spark.checkpoint.dir", None), context._jsc.sc().getCheckpointDir()
    if named and not held.isDefined():
        context.setCheckpointDir(named)
    elif not held.isDefined():
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: intermediate results need a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="umbra-checkpoint-"))
    return named or context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` in the shared folder, without its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def step(df: DataFrame) -> DataFrame:
    """Like ``cut``, but the shuffle files go when the result is written, and the result when its ``tidy`` scope ends."""
    conf = df.sparkSession.conf
    before = conf.get(_FREE, None)
    conf.set(_FREE, "true")
    try:
        made = cut(df.select("*"))
    finally:
        conf.unset(_FREE) if before is None else conf.set(_FREE, before)
    for scope in _scopes()[-1:]:
        scope.append(made)
    return made


def tidy(work: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``work`` with its result written as a ``step``, after which all other steps that were made on the way are deleted."""

    @functools.wraps(work)
    def tidied(*args, **kwargs):
        scopes, result = _scopes(), None
        scopes.append([])
        try:
            result = step(work(*args, **kwargs))
        finally:
            release(*(x for x in scopes.pop() if x is not result))
        for scope in scopes[-1:]:
            scope.append(result)
        return result

    return tidied


def release(*steps: DataFrame) -> None:
    """Deletes what ``step`` has written for these. Nothing that isn't written itself may be read from them any more."""
    for df in steps:
        held = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if held.isDefined():
            delete(df.sparkSession, held.get())


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder through Spark's own file systems, so wherever it lies."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _scopes() -> list[list[DataFrame]]:
    """The open ``tidy`` scopes of this thread, each with its steps."""
    if not hasattr(_SCOPES, "open"):
        _SCOPES.open = []
    return _SCOPES.open
