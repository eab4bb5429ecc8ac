"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join partition even if a later step then needs a shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


#: Spark 4.1 deletes the shuffle files of a query at its end.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(master: str | None = None, app: str = "plumbline", **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, as the cluster names it.

    Only a local session may fall back to a folder of its own machine.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    active = context._jsc.sc().getCheckpointDir()
    if active.isDefined():
        return configured or active.get()
    if configured is None:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder")
        configured = tempfile.mkdtemp(prefix="plumbline-checkpoint-")
    context.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


_SCRATCH: list[str] = []


def clear_scratch(spark: SparkSession) -> None:
    """Delete the step tables written so far, once nothing reads them any more."""
    while _SCRATCH:
        _delete(spark, _SCRATCH.pop())


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


_CLEANING = threading.Lock()
_WRITERS: dict[str, tuple[int, str | None]] = {}


@contextmanager
def _shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """SHUFFLE_CLEANUP is on for the session while some thread is within."""
    name = spark._jsparkSession.sessionUUID()
    with _CLEANING:
        inside, before = _WRITERS.get(name, (0, None))
        if not inside:
            before = spark.conf.get(SHUFFLE_CLEANUP, None)
            spark.conf.set(SHUFFLE_CLEANUP, "true")
        _WRITERS[name] = inside + 1, before
    try:
        yield
    finally:
        with _CLEANING:
            inside, before = _WRITERS.pop(name)
            if inside > 1:
                _WRITERS[name] = inside - 1, before
            elif before is None:
                spark.conf.unset(SHUFFLE_CLEANUP)
            else:
                spark.conf.set(SHUFFLE_CLEANUP, before)


def cut_lineage(df: DataFrame, label: str = "step") -> DataFrame:
    """Write the rows to the shared folder and go on from the written table.

    The table outlives lost executors, and its size is known to the join planner. What was shuffled for it is deleted
    once it is written, and not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    _SCRATCH.append(path)
    with _shuffles_deleted(spark):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._step_path = path
    return table


def free(*tables: DataFrame) -> None:
    """Delete step tables that nothing reads any more: what was made of them is written."""
    for table in tables:
        path = getattr(table, "_step_path", None)
        if path in _SCRATCH:
            _SCRATCH.remove(path)
            _delete(table.sparkSession, path)
