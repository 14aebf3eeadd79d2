"""The folder that all executors share, and what is written there."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_MADE: set[str] = set()


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or else the context's checkpoint directory.

    Where neither is set, a temporary folder if driver and executors are one
    process; on a cluster that would be a folder of each machine, so it fails.
    """
    set_to = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    set_to = set_to or spark.sparkContext.getCheckpointDir()
    if set_to:
        return set_to.rstrip("/")
    master, app = spark.sparkContext.master, spark.sparkContext.applicationId
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="lodestone-")
    return _OWN[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; what is there is deleted when the driver's Python ends, if not before."""
    path = f"{folder(spark)}/lodestone/{name}-{uuid.uuid4().hex}"
    if not _MADE:
        atexit.register(_cleared)
    _MADE.add(path)
    return path


def deleted(path: str) -> None:
    """Deletes the folder `path`."""
    jvm, context = SparkContext._jvm, SparkContext._active_spark_context
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(context._jsc.hadoopConfiguration() if context else jvm.org.apache.hadoop.conf.Configuration()).delete(at, True)
    _MADE.discard(path)


def _cleared() -> None:
    for path in list(_MADE):
        try:
            deleted(path)
        except Exception:  # noqa: BLE001  (the JVM may be gone by now)
            return


def saved_table(df: DataFrame, name: str) -> DataFrame:
    """`df` written there as Parquet and read again, which cuts its lineage."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """No more than `rows` rows in an Arrow batch of what is run within; JVM and Python hold whole batches."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
