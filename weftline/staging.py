"""The one folder that driver and executors share, for checkpoints and staged tables, and who deletes what is in it."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession

#: Paths that this process has staged and not deleted, by application.
_STAGED: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only where none is set and the master is local."""
    context = spark.sparkContext
    set_by = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if set_by:
        if not context.getCheckpointDir():
            context.setCheckpointDir(set_by)
        return set_by.rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    context.setCheckpointDir(made := tempfile.mkdtemp(prefix="weftline-"))
    return made


def staged_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that no other call returns. It belongs to the innermost ``owned`` block, or to ``release``."""
    path = f"{shared_dir(spark)}/weftline-{what}-{uuid.uuid4().hex}"
    _STAGED.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def hadoop_path(spark: SparkSession, path: str):
    """The path and its file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    at, fs = hadoop_path(spark, path)
    fs.delete(at, True)


def release(spark: SparkSession, since: int = 0) -> int:
    """Deletes what was staged (from the ``since``-th path on) and returns how many paths. Frames that read them can't be used any more."""
    paths = _STAGED.get(spark.sparkContext.applicationId, [])
    gone = paths[since:]
    del paths[since:]
    for path in gone:
        delete(spark, path)
    return len(gone)


@contextlib.contextmanager
def owned(spark: SparkSession) -> Iterator[None]:
    """What is staged inside is deleted at the end, whether the work fails or not. For work whose result is written before that."""
    since = len(_STAGED.get(spark.sparkContext.applicationId, []))
    try:
        yield
    finally:
        release(spark, since)
