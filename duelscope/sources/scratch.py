"""A folder for files that are written and read again: the shared one of the session, or a temporary one in a local session."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession

_made: dict[str, str] = {}
_left: list[str] = []


def folder(spark: SparkSession, name: str) -> str:
    """A new path below the folder of ``spark.checkpoint.dir``; what is written there goes when the process ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = _made.setdefault("base", tempfile.mkdtemp(prefix="duelscope-files-"))
    path = f"{base.rstrip('/')}/files/{name}-{uuid.uuid4().hex}"
    if not _left:
        atexit.register(clean, spark)
    _left.append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder below one of these that no later plan reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Meanwhile, shuffle files are deleted when the job that made them ends, not when the driver next collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def clean(spark: SparkSession) -> None:
    while _left:
        path = _left.pop()
        with contextlib.suppress(Exception):
            delete(spark, path)
