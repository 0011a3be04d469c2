"""Tables in the folder that the driver and all executors see."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    Read from ``spark.checkpoint.dir``; only a session in one process (tests) that has none gets a folder of its own.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that the driver and all executors see")
        own = tempfile.mkdtemp(prefix="emberdesk-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = "file://" + own
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets; ``release`` removes it."""
    path = f"{shared_dir(spark)}/emberdesk-{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


#: Spark's setting to remove a query's shuffle files as soon as it has ended.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaning(spark: SparkSession) -> Iterator[None]:
    """Within this block a query's shuffle files go with its end; the session's own setting comes back after it."""
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEAN)
        else:
            spark.conf.set(CLEAN, before)


#: Spark's setting of how many files a task keeps open, to write rows to their folders as they come and not sorted by these.
OPEN = "spark.sql.maxConcurrentOutputFileWriters"


@contextmanager
def split_as_written(spark: SparkSession, folders: int) -> Iterator[None]:
    """Within this block a write by columns sorts nothing, if a task has rows for no more than ``folders`` of their values."""
    before = spark.conf.get(OPEN)
    spark.conf.set(OPEN, str(folders))
    try:
        yield
    finally:
        spark.conf.set(OPEN, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: lineage ends here.

    A lost executor costs only the tasks it was running, and a value drawn from a plan is the same
    each time it is read.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with cleaning(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Remove all tables that were written so far; returns their number.

    For long sessions, between runs: results that were not written elsewhere by then can't be read any more.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf, n = spark.sparkContext._jsc.hadoopConfiguration(), 0
    while _WRITTEN:
        at = hadoop(_WRITTEN.pop())
        n += bool(at.getFileSystem(conf).delete(at, True))
    return n
