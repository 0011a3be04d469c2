"""Tables on disk that change: keyed tables merged bucket by bucket, snapshots, and tables by day.

A keyed table's rows lie in buckets by a hash of their key. A merge reads and writes only the buckets that the changes
touch, into a folder of its own, and is published by one small row that tells for every bucket which folder holds it.
Readers go by the newest published row; a write that is lost before it is published leaves the version before it as it was.
One writer at a time changes a table; readers may read any number of its versions meanwhile.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators import state
from .shared import cleaning

VERSION = "version long, folders map<int,long>"


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def folders(spark: SparkSession, path: str, prefix: str) -> list[str]:
    """What stands behind ``prefix`` in the names of a folder's folders, in order."""
    at, fs = _files(spark, path)
    return sorted(s.getPath().getName()[len(prefix) :] for s in fs.listStatus(at) if s.isDirectory() and s.getPath().getName().startswith(prefix)) if fs.exists(at) else []


def drop(spark: SparkSession, path: str) -> None:
    at, fs = _files(spark, path)
    fs.delete(at, True)


class Keyed:
    """A table in ``path`` with one row for each value of ``key``, in ``buckets`` buckets."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: T.StructType, buckets: int = 64):
        self.spark, self.path, self.key, self.schema, self.buckets = spark, path.rstrip("/"), key, schema, buckets

    def bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def versions(self) -> list[int]:
        return sorted(int(v) for v in folders(self.spark, f"{self.path}/versions", "v="))

    def _published(self, version: int | None = None) -> tuple[int, dict[int, int]]:
        known = self.versions()
        if not known:
            return 0, {}
        at = known[-1] if version is None else version
        row = self.spark.read.schema(VERSION).parquet(f"{self.path}/versions/v={at}").collect()[0]  # one row
        return at, dict(row.folders)

    def _rows(self, held: dict[int, int]) -> DataFrame:
        paths = [f"{self.path}/data/w={w}/bucket={b}" for b, w in sorted(held.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the newest version, or of one that is still there."""
        return self._rows(self._published(version)[1])

    def lookup(self, *values) -> DataFrame:
        """Rows of some keys: only their buckets are read."""
        wanted = self.spark.createDataFrame([(v,) for v in values], f"{self.key} {self.schema[self.key].dataType.simpleString()}")
        touched = {r.b for r in wanted.select(self.bucket().alias("b")).distinct().collect()}  # one for each value asked for, at most
        held = {b: w for b, w in self._published()[1].items() if b in touched}
        return self._rows(held).where(F.col(self.key).isin(*values))

    def write(self, merged, changes: DataFrame) -> int:
        """Publish ``merged(rows of the touched buckets, changes)`` in place of these buckets; the number of buckets written.

        ``merged`` may add, change and drop rows of its first frame, and add rows of changed keys; nothing else.
        """
        version, held = self._published()
        touched = sorted(r.b for r in changes.select(self.bucket().alias("b")).distinct().collect())  # as many as there are buckets, at most
        if not touched:
            return 0
        folder = max([version, *held.values()]) + 1
        while folders(self.spark, f"{self.path}/data/w={folder}", ""):  # left by a write that was lost
            folder += 1
        rows = merged(self._rows({b: held[b] for b in touched if b in held}), changes)
        rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema]).withColumn("bucket", self.bucket())
        with cleaning(self.spark):
            rows.repartition(min(len(touched), self.buckets), "bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/w={folder}")
        written = {int(b) for b in folders(self.spark, f"{self.path}/data/w={folder}", "bucket=")}
        self._publish(version + 1, {b: w for b, w in held.items() if b not in touched} | dict.fromkeys(written, folder))
        return len(touched)

    def _publish(self, version: int, held: dict[int, int]) -> None:
        """The row is written aside and moved into place, which happens whole or not at all."""
        staged = f"{self.path}/staged-{version}"
        self.spark.createDataFrame([(version, held)], VERSION).coalesce(1).write.mode("overwrite").parquet(staged)
        to, fs = _files(self.spark, f"{self.path}/versions/v={version}")
        fs.mkdirs(to.getParent())
        if not fs.rename(_files(self.spark, staged)[0], to):
            raise RuntimeError(f"version {version} of {self.path} was published by another writer")

    def upsert(self, changes: DataFrame, columns: list[str]) -> int:
        """New rows, and ``columns`` of known rows overwritten."""
        return self.write(lambda rows, new: state.upsert(rows, new, self.key, columns), changes)

    def delete(self, gone: DataFrame) -> int:
        return self.write(lambda rows, keys: state.delete(rows, keys, self.key), gone.select(self.key))

    def vacuum(self, keep: int = 2) -> int:
        """Drop all but the newest ``keep`` versions, and the buckets' folders that none of these reads; the number of folders dropped."""
        known = self.versions()
        alive = {(w, b) for v in known[-keep:] for b, w in self._published(v)[1].items()}
        for v in known[:-keep]:
            drop(self.spark, f"{self.path}/versions/v={v}")
        n = 0
        for w in map(int, folders(self.spark, f"{self.path}/data", "w=")):
            for b in map(int, folders(self.spark, f"{self.path}/data/w={w}", "bucket=")):
                if (w, b) not in alive:
                    drop(self.spark, f"{self.path}/data/w={w}/bucket={b}")
                    n += 1
        return n


class Snapshots:
    """Whole small tables, each pass a folder of its own: readers keep the one they began with."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | None = None):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def versions(self) -> list[int]:
        return sorted(int(v) for v in folders(self.spark, self.path, "v="))

    def publish(self, rows: DataFrame, keep: int = 3) -> int:
        """Write the next snapshot aside and move it into place; all but the newest ``keep`` are dropped."""
        known = self.versions()
        version = known[-1] + 1 if known else 1
        with cleaning(self.spark):
            rows.write.mode("overwrite").parquet(f"{self.path}/staged-{version}")
        to, fs = _files(self.spark, f"{self.path}/v={version}")
        if not fs.rename(_files(self.spark, f"{self.path}/staged-{version}")[0], to):
            raise RuntimeError(f"snapshot {version} of {self.path} was published by another writer")
        for v in known[: len(known) + 1 - keep]:
            drop(self.spark, f"{self.path}/v={v}")
        return version

    def read(self, version: int | None = None) -> DataFrame:
        at = self.versions()[-1] if version is None else version
        reader = self.spark.read if self.schema is None else self.spark.read.schema(self.schema)
        return reader.parquet(f"{self.path}/v={at}")


class Daily:
    """A table with a folder for each day of ``time_col``: what is too old goes by folders, and no file is read for that."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, time_col: str = "created_at", by: str | None = None):
        self.spark, self.path, self.schema, self.time_col, self.by = spark, path.rstrip("/"), schema, time_col, by

    def append(self, rows: DataFrame) -> None:
        """Add rows; days are spread by a hash of the time, so that a busy day is no single task's."""
        salted = rows.withColumn("day", F.to_date(self.time_col))
        parts = [self.by, "day"] if self.by else ["day"]
        with cleaning(self.spark):
            salted.repartition(*[F.col(p) for p in parts], F.pmod(F.xxhash64(self.time_col), F.lit(8))).write.mode("append").partitionBy(*parts).parquet(self.path)

    def read(self) -> DataFrame:
        full = T.StructType([*self.schema.fields, T.StructField("day", T.DateType())])
        return self.spark.read.schema(full).option("basePath", self.path).parquet(self.path)

    def since(self, now: datetime, hours: int) -> DataFrame:
        """Rows of the last hours: whole days by their folders, the border day by its rows."""
        cutoff = now - timedelta(hours=hours)
        rows = self.read().where(F.col("day") >= F.lit(cutoff.date()))
        return rows.where(F.col(self.time_col) >= F.lit(cutoff).cast("timestamp_ntz")).drop("day")

    def days(self) -> list[date]:
        """Days of a table that is partitioned by day alone."""
        return [date.fromisoformat(d) for d in folders(self.spark, self.path, "day=") if d != "__HIVE_DEFAULT_PARTITION__"]

    def purge(self, now: datetime, hours: int) -> int:
        """Drop the folders of days that lie wholly before the last hours; their number. Rows without a time stay nowhere."""
        cutoff = (now - timedelta(hours=hours)).date()
        old = [d for d in self.days() if d < cutoff]
        for d in old:
            drop(self.spark, f"{self.path}/day={d.isoformat()}")
        return len(old)

    def purge_beyond(self, most: int) -> int:
        """Of each value of ``by``, drop the days behind those that hold its newest ``most`` rows; the number of folders dropped.

        Counted from the files' own row counts by partition, so no row is read.
        """
        days = self.read().groupBy(self.by, "day").agg(F.count(F.lit(1)).alias("n"))
        newer = F.sum("n").over(state.Window.partitionBy(self.by).orderBy(F.desc("day")).rowsBetween(state.Window.unboundedPreceding, -1))
        old = days.withColumn("newer", F.coalesce(newer, F.lit(0))).where(F.col("newer") >= most).select(self.by, "day").collect()  # folders, not rows
        for r in old:
            drop(self.spark, f"{self.path}/{self.by}={r[0]}/day={r.day.isoformat()}")
        return len(old)
