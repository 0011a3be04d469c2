"""Pieces that several corpus operators share: shared storage, input columns, vocabulary text."""

from __future__ import annotations

import threading
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import cleaning
from ..shared import new_path as new_path

_CALL = threading.local()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path, most = new_path(spark, name), getattr(_CALL, "most", None)
    with cleaning(spark):
        (df.coalesce(most) if most else df).write.parquet(path)
    if getattr(_CALL, "tables", None) is not None:
        _CALL.tables.append((name, path))
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession, keep: tuple[str, ...]) -> Iterator[None]:
    """Tables that this block stores are removed at its end, but those named in ``keep``.

    What outlives the block may read the kept tables only. Should the block fail, its tables stay.
    """
    outer, most, _CALL.tables = getattr(_CALL, "tables", None), getattr(_CALL, "most", None), []
    try:
        yield
        own = _CALL.tables
    finally:
        _CALL.tables, _CALL.most = outer, most
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name, path in own:
        if name not in keep:
            at = hadoop(path)
            at.getFileSystem(conf).delete(at, True)
        elif outer is not None:
            outer.append((name, path))


#: Documents that a task has at least, where tables are written with as many tasks as there is work for.
TASK_ROWS, LEAST_TASKS = 2_000, 8


def spread(rows: int) -> None:
    """Until the ``passing`` block ends, tables made from so many documents are written by a task for each ``TASK_ROWS`` at most.

    A session with many partitions would write as many files of each small table, however few rows they hold.
    """
    _CALL.most = max(LEAST_TASKS, -(-rows // TASK_ROWS))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Bytes of one batch between Spark and Python, unless the session has its own setting.
BATCH_BYTES = 8 << 20
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Batches of bounded bytes rather than of many long texts; a session's own setting stays."""
    if spark.conf.get(BATCH_CONF) in ("64m", "64MB", "67108864", "67108864b"):  # the default
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator needs, by fixed names; other columns can't clash with its own."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


#: Rows of a small table that is sent to all tasks, at most; with more it is joined by a shuffle.
BROADCAST_ROWS = 20_000


def finite_vectors(rows: DataFrame, id_col: str, vec_col: str, extra: dict[str, str] | None = None) -> tuple[DataFrame, int]:
    """``vec_id, v`` and the renamed columns of ``extra``: rows whose vector is not empty and all finite; its length.

    Vectors of another length than the commonest (of equally common ones the shortest) are left out.
    """
    also = [F.col(c).alias(name) for name, c in (extra or {}).items()]
    own = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"), *also)
    own = own.where(F.size("v") > 0).where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    common = own.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    length = common[0].n if common else 0
    return own.where(F.size("v") == length), length


def matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long lists of numbers as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def vocabulary(path: str | None = None) -> str:
    """The text of a tokenizer file. It has a fixed size and travels with the tasks."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def schema_of(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def slices(batches: Iterator[pa.RecordBatch], max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds about ``max_bytes``; a longer row stands alone."""
    for b in batches:
        rows = b.num_rows
        if not rows:
            continue
        step = max(1, int(rows * max_bytes / max(1, b.nbytes)))
        for at in range(0, rows, step):
            yield b.slice(at, step)
