"""Keyed state in the stream: the first write of a uri wins and a delete stands, in whatever order they come.

Each uri has its own state, which knows whether its post is held or gone. A batch touches the states of its own uris
alone, so its cost doesn't grow with what was ever kept. A state forgets its uri some time after it was last heard
of, by the stream's clock; the dates that clients give decide nothing.

State is a set of tokens that the JVM keeps without a call to Python for each uri. A create takes the uri's token
``held``, a delete takes both ``held`` and ``gone``, and who takes a token first has made that change. So a create that
comes behind a delete finds its token taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EMPTY = "spark.sql.streaming.noDataMicroBatches.enabled"
HELD, GONE = 0, 1
#: A uri is remembered so long at least after its last event: as long as its post may be read, and as long again.
FORGET_MS = 2 * dims.RETENTION_HOURS * 3_600_000


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Streams that start in this block keep state in RocksDB, not on the heap, and run no batch without input.
    """
    before = {k: spark.conf.get(k) for k in (PROVIDER, EMPTY)}
    spark.conf.set(PROVIDER, ROCKS)
    spark.conf.set(EMPTY, "false")
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def first_writes(events: DataFrame, forget_ms: int = FORGET_MS) -> DataFrame:
    """The events of a stream (``uri, op, ...``) that change what is known of their uri; the query starts within ``rocks``.

    Creates of a uri in one batch are ordered as they come; all carry what is due to the first.

    The clock runs in spans of ``forget_ms``, and a token holds for one of them. An event takes the tokens of its span,
    which tell whether it changes anything, and those of the next, so a uri is known for one to two spans after it was last
    heard of. Tokens of spans that are over go; those of the span before stay, should a clock be set back. Only the token
    that lets an event through carries its columns.
    """
    span = F.floor(F.unix_millis(F.current_timestamp()) / forget_ms).cast("long")
    slots = F.when(F.col("op") == "delete", F.array(F.lit(HELD), F.lit(GONE))).otherwise(F.array(F.lit(HELD)))
    known = events.withColumns({"__span": span, "__slot": F.explode(slots)}).withColumn("__later", F.explode(F.array(F.lit(0), F.lit(1))))
    through = (F.col("__later") == 0) & (F.col("__slot") == F.when(F.col("op") == "delete", GONE).otherwise(HELD))
    tokens = known.select("uri", "__slot", F.timestamp_millis((F.col("__span") + F.col("__later")) * forget_ms).alias("__from"), through.alias("__through"), *[F.when(through, F.col(f"`{c}`")).alias(c) for c in events.columns if c != "uri"])
    taken = tokens.withWatermark("__from", f"{2 * forget_ms + 1} milliseconds").dropDuplicates(["uri", "__slot", "__from"])
    return taken.where("__through").select(*[F.col(f"`{c}`") for c in events.columns])
