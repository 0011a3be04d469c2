"""Structured Streaming: commit frames to a table of changes, first write of a uri wins, deletes are tombstones."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..shared import cleaning
from ..sources.commits import POST, REPOST, gated, parsed
from .keyed import FORGET_MS, first_writes, rocks

COUNTERS = "batch_id long, read long, kept long, inserted long, deleted long"
PROGRESS = "at string, batch_id long, rows_in long, batch_ms long, backlog long"


def read_frames(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """JSON lines as they arrive; files per trigger bound a batch, and nothing is dropped.

    Only commits of post and repost collections pass, told by the line's text before it is parsed.
    """
    wanted = F.col("value").contains(POST) | F.col("value").contains(REPOST)
    return spark.readStream.schema("value string").option("maxFilesPerTrigger", files_per_trigger).text(path).where(wanted)


def _activate(spark: SparkSession) -> None:
    """Make ``spark`` the active session of the stream's thread again: the next batch's keyed state is planned with it."""
    spark._get_j_spark_session_class(spark._jvm).setActiveSession(spark._jsparkSession)


def start(frames: DataFrame, graph: DataFrame | Callable[[], DataFrame], table: str, checkpoint: str, trigger: dict | None = None, forget_ms: int = FORGET_MS, keep: tuple[str, ...] | None = None):
    """Keep the gated posts of ``frames``, each uri's first, and the deletes, as a table of changes.

    What is known of a uri is keyed state, not a look into ``table``. A batch writes one folder by its number,
    ``table/batch=<n>``: a batch that runs again after a loss writes over what it wrote, so nothing is doubled,
    and offsets, state and folders name the same batches. ``graph`` is read where a batch is written; it may be a
    function, which each batch then calls, so a refreshed graph counts from the next batch on. ``<table>-counters``
    gets a row for each batch: events read that changed something, kept by the gate, posts and deletes written.
    ``keep`` names the columns of posts that the table's readers want (all, if none): whole frames are read and
    parsed in any case, but a stream is not pruned for its readers as a query is, so what isn't named here would
    be shuffled to its state and written.
    """
    spark, events = frames.sparkSession, parsed(frames)
    if keep is not None:
        needed = {*keep, "uri", "op", "author_did", "external_domain"}  # state and gate read these
        events = events.select(*[c for c in events.columns if c in needed])

    def write(batch: DataFrame, batch_id: int) -> None:
        read, kept = Observation(), Observation()
        n, creates = F.count(F.lit(1)), F.count_if(F.col("op") == "create")
        rows = gated(batch.observe(read, n.alias("n")), graph() if callable(graph) else graph)
        rows = rows.observe(kept, n.alias("n"), creates.alias("creates")).select(*events.columns)
        with cleaning(batch.sparkSession):
            rows.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")
        counts = [(batch_id, read.get["n"], kept.get["n"], kept.get["creates"], kept.get["n"] - kept.get["creates"])]
        batch.sparkSession.createDataFrame(counts, COUNTERS).coalesce(1).write.mode("overwrite").parquet(f"{table}-counters/batch={batch_id}")
        _activate(batch.sparkSession)

    with rocks(spark):
        changes = first_writes(events, forget_ms).writeStream.foreachBatch(write).outputMode("update")
        return changes.option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "10 seconds"})).start()


def changes(spark: SparkSession, table: str) -> DataFrame:
    """All changes so far, with the batch that wrote them."""
    like = parsed(spark.createDataFrame([], "value string")).schema
    return spark.read.schema(like.add("batch", "long")).option("basePath", table).parquet(table)


def current(spark: SparkSession, table: str) -> DataFrame:
    """Posts that are held: created and not deleted, whichever event came first."""
    every = changes(spark, table)
    return every.where("op = 'create'").join(every.where("op = 'delete'").select("uri"), "uri", "left_anti")


def compact(spark: SparkSession, table: str, through: int) -> int:
    """Fold the batches up to ``through``, all of them committed, into one folder without deleted posts; returns how many were folded.

    The new folder has a negative number and is moved into place before the old ones go, so a reader may see a post
    twice meanwhile, but never misses one. Deletes stay, for posts of earlier folders.
    """
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    root = fs_path(table)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = sorted(int(s.getPath().getName()[6:]) for s in fs.listStatus(root) if s.getPath().getName().startswith("batch="))
    old = [b for b in found if b <= through]
    if len(old) < 2:
        return 0
    rows = changes(spark, table).where(F.col("batch") <= through)
    gone = rows.where("op = 'delete'").select("uri").distinct()
    kept = rows.where("op = 'create'").join(gone, "uri", "left_anti").drop("batch")
    staged = f"{table}-compacted"
    with cleaning(spark):
        kept.unionByName(rows.where("op = 'delete'").drop("batch").dropDuplicates(["uri"])).write.mode("overwrite").parquet(staged)
    if not fs.rename(fs_path(staged), fs_path(f"{table}/batch={-1 - through}")):
        raise RuntimeError(f"batches up to {through} were folded before")
    for b in old:
        fs.delete(fs_path(f"{table}/batch={b}"), True)
    return len(old)


def counters(spark: SparkSession, table: str) -> DataFrame:
    return spark.read.schema(COUNTERS).parquet(f"{table}-counters")


class Progress(StreamingQueryListener):
    """Writes a row about each batch: rows in, its time, and how many landed files wait behind it.

    ``landed`` tells how many files have arrived; the frames' own source tells in its offsets how many it has taken.
    """

    def __init__(self, spark: SparkSession, path: str, landed: Callable[[], int] | None = None):
        self.spark, self.path, self.landed, self.taken = spark, path, landed, 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        ms = int(p.durationMs.get("triggerExecution", 0)) if p.durationMs else 0
        row = (str(p.timestamp), int(p.batchId), int(p.numInputRows), ms, self.backlog(p))
        self.spark.createDataFrame([row], PROGRESS).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/run={p.runId}/batch={p.batchId}")

    def backlog(self, progress) -> int | None:
        """Files that have landed and no batch has taken: those behind the name in the source's offset, or None if it has none."""
        if self.landed is None or not progress.sources:
            return None
        end = progress.sources[0].endOffset
        try:
            taken = json.loads(end) if end else {}
        except ValueError:
            return None
        return max(0, self.landed() - int(taken["files"])) if "files" in taken else None

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def progress(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROGRESS).parquet(path)


def hourly(events: DataFrame) -> DataFrame:
    """Tumbling counts by type, an extra beside the feed: late events count for two hours."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "2 hours")
    return timed.groupBy(F.window("at", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))
