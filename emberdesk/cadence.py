"""The clock of the periodic jobs: what is due is decided by stored rows of each job's last run."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dims
from .shared import cleaning

RUNS = "job string, due timestamp_ntz, began timestamp_ntz, failed string"


class Clock:
    """Runs jobs when they are due, in the order of their due times.

    A job is first due its delay after the start, then its interval after each of its runs; a run that fails is
    stored as failed and the job goes on. Runs are rows in ``path``: a clock that is started again goes on from them.
    """

    def __init__(self, spark: SparkSession, path: str, jobs: dict[str, Callable[[datetime], object]], every: dict[str, int] = dims.CADENCE, delay: dict[str, int] = dims.DELAY):
        self.spark, self.path, self.jobs = spark, path, jobs
        self.every, self.delay = {j: timedelta(seconds=every[j]) for j in jobs}, {j: timedelta(seconds=delay.get(j, 0)) for j in jobs}
        self.began: datetime | None = None

    def runs(self) -> DataFrame:
        return self.spark.read.schema(RUNS).parquet(self.path)

    def _store(self, rows: list[tuple]) -> None:
        with cleaning(self.spark):
            self.spark.createDataFrame(rows, RUNS).coalesce(1).write.mode("append").parquet(self.path)

    def due(self, now: datetime) -> list[tuple[datetime, str]]:
        """``(due, job)`` of what is due at ``now``, earliest first."""
        if self.began is None:
            self._store([])
            starts = self.runs().where("job = ''").agg(F.min("began").alias("t")).collect()[0].t
            if starts is None:
                self._store([("", now, now, None)])
            self.began = starts or now
        last = {r.job: r.t for r in self.runs().where("job != ''").groupBy("job").agg(F.max("began").alias("t")).collect()}  # one row for each job
        times = {j: last[j] + self.every[j] if j in last else self.began + self.delay[j] for j in self.jobs}
        return sorted((t, j) for j, t in times.items() if t <= now)

    def tick(self, now: datetime) -> list[str]:
        """Run what is due at ``now``, each job once; the names of the jobs that ran."""
        ran = []
        for t, job in self.due(now):
            error = None
            try:
                self.jobs[job](now)
            except Exception as e:  # a job's failure is its own
                error = f"{type(e).__name__}: {e}"
            self._store([(job, t, now, error)])
            ran.append(job)
        return ran

    def start(self, checkpoint: str, seconds: int = 10):
        """A stream that ticks: each batch passes its time on. The stream is only the clock; jobs read what they need."""
        ticks = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load()

        def tick(batch: DataFrame, _: int) -> None:
            at = batch.agg(F.max("timestamp").cast("timestamp_ntz").alias("t")).collect()[0].t
            if at is not None:
                self.tick(at)

        return ticks.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()
