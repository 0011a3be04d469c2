"""Sources of our own over files that a collector lands: commit frames by offset, and paged edge lists by cursor.

Files are read where the tasks run, by any path that Arrow's file systems know (local, HDFS, object stores).
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .commits import POST, REPOST

FRAMES = "file string, line long, time_us long, did string, collection string, operation string, value string"
FRAME_BATCH = pa.schema([("file", pa.string()), ("line", pa.int64()), ("time_us", pa.int64()), ("did", pa.string()), ("collection", pa.string()), ("operation", pa.string()), ("value", pa.string())])
EDGES = "edge string, did string, handle string"
BATCH_LINES = 10_000


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def landed_files(path: str) -> list[str]:
    """Names of the files in a folder, in order; what begins with a dot or an underscore is none yet."""
    from pyarrow import fs

    system, at = _opened(path)
    found = system.get_file_info(fs.FileSelector(at, recursive=False, allow_not_found=True))
    return sorted(f.base_name for f in found if f.is_file and not f.base_name.startswith((".", "_")))


def land(spark: SparkSession, folders: list[str], path: str) -> None:
    """Move the files of ``folders`` into ``path``, those of one folder before the next one's: names and times tell that order."""
    to = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs, now = to(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), int(time.time() * 1000)
    fs.mkdirs(to(path))
    for k, folder in enumerate(folders):
        if not fs.exists(to(folder)):
            continue  # a folder without rows
        for f in fs.listStatus(to(folder)):
            name = f.getPath().getName()
            if f.isFile() and not name.startswith((".", "_")):
                if not fs.rename(f.getPath(), to(f"{path}/{k:03}-{name}")):
                    raise OSError(f"{f.getPath()} can't be moved to {path}")
                fs.setTimes(to(f"{path}/{k:03}-{name}"), now - 1000 * (len(folders) - k), -1)


class FramePart(InputPartition):
    """One landed file."""

    def __init__(self, name: str):
        super().__init__(name)
        self.name = name


class _Frames:
    """Lines of landed files as frames: those of other collections, and those that can't be read, are left out."""

    def __init__(self, options: dict):
        self.path, self.after = options["path"].rstrip("/"), options.get("after", "")
        self.collections = set(filter(None, options.get("collections", f"{POST},{REPOST}").split(",")))

    def names(self, after: str, upto: str | None = None) -> list[str]:
        return [n for n in landed_files(self.path) if n > after and (upto is None or n <= upto)]

    def read(self, partition: FramePart | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file has landed
            return
        system, at = _opened(f"{self.path}/{partition.name}")
        rows: list[tuple] = []
        with system.open_input_stream(at) as stream:
            held, line = b"", 0
            while True:
                block = stream.read(1 << 20)
                lines = (held + block).split(b"\n")
                held = lines.pop() if block else b""
                for raw in lines:
                    row = self._frame(partition.name, line, raw)
                    line += 1
                    if row:
                        rows.append(row)
                    if len(rows) >= BATCH_LINES:
                        yield self._batch(rows)
                        rows = []
                if not block:
                    break
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), FRAME_BATCH, strict=True)], schema=FRAME_BATCH)

    def _frame(self, name: str, line: int, raw: bytes) -> tuple | None:
        try:
            text = raw.decode()
            js = json.loads(text)
            commit = js.get("commit") or {}
            if js.get("kind") != "commit" or commit.get("collection") not in self.collections:
                return None
            at = js.get("time_us")
            return name, line, at if isinstance(at, int) else None, js.get("did"), commit["collection"], commit.get("operation"), text
        except (ValueError, AttributeError):
            return None


class FrameReader(_Frames, DataSourceReader):
    def partitions(self) -> list[FramePart]:
        return [FramePart(n) for n in self.names(self.after)]


class FrameStream(_Frames, DataSourceStreamReader):
    """Offsets name the last file taken, and how many had landed up to it; a file is read by one task."""

    def initialOffset(self) -> dict:
        return {"last": self.after, "files": len([n for n in landed_files(self.path) if n <= self.after])}

    def latestOffset(self) -> dict:
        names = landed_files(self.path)
        return {"last": max([self.after, *names]), "files": len(names)}

    def partitions(self, start: dict, end: dict) -> list[FramePart]:
        return [FramePart(n) for n in self.names(start["last"], end["last"])]

    def commit(self, end: dict) -> None:
        pass


class FrameSource(DataSource):
    """``format("frames")``: options ``path``, ``collections`` (comma-joined) and ``after`` (the file to begin behind)."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema) -> DataSourceReader:
        return FrameReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FrameStream(self.options)


class EdgePart(InputPartition):
    def __init__(self, edge: str):
        super().__init__(edge)
        self.edge = edge


class EdgeReader(DataSourceReader):
    """Pages of an edge list, each naming the next: one task follows the cursors of one list."""

    def __init__(self, options: dict):
        self.path, self.edges = options["path"].rstrip("/"), options.get("edges", "follows,followers").split(",")

    def partitions(self) -> list[EdgePart]:
        return [EdgePart(e) for e in self.edges]

    def read(self, partition: EdgePart) -> Iterator[tuple]:
        cursor, seen = "start", set()
        while cursor and cursor not in seen:
            seen.add(cursor)
            system, at = _opened(f"{self.path}/{partition.edge}/{cursor}.json")
            with system.open_input_stream(at) as stream:
                page = json.loads(stream.read())
            for who in page.get(partition.edge, []):
                yield partition.edge, who["did"], who.get("handle") or ""
            cursor = page.get("cursor")


class EdgeSource(DataSource):
    """``format("edge_pages")``: options ``path`` and ``edges``; a list's first page is ``<edge>/start.json``, the next ``<edge>/<cursor>.json``."""

    @classmethod
    def name(cls) -> str:
        return "edge_pages"

    def schema(self) -> str:
        return EDGES

    def reader(self, schema) -> DataSourceReader:
        return EdgeReader(self.options)


def register(spark: SparkSession) -> None:
    """Make both sources known to a session."""
    spark.dataSource.register(FrameSource)
    spark.dataSource.register(EdgeSource)
