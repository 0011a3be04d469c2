"""Bringing equal windows of a corpus together without moving every window.

A window is W consecutive units (bytes, or words) of one document. The least hash of the k-grams inside a
window is the same wherever the window occurs, so it says where to look for equal windows. Neighbouring
windows mostly share it: a run of them with the same leftmost least gram is one *stretch*, about W / 2
windows long. Every window lies in exactly one stretch, and no two windows of a stretch are equal. Stretches with equal bytes are counted by a hash of these; only stretches
whose key has several contents need their bytes compared, and each content is compared once, whatever
the number of its occurrences.

``repeats`` does this for any unit. Its tables:

* ``stretches``: key, content, document and place of each stretch;
* ``places``: those whose key occurs more than once;
* ``live``: contents that occur twice or share their key, with the number and the first of the
  occurrences;
* marks: for contested contents, the runs of windows that the comparing method found;
* spans: for each document, the runs of windows to remove.

Only contents of one key are compared together, each once. A key with more than ``HOT_CONTENTS`` of them
is split: all windows of a stretch hold its least gram, and reach at least half of what is left of a
window to the left or to the right of it. The windows of each side go to a group named by those
units as well, and so on, two cuts deeper for each doubling of the contents. A part that is cut down to
one window is known by that window's hash: it needs no comparison, and its occurrences are counted with
map-side combining. So the groups that are compared hold a bounded number of contents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_of, passing, schema_of, slices, stored

STRETCHES = "d long, th long, start int, n int, key long, content long"
ROWS = "d long, th long, text string"
NULL_ID = -(1 << 63)

#: Bytes of documents in one numpy pass, and of contents in one comparison.
SLICE_BYTES = 1 << 20
BLOCK_BYTES = 1 << 18
#: Contents of one key that are compared as one group; more are split by the units beside the gram.
HOT_CONTENTS = 500

MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93))


@dataclass(frozen=True)
class Units:
    """How texts become units, and how contents of them are compared."""

    window: int
    gram: int
    longest: int  # windows in one stretch
    load: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]  # texts -> units of all texts, ends of each
    grams: Callable[[np.ndarray], np.ndarray]
    blocks: int = 1  # times ``BLOCK_BYTES`` of contents that are compared at once


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * MIX[3]
    return x ^ (x >> np.uint64(29))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling."""
    size, least = 1, values
    while size * 2 <= width:
        least = np.minimum(least[: len(least) - size], least[size:])
        size *= 2
    rest = width - size
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def cut_stretches(units: np.ndarray, ends: np.ndarray, how: Units) -> tuple[np.ndarray, ...]:
    """``document, start, windows, key`` of the stretches of all documents that ``units`` holds."""
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    wide = ends - starts >= how.window
    none = np.zeros(0, dtype=np.int64)
    if not wide.any():
        return none, none, none, np.zeros(0, dtype=np.uint64)
    width = how.window - how.gram + 1
    grams = how.grams(units)
    least = sliding_min(grams, width)  # least[i]: of the window at i
    lo, hi = starts[wide], ends[wide] - how.window + 1  # windows of a document: lo up to hi
    valid = np.zeros(len(least) + 1, dtype=np.int8)
    np.add.at(valid, lo, 1)
    np.add.at(valid, hi, -1)
    valid = np.cumsum(valid[:-1]).astype(bool)
    new = np.ones(len(least), dtype=bool)
    # The leftmost least gram moves when a smaller one enters, or when it was the window's first.
    new[1:] = (least[1:] != least[:-1]) | (grams[: len(least) - 1] == least[:-1])
    new[lo] = True
    at = np.flatnonzero(new & valid)
    doc = np.searchsorted(lo, at, side="right") - 1
    stop = np.minimum(np.append(at[1:], np.iinfo(np.int64).max), hi[doc])
    n = stop - at
    parts = -(-n // how.longest)
    if (parts > 1).any():
        step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        at, stop, doc = np.repeat(at, parts) + step * how.longest, np.repeat(stop, parts), np.repeat(doc, parts)
        n = np.minimum(stop - at, how.longest)
    return np.flatnonzero(wide)[doc], at - lo[doc], n, least[at]


def _stretch_batches(how: Units):
    out = pa.schema([("d", pa.int64()), ("th", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("key", pa.int64()), ("content", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for b in slices(batches, SLICE_BYTES):
            units, ends = how.load([t.encode() for t in b.column(2).to_pylist()])
            doc, start, n, key = cut_stretches(units, ends, how)
            if not len(doc):
                continue
            first = np.concatenate([[0], ends[:-1]])[doc] + start
            size, data = units.itemsize, memoryview(np.ascontiguousarray(units)).cast("B")
            content = np.fromiter((digest(data[a:e]) for a, e in zip((first * size).tolist(), ((first + n + how.window - 1) * size).tolist(), strict=True)), dtype=np.uint64, count=len(n))
            d, th = (b.column(i).to_numpy(zero_copy_only=False)[doc] for i in (0, 1))
            yield batch_of(out, [d, th, start.astype(np.int32), n.astype(np.int32), key.view(np.int64), content.view(np.int64)])

    return run


def keyed_rows(rows: DataFrame) -> DataFrame:
    """``d, th, text``: a row is known by its id, and where ids repeat, by a hash of its text as well."""
    own = rows.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("d"), "text")
    repeated = own.groupBy("d").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    return own.select("d", (F.xxhash64("text") if repeated else F.lit(0).cast("long")).alias("th"), "text")


def parts_of(units: np.ndarray, windows: int, how: Units, depth: int) -> Iterator[tuple[int, int, bytes]]:
    """``first window, windows, fixed units`` of the parts that a content's windows fall into.

    Windows are equal only if they fall into parts with equal fixed units: which part is theirs follows
    from where the least gram stands in them.
    """
    at = int(how.grams(units).argmin())
    todo = [(0, windows, at, at + how.gram, depth)]
    while todo:
        first, last, a, b, more = todo.pop()
        half = (how.window - (b - a) + 1) // 2
        if not more or half < 1:
            yield first, last - first, units[a:b].tobytes()
            continue
        middle = min(max(a - half + 1, first), last)  # windows before it reach ``half`` units left of a
        if middle > first:
            todo.append((first, middle, a - half, b, more - 1))
        if last > middle:
            todo.append((middle, last, a, a - half + 1 + how.window, more - 1))


def _cut_batches(how: Units):
    out = pa.schema([("sub", pa.int64()), ("key", pa.int64()), ("content", pa.int64()), ("off", pa.int32()), ("d", pa.int64()), ("start", pa.int32()), ("th", pa.int64()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, SLICE_BYTES):
            units, ends = how.load([t.encode() for t in b.column(2).to_pylist()])
            starts, cols = np.concatenate([[0], ends[:-1]]), [[] for _ in range(8)]
            for s, d, th, wanted in zip(starts.tolist(), b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
                for w in wanted:
                    a = s + w["start"]
                    own = units[a : a + w["n"] + how.window - 1]
                    depth = 2 * (w["n_contents"] // HOT_CONTENTS).bit_length()
                    whole = how.window * own.itemsize
                    if depth:
                        # Fixed units as long as a window are all of the part, which then has no other data.
                        parts = [(xxhash.xxh3_64_intdigest(fixed) - (1 << 63), off, None if len(fixed) == whole else own[off : off + n + how.window - 1].tobytes()) for off, n, fixed in parts_of(own, w["n"], how, depth)]
                    else:
                        parts = [(w["key"], 0, own.tobytes())]
                    for sub, off, data in parts:
                        for c, v in zip(cols, (sub, w["key"], w["content"], off, d, w["start"] + off, th, data), strict=True):
                            c.append(v)
            yield batch_of(out, cols)

    return run


CONTENTS = "sub long, key long, content long, off int, d long, start int, th long, data binary"
MARKS = "key long, content long, marks array<int>"


def _mark_batches(compare, blocks: int = 1):
    out = pa.schema([("key", pa.int64()), ("content", pa.int64()), ("marks", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush():
            marks = compare([r[7] for r in held], np.array([r[4:7] for r in held], dtype=np.int64))
            rows = [(r[1], r[2], [x + r[3] * (k % 2 == 0) for k, x in enumerate(m)]) for r, m in zip(held, marks, strict=True) if m]
            return batch_of(out, list(zip(*rows, strict=True)) or [[], [], []])

        for b in slices(batches):
            for row in zip(*(b.column(i).to_pylist() for i in range(8)), strict=True):
                if held and held[-1][0] != row[0] and size >= blocks * BLOCK_BYTES:
                    yield flush()
                    held, size = [], 0
                if held and held[-1][:4] == row[:4]:
                    continue  # the row was in the table twice
                held.append(row)
                size += len(row[7])
        if held:
            yield flush()

    return run


def _single_marks(cut: DataFrame, name: str, first_stays: bool) -> DataFrame:
    """Marks of the parts of one window: those that occur in several places, with ``first_stays`` but the first."""
    rows = cut.select("key", "sub", "content", "off", F.struct("d", "start", "th").alias("place"))
    several = rows.groupBy("key", "sub").agg(F.min("place").alias("least"), F.max("place").alias("most")).where("least != most")
    # Stored, as in ``repeats``: one row for each window, so that a frequent one can be split.
    both = rows.join(stored(several.select("key", "sub", "least"), f"{name}-singles"), ["key", "sub"])
    both = both.where("place != least") if first_stays else both
    return both.select("key", "content", F.array(F.col("off"), F.lit(1)).alias("marks"))


def repeats(keyed: DataFrame, how: Units, compare, name: str, first_stays: bool) -> DataFrame:
    """``d, th, spans`` for the keyed rows with windows to remove; spans are ``start, windows`` pairs in order.

    ``compare(contents, firsts)`` gives, for contents of some whole groups and the first place of each, the
    runs of windows (``offset, count, ...``) that also start elsewhere among them, or with ``first_stays``
    those that start earlier.
    """
    with passing(keyed.sparkSession, keep=(f"{name}-places",)):
        # Most keys have one stretch, and nothing to do with the rest: they are left out before anything wide is shuffled.
        every = stored(keyed.mapInArrow(_stretch_batches(how), schema_of(STRETCHES)), f"{name}-stretches")
        keys = stored(every.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("key"), f"{name}-keys")
        found = stored(every.join(keys, "key").select(*every.columns), f"{name}-places")
    with passing(keyed.sparkSession, keep=(f"{name}-judged",)):
        contents = found.groupBy("key", "content").agg(F.count(F.lit(1)).alias("n_occ"), F.min(F.struct("d", "start", "th")).alias("first"), F.first("n").alias("n"))
        counted = contents.withColumn("n_contents", F.count(F.lit(1)).over(Window.partitionBy("key")))
        live = stored(counted.where("n_contents > 1 or n_occ > 1"), f"{name}-live")

        wanted = live.where("n_contents > 1").groupBy(F.col("first.d").alias("d"), F.col("first.th").alias("th")).agg(F.collect_list(F.struct(F.col("first.start").alias("start"), "n", "key", "content", "n_contents")).alias("wanted"))
        cut = keyed.join(wanted, ["d", "th"]).select("d", "th", "text", "wanted").mapInArrow(_cut_batches(how), schema_of(CONTENTS))
        singles = None
        if live.where(f"n_contents >= {HOT_CONTENTS}").limit(1).count():
            cut = stored(cut, f"{name}-cut")
            singles = _single_marks(cut.where("data is null"), name, first_stays)
            cut = cut.where("data is not null")
        marks = cut.repartition("sub").sortWithinPartitions("sub", "key", "content", "off").mapInArrow(_mark_batches(compare, how.blocks), schema_of(MARKS))
        marks = marks if singles is None else marks.union(singles)
        marks = marks.groupBy("key", "content").agg(F.flatten(F.collect_list("marks")).alias("marks"))  # a content's parts
        judged = live.join(marks, ["key", "content"], "left").where("n_occ > 1 or marks is not null").select("key", "content", "n_occ", "first", "n", "marks")
        # Stored, so that the join below stands between two exchanges and a frequent content can be split.
        judged = stored(judged, f"{name}-judged")
    whole = F.col("n_occ") > 1
    if first_stays:
        whole = whole & ~((F.col("d") == F.col("first.d")) & (F.col("start") == F.col("first.start")) & (F.col("th") == F.col("first.th")))
    runs = F.when(whole, F.array(F.lit(0), F.col("n"))).otherwise(F.coalesce("marks", F.array().cast("array<int>")))
    places = found.drop("n").join(judged, ["key", "content"]).select("d", "th", "start", runs.alias("runs")).where(F.size("runs") > 0)
    return places.groupBy("d", "th").agg(F.collect_list(F.struct("start", "runs")).alias("spans"))


def covered(spans: list[dict], n_units: int, window: int) -> np.ndarray:
    """The units that the windows of ``spans`` cover, as a boolean array."""
    change = np.zeros(n_units + 1, dtype=np.int32)
    for s in spans:
        runs = s["runs"]
        for off, count in zip(runs[::2], runs[1::2], strict=True):
            lo = s["start"] + off
            change[lo] += 1
            change[lo + count - 1 + window] -= 1
    return np.cumsum(change[:-1]) > 0


def marks_of(flags: np.ndarray) -> list[int]:
    """Runs of set flags as ``offset, count, ...``."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    lo, hi = edge[::2], edge[1::2]
    return np.stack([lo, hi - lo], axis=1).ravel().tolist() if len(lo) else []
