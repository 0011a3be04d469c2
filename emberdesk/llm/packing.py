"""Best-fit packing by bin completion over the histogram of lengths.

Documents of one length are interchangeable, so the search runs on the counts of at most ``capacity``
lengths, whatever the corpus holds, and its answer (patterns of lengths and how often each is used)
has at most as many patterns as lengths plus the search's last steps. Documents then take the places of
the patterns by their rank within their length. Nothing but the histogram reaches the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_of, schema_of, slices, stored, texts, vocabulary
from .encode import CachedEncoder, kept_for_worker

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"

#: Nodes that the search may open beyond the best-fit incumbent, and fillings it tries at each.
SEARCH_NODES, SEARCH_WIDTH = 20_000, 6

#: Rows of one length that are ranked in one task, about.
ROWS_PER_SALT = 20_000


class _Lengths:
    """Counts by length, with the largest length present at or below each room."""

    def __init__(self, counts: np.ndarray):
        self.n = counts.copy()
        self._table()

    def _table(self) -> None:
        at = np.where(self.n > 0, np.arange(len(self.n)), 0)
        self.below = np.maximum.accumulate(at)

    def take(self, pattern: dict[int, int], times: int) -> None:
        gone = False
        for length, copies in pattern.items():
            was = self.n[length]
            self.n[length] = was - copies * times
            gone |= (was > 0) != (self.n[length] > 0)
        if gone:
            self._table()

    def fits(self, pattern: dict[int, int]) -> int:
        return min(int(self.n[k]) // c for k, c in pattern.items())


def _fillings(lengths: _Lengths, largest: int, capacity: int, width: int, most_waste: int) -> list[tuple[int, dict[int, int]]]:
    """The ``width`` least wasteful undominated fillings around ``largest``, fewest documents first among equals.

    A filling is dominated if another holds, place for place, documents at least as long: of single
    documents only the longest that fits remains, of pairs the best partner for each longer one, of triples
    the best third for each pair; larger ones remain only if they leave less waste than every filling of
    fewer documents. Those that waste more than ``most_waste`` can't lead to a better packing.
    """
    room = capacity - largest
    lengths.take({largest: 1}, 1)
    below, n = lengths.below, lengths.n
    one = int(below[room])
    found: list[tuple[int, tuple[int, ...]]] = [(room - one, (one,) if one else ())]
    if one and found[0][0]:
        a = np.flatnonzero(n[: one + 1] > 0)[::-1]
        a = a[a > 0]
        b = below[np.minimum(room - a, a)]
        b = np.where((b == a) & (n[a] < 2), below[np.maximum(b - 1, 0)], b)
        waste = room - a - b
        for i in np.argsort(waste, kind="stable")[:width]:
            if b[i] and waste[i] < found[0][0]:
                found.append((int(waste[i]), (int(a[i]), int(b[i]))))
        best = min(found)[0]
        if best:
            for x in a[a * 3 >= room - best].tolist():  # the longest of three fills a third of what they fill
                left = room - x
                c = a[(a <= x) & (a < left) & (a * 2 >= left - best)]
                if not len(c):
                    continue
                d = below[np.minimum(left - c, c)]
                d = np.where((d == c) & (n[d] < 2 + (c == x)), below[np.maximum(d - 1, 0)], d)
                w = left - c - d
                i = int(np.argmin(w))
                t = (x, int(c[i]), int(d[i]))
                if t[2] and w[i] < best and all(n[k] >= t.count(k) for k in t):
                    found.append((int(w[i]), t))
                    if not w[i]:
                        break
    lengths.take({largest: 1}, -1)
    found.sort(key=lambda f: (f[0], len(f[1])))
    out = []
    for waste, items in found[:width]:
        pattern = {largest: 1}
        for k in items:
            pattern[k] = pattern.get(k, 0) + 1
        if lengths.fits(pattern) and (waste <= most_waste or not out):
            out.append((waste, pattern))
    return out


def _closed(lengths: _Lengths, pattern: dict[int, int], waste: int) -> tuple[dict[int, int], int]:
    """Put the longest documents that still fit into what a filling leaves (best fit)."""
    pattern = dict(pattern)
    while waste > 0:
        k = int(lengths.below[waste])
        while k and lengths.n[k] <= pattern.get(k, 0):
            k = int(lengths.below[k - 1])
        if not k:
            break
        pattern[k] = pattern.get(k, 0) + 1
        waste -= k
    return pattern, waste


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """No packing has fewer bins: documents over half a bin stand alone, and what fits beside none of the
    longer ones needs room of its own; the best such argument over all lengths."""
    counts = np.asarray(counts, dtype=np.int64)
    size = np.arange(len(counts))
    total, n = np.cumsum(counts * size), np.cumsum(counts)
    half, best = capacity // 2, int(-(-total[-1] // capacity))
    for k in range(half + 1):
        alone = int(n[capacity] - n[capacity - k])  # longer than capacity - k: nothing of k or more fits beside
        middle = int(n[capacity - k] - n[half]) if capacity - k > half else 0
        spare = middle * capacity - int(total[capacity - k] - total[half]) if capacity - k > half else 0
        small = int(total[half] - (total[k - 1] if k else 0))
        best = max(best, alone + middle + max(0, -(-(small - spare) // capacity)))
    return best


def pack_lengths(counts: np.ndarray, capacity: int, nodes: int = SEARCH_NODES, width: int = SEARCH_WIDTH) -> list[tuple[dict[int, int], int]]:
    """Patterns ``({length: copies}, times)`` that hold every document of the histogram ``counts``.

    ``counts[k]`` documents have length ``k``. The first incumbent is best fit, which completes each
    bin with the longest documents that fit. Bin completion then branches over the undominated
    fillings around the longest document left, each as often as it fits, then half as often, down to once,
    and drops a branch when the waste it has made rules out fewer bins than the incumbent; it ends at the
    lower bound or after ``nodes`` nodes of ``width`` fillings.
    """
    total = int((counts * np.arange(len(counts))).sum())
    if not total:
        return []
    bound = lower_bound(counts, capacity)

    def run(choose) -> tuple[list[tuple[dict[int, int], int]], int]:
        lengths, out, bins = _Lengths(counts), [], 0
        while largest := int(lengths.below[-1]):
            pattern = choose(lengths, largest)
            times = lengths.fits(pattern)
            lengths.take(pattern, times)
            out.append((pattern, times))
            bins += times
        return out, bins

    best, best_bins = run(lambda s, k: _closed(s, {k: 1}, capacity - k)[0])
    if best_bins == bound:
        return best

    # Depth first, least waste first: the stack holds, for each open node, what it may still try.
    lengths, path, bins, wasted = _Lengths(counts), [], 0, 0
    stack: list[list] = []

    def open_node() -> None:
        largest, spare = int(lengths.below[-1]), (best_bins - 1) * capacity - total - wasted
        stack.append([(*_closed(lengths, p, w), None) for w, p in _fillings(lengths, largest, capacity, width, spare)][::-1])

    open_node()
    while stack and nodes > 0:
        if not stack[-1]:
            stack.pop()
            if path:
                pattern, times, waste = path.pop()
                lengths.take(pattern, -times)
                bins -= times
                wasted -= waste * times
            continue
        nodes -= 1
        pattern, waste, most = stack[-1].pop()
        times = lengths.fits(pattern) if most is None else most
        spare = (best_bins - 1) * capacity - total  # waste that a better packing may have
        if waste and wasted + waste * times > spare:
            times = max(0, (spare - wasted) // waste)
        if not times:
            continue
        if times > 1:
            stack[-1].append((pattern, waste, times // 2))
        lengths.take(pattern, times)
        path.append((pattern, times, waste))
        bins += times
        wasted += waste * times
        if not lengths.below[-1]:
            if bins < best_bins:
                best, best_bins = [(p, t) for p, t, _ in path], bins
                if best_bins == bound:
                    break
            stack.append([])
        else:
            open_node()
    return best


def _piece_batches(spec: str, capacity: int, end_id: int):
    out = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = kept_for_worker(CachedEncoder, spec)
        end = np.asarray([end_id], dtype="<u4").tobytes()
        for b in slices(batches):
            rows: list[list] = [[], [], [], [], []]
            for doc, own in zip(b.column(0).to_pylist(), enc.encode_all(b.column(1).to_pylist()), strict=True):
                ids = memoryview(own.astype("<u4").tobytes() + end)
                n = len(ids) // 4
                cut = (n - 1) % capacity + 1
                for i, (lo, hi) in enumerate(zip([0, *range(cut, n, capacity)], [cut, *range(cut + capacity, n + 1, capacity)], strict=True)):
                    for r, v in zip(rows, (doc, i, lo, hi - lo, zlib.crc32(ids[4 * lo : 4 * hi])), strict=True):
                        r.append(v)
            yield batch_of(out, rows)

    return run


def _place_batches(plan: dict[int, tuple[np.ndarray, ...]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            seq, off = np.empty(len(rank), dtype=np.int64), np.empty(len(rank), dtype=np.int64)
            for k in np.unique(length):
                at = np.flatnonzero(length == k)
                first, base, offset, copies = plan[int(k)]
                i = np.searchsorted(first, rank[at], side="right") - 1
                within = rank[at] - first[i]
                seq[at] = base[i] + within // copies[i]
                off[at] = offset[i] + within % copies[i] * k
            kept = [b.column(b.schema.get_field_index(c)) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(seq), pa.array(off)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, capacity: int = 2048, end_id: int = 0, vocab_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", nodes: int = SEARCH_NODES, width: int = SEARCH_WIDTH) -> DataFrame:
    """Pack every document into sequences of at most ``capacity`` tokens.

    Every piece is packed whatever the search finds; ``nodes`` and ``width`` bound only the search for
    packings with fewer sequences than best fit. ``gap`` tells how far a result is from the least possible.

    Null or empty text: a piece with the end token alone. Longer documents are cut into full pieces
    behind a shorter first one. Repeated rows and repeated ids are packed once for each row; a null id
    stays null. An empty table gives no rows. Columns of the input other than the two named are not
    read, so their names can't clash.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    pieces = stored(texts(docs, id_col, text_col).mapInArrow(_piece_batches(vocabulary(vocab_path), capacity, end_id), schema_of(PIECES)), "pieces")
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[length] = n
    plan: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence, used = 0, np.zeros(capacity + 1, dtype=np.int64)
    for pattern, times in pack_lengths(counts, capacity, nodes, width):
        offset = 0
        for k, copies in sorted(pattern.items(), reverse=True):
            plan.setdefault(k, []).append((int(used[k]), sequence, offset, copies))
            used[k] += copies * times
            offset += k * copies
        sequence += times
    table = {k: tuple(np.array(c, dtype=np.int64) for c in zip(*v, strict=True)) for k, v in plan.items()}

    # A rank within the length, without one task for a length: ranks within salts, after the salts before.
    salts = int(counts.sum()) // ROWS_PER_SALT + 1
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("r", F.row_number().over(order)).join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("r") - 1)
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(_place_batches(table), schema_of(PACKED))


def gap(packed: DataFrame, capacity: int = 2048) -> tuple[int, int]:
    """The number of sequences of a packing, and a number that no packing of its pieces is below."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in packed.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[length] = n
    return packed.agg(F.countDistinct("sequence_id")).collect()[0][0], lower_bound(counts, capacity)
