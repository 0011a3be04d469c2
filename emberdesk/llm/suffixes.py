"""Repeated byte strings by suffix arrays, built by two-stage sorting.

Stage one sorts only the suffixes that are smaller than their successors. Stage two reads the buckets of
first bytes in order: every other suffix is larger than its successor, so its place is induced when
its successor is read. Common prefixes of neighbours then show which windows repeat.

The corpus is cut by ``windows``: only stretches of text that may repeat reach a suffix array, in blocks
of bounded size, so the arrays stay small whatever the corpus holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, schema_of, slices, texts
from .windows import MIX, NULL_ID, SLICE_BYTES, Units, covered, keyed_rows, marks_of, mixed, repeats

WINDOW_BYTES = 200
GRAM = 16
#: Bytes that the direct sort skips at once while a group of suffixes agrees on them.
SKIP = 64
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def words_at(data: np.ndarray, dtype: str = ">u8") -> np.ndarray:
    """The eight bytes at each place of ``data`` as one number; ``data`` ends with at least seven spare bytes."""
    return np.ndarray((len(data) - 7,), dtype=dtype, buffer=data, strides=(1,)).astype(np.uint64)


def _skip_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``SKIP`` bytes at each place."""
    h = mixed(words_at(data, "<u8") * MIX[0])
    size = 8
    while size < SKIP:
        h = mixed(h[: len(h) - size] * MIX[1] + h[size:])
        size *= 2
    return h


def sort_smaller(data: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Suffix places ``at`` sorted directly by their first ``depth`` bytes.

    Groups of equal prefixes are split by eight bytes at a time; a group that agrees on ``SKIP`` bytes
    passes over them at once. ``data`` ends with at least ``depth + SKIP + 8`` spare bytes.
    """
    eight, skip = words_at(data), _skip_hashes(data)
    order = at[np.argsort(eight[at], kind="stable")]
    first = eight[order]
    head = np.ones(len(order), dtype=bool)
    head[1:] = first[1:] != first[:-1]
    where = np.arange(len(order))  # places in ``order`` that still share a prefix
    known = np.full(len(order), 8)  # bytes that the group there agrees on
    while True:
        group = np.cumsum(head) - 1
        tied = np.bincount(group, minlength=1)[group] > 1 if len(group) else np.zeros(0, dtype=bool)
        tied &= known < depth
        where, known = where[tied], known[tied]
        if not len(where):
            return order
        head = head[tied]
        starts = np.flatnonzero(head)
        group = np.cumsum(head) - 1
        own = order[where]
        far = skip[own + known]
        agrees = (np.minimum.reduceat(far, starts) == np.maximum.reduceat(far, starts))[group]
        rest = np.flatnonzero(~agrees)
        if len(rest):
            near, g = eight[own[rest] + known[rest]], group[rest]
            first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            differs = np.repeat(np.minimum.reduceat(near, first) != np.maximum.reduceat(near, first), np.diff(np.append(first, len(g))))
            known[rest] += 8
            split = rest[differs]
            if len(split):
                sub, g = near[differs], g[differs]
                turn = np.lexsort((sub, g))
                own[split] = own[split][turn]
                sub, g = sub[turn], g[turn]
                order[where[split]] = own[split]
                head[split[1:]] |= (sub[1:] != sub[:-1]) & (g[1:] == g[:-1])
        known[agrees] += SKIP


def suffix_array(data: np.ndarray, size: int, depth: int) -> np.ndarray:
    """Places 0 to ``size`` sorted by the ``depth`` bytes there; ``data[size:]`` are spare zero bytes."""
    t = data[:size]
    change = np.flatnonzero(t[1:] != t[:-1])  # last place of each run of equal bytes but the last
    up = np.append(t[change + 1] > t[change], False)
    smaller = np.repeat(up, np.diff(np.concatenate([[-1], change, [size - 1]])))
    own = np.flatnonzero(smaller)
    own = sort_smaller(data, own, depth)
    bucket = np.searchsorted(t[own], np.arange(257)) if len(own) else np.zeros(257, dtype=int)

    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[t[-1]].append(np.array([size - 1]))  # before the end of the text
    out: list[np.ndarray] = []
    for c in range(256):
        parts, now = [], np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, dtype=np.int64)
        while len(now):
            parts.append(now)
            before = now[now > 0] - 1
            now = before[t[before] == c]  # not smaller, as its run of c ends like the successor's
        parts.append(own[bucket[c] : bucket[c + 1]])
        full = np.concatenate(parts)
        waiting[c] = []
        if len(full):
            out.append(full)
            before = full[full > 0] - 1
            before = before[t[before] > c]
            if len(before):
                before = before[np.argsort(t[before], kind="stable")]
                heads = np.flatnonzero(np.append(True, t[before][1:] != t[before][:-1]))
                for a, e in zip(heads, np.append(heads[1:], len(before)), strict=True):
                    waiting[t[before[a]]].append(before[a:e])
    return np.concatenate(out)


def common_prefixes(data: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Bytes that each suffix of ``order`` shares with the next one, counted up to ``depth``."""
    eight, skip = words_at(data), _skip_hashes(data)
    a, b = order[:-1], order[1:]
    lcp = np.zeros(len(a), dtype=np.int64)
    going = np.arange(len(a))
    for d in range(0, depth - SKIP + 1, SKIP):
        going = going[skip[a[going] + d] == skip[b[going] + d]]
        lcp[going] += SKIP
    going = np.arange(len(a))
    for _ in range(0, SKIP, 8):
        x = eight[a[going] + lcp[going]] ^ eight[b[going] + lcp[going]]
        same = x == 0
        lcp[going[same]] += 8
        differ = np.flatnonzero(~same)
        if len(differ):
            v = x[differ]
            lead = np.zeros(len(v), dtype=np.int64)
            for k in range(1, 8):
                lead += v < np.uint64(1) << np.uint64(64 - 8 * k)
            lcp[going[differ]] += lead
        going = going[same]
        going = going[lcp[going] < depth]
        if not len(going):
            break
    return np.minimum(lcp, depth)


def repeated_windows(contents: list[bytes], window: int) -> list[np.ndarray]:
    """For each content, whether the window at each place also starts elsewhere in any of them."""
    joined = np.frombuffer(b"\xff".join([*contents, b""]), dtype=np.uint8) + np.uint8(1)  # the byte between is 0; UTF-8 has no 0xff
    size = len(joined)
    data = np.concatenate([joined, np.zeros(window + SKIP + 16, dtype=np.uint8)])
    order = suffix_array(data, size, window)
    lcp = common_prefixes(data, order, window)
    same = np.flatnonzero(lcp >= window)
    twice = np.zeros(size, dtype=bool)
    twice[order[same]] = True
    twice[order[same + 1]] = True
    out, at = [], 0
    for c in contents:
        out.append(twice[at : at + max(0, len(c) - window + 1)])
        at += len(c) + 1
    return out


def _may_repeat(contents: list[bytes], window: int) -> list[tuple[int, int, int]]:
    """``content, first window, windows`` of the parts of contents whose windows may start elsewhere among them.

    All windows of a content hold its least gram, and reach at least half of what is left of a window to the
    left or to the right of it. Equal windows do so on the same side, and agree on the bytes there: windows
    whose side no other content has are in one place only.
    """
    joined = np.frombuffer(b"\xff".join([*contents, b""]), dtype=np.uint8)
    grams, half = _byte_grams(joined), (window - GRAM + 1) // 2
    seen: dict[tuple[bool, bytes], int] = {}
    parts, start = [], 0
    for i, c in enumerate(contents):
        n = len(c) - window + 1
        at = int(grams[start : start + len(c) - GRAM + 1].argmin())
        start += len(c) + 1
        middle = min(max(at - half + 1, 0), n)  # windows before it reach ``half`` bytes left of the gram
        for first, last, side in ((0, middle, (True, c[max(0, at - half) : at + GRAM])), (middle, n, (False, c[at : at - half + 1 + window]))):
            if last > first:
                parts.append((i, first, last - first, side))
                seen[side] = seen.get(side, 0) + 1
    return [p[:3] for p in parts if seen[p[3]] > 1]


def _compared(contents: list[bytes], window: int) -> list[np.ndarray]:
    """``repeated_windows`` of contents of whole groups, with suffix arrays of what ``_may_repeat``."""
    parts = _may_repeat(contents, window)
    flags = [np.zeros(len(c) - window + 1, dtype=bool) for c in contents]
    found = repeated_windows([contents[i][a : a + n + window - 1] for i, a, n in parts], window) if parts else []
    for (i, a, n), f in zip(parts, found, strict=True):
        flags[i][a : a + n] = f
    return flags


def _byte_units(held: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(held), dtype=np.uint8), np.cumsum([len(t) for t in held])


def _byte_grams(units: np.ndarray) -> np.ndarray:
    """Hashes of ``GRAM`` bytes at each place; those that reach past the end are never in a whole window."""
    data = np.concatenate([units, np.zeros(GRAM, dtype=np.uint8)])
    eight = words_at(data, "<u8")
    n = len(units)
    return mixed(mixed(eight[:n] * MIX[0]) + eight[8 : n + 8] * MIX[1])[: max(0, n - GRAM + 1)]


def byte_units(window: int) -> Units:
    return Units(window=window, gram=GRAM, longest=1024, load=_byte_units, grams=_byte_grams, blocks=4)


def _removal_batches(window: int):
    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, SLICE_BYTES):
            rows: list[list] = [[], [], [], [], []]
            for d, text, spans in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                data = np.frombuffer(text.encode(), dtype=np.uint8)
                gone = covered(spans, len(data), window) if spans else np.zeros(len(data), dtype=bool)
                n_spans = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
                for r, v in zip(rows, (None if d == NULL_ID else d, len(data), int(gone.sum()), n_spans, hashlib.sha256(data[~gone].tobytes()).hexdigest()), strict=True):
                    r.append(v)
            yield batch_of(out, rows)

    return run


def _kept_batches(window: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, SLICE_BYTES):
        rows: list[list] = [[], []]
        for d, text, spans in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            data = np.frombuffer(text.encode(), dtype=np.uint8)
            kept = data[~covered(spans, len(data), window)].tobytes() if spans else data.tobytes()
            rows[0].append(None if d == NULL_ID else d)
            rows[1].append(kept)
        yield batch_of(pa.schema([("doc_id", pa.int64()), ("kept", pa.binary())]), rows)


def _with_spans(docs: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    if window < GRAM:
        raise ValueError(f"a window has at least {GRAM} bytes")
    keyed = keyed_rows(texts(docs, id_col, text_col))

    def compare(contents: list[bytes], firsts: np.ndarray) -> list[list[int]]:
        return [marks_of(f) for f in _compared(contents, window)]

    spans = repeats(keyed, byte_units(window), compare, "suffixes", first_stays=False)
    return keyed.join(spans, ["d", "th"], "left").select("d", "text", "spans")


def dedup(docs: DataFrame, window: int = WINDOW_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digest of every document without the bytes of windows that also start elsewhere, all copies alike.

    Texts are UTF-8 bytes; null is empty. Matches stay within a document; a repeated row counts as
    another place; a null id stays null; an empty table gives no rows. Only the two columns named are read.
    """
    return _with_spans(docs, window, id_col, text_col).mapInArrow(_removal_batches(window), schema_of(RESULT))


def kept_bytes(docs: DataFrame, window: int = WINDOW_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, kept``: the bytes that stay; a cut may fall inside a character."""
    return _with_spans(docs, window, id_col, text_col).mapInArrow(lambda it: _kept_batches(window, it), "doc_id long, kept binary")
