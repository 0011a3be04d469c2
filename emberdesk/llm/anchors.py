"""Repeated word sequences by fixed-block anchors; the first occurrence stays.

Reference blocks are the non-overlapping blocks of ten words of a text. Any twenty words hold at least
one of them whole, so a repeat shows as a block that equals some ten words elsewhere. Every rolling ten
words probe the index of blocks; only a block of another place is a hit. A hit is extended to the windows
around it; those whose words stand earlier join with their neighbours to maximal exact repeats, which
are compared word for word with their source and then marked. Windows without a hit are never compared.

``windows`` brings texts that may share a window together, in groups of bounded size; the index, probes
and extensions work on these. Whole stretches that occur several times are known there by their hash:
they are counted, and of all their copies only the first goes through the index.
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

WINDOW_WORDS = 20
GRAM = 3
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"

#: Fixed value: the odd base of the words' polynomial hashes, and its inverse modulo 2 to the 64th.
BASE = 0x5851F42D4C957F2D
_POWERS: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            p = np.full(n, b, dtype=np.uint64)
            p[0] = 1
            _POWERS[i] = np.multiply.accumulate(p)
    return _POWERS


def word_places(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end in UTF-8 bytes; what separates them is ASCII."""
    inside = ~((data == 0x20) | ((data >= 0x09) & (data <= 0x0D)))
    edge = np.flatnonzero(np.diff(np.concatenate([[0], inside.astype(np.int8), [0]])))
    return edge[::2], edge[1::2]


def _word_units(held: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of all texts, and where each text's words end.

    A word's hash is the difference of two prefix sums of a polynomial in its bytes, moved to power 0.
    """
    data = np.frombuffer(b"\n".join([*held, b""]), dtype=np.uint8)
    lo, hi = word_places(data)
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    total[1:] = data
    total[1:] *= MIX[0]
    total[1:] += MIX[2]
    total[1:] *= up[: len(data)]
    np.cumsum(total[1:], out=total[1:])
    units = mixed((total[hi] - total[lo]) * down[lo] + (hi - lo).astype(np.uint64) * MIX[1])
    stops = np.cumsum([len(t) + 1 for t in held])
    return units, np.searchsorted(lo, stops)


def _word_grams(units: np.ndarray) -> np.ndarray:
    n = max(0, len(units) - GRAM + 1)
    return mixed(mixed(units[:n] * MIX[0] + units[1 : n + 1]) * MIX[1] + units[2 : n + 2])


def word_units(window: int) -> Units:
    return Units(window=window, gram=GRAM, longest=256, load=_word_units, grams=_word_grams)


def rolling(units: np.ndarray, width: int) -> np.ndarray:
    """A hash of each ``width`` consecutive units."""
    h, size, parts, at = units, 1, [], 0
    while True:
        if width & size:
            parts.append((at, h))
            at += size
        if size * 2 > width:
            break
        h = mixed(h[: len(h) - size] * MIX[0] + h[size:])
        size *= 2
    n = max(0, len(units) - width + 1)
    out = np.zeros(n, dtype=np.uint64)
    for k, p in parts:
        out = mixed(out * MIX[1] + p[k : k + n])
    return out


def probe_hits(units: np.ndarray, place: np.ndarray, whole: np.ndarray, aligned: np.ndarray, block: int) -> np.ndarray:
    """Whether the rolling block at each unit equals an indexed block of another place.

    ``place`` numbers the places of the units, ``whole`` tells where a block fits, ``aligned`` which of these
    are reference blocks. A place may be held twice, by contents that overlap; it is no other place then.
    """
    probes = rolling(units, block)
    ref = np.flatnonzero(aligned)
    order = ref[np.lexsort((place[ref], probes[ref]))]
    if not len(order):
        return np.zeros(len(probes), dtype=bool)
    key, own = probes[order], place[order]
    head = np.append(True, key[1:] != key[:-1])
    index, lo = key[head], np.flatnonzero(head)
    least, most = own[lo], own[np.append(lo[1:], len(own)) - 1]  # the first and last place of each indexed block
    at = np.minimum(np.searchsorted(index, probes), len(index) - 1)
    mine = place[: len(probes)]
    return whole & (index[at] == probes) & ((least[at] != mine) | (most[at] != mine))


def earlier_windows(contents: list[bytes], firsts: np.ndarray, window: int) -> list[np.ndarray]:
    """For each content (words' hashes), whether the window at each place also starts at an earlier place.

    ``firsts`` has document, start and a tie-breaker of each content's first occurrence.
    """
    block = window // 2
    sizes = np.array([len(c) // 8 for c in contents])
    units = np.frombuffer(b"".join(contents), dtype=np.uint64)
    ends = np.cumsum(sizes)
    begin = ends - sizes
    owner = np.repeat(np.arange(len(sizes)), sizes)
    within = np.arange(len(units)) - begin[owner]
    start = firsts[owner, 1] + within
    turn = np.lexsort((start, firsts[owner, 2], firsts[owner, 0]))  # places in the order of documents
    same = (firsts[owner[turn[1:]]][:, [0, 2]] == firsts[owner[turn[:-1]]][:, [0, 2]]).all(axis=1) & (start[turn[1:]] == start[turn[:-1]])
    place = np.empty(len(units), dtype=np.int64)
    place[turn] = np.cumsum(np.append(False, ~same)[: len(turn)])

    # Index the reference blocks, probe with every rolling block.
    n_blocks = max(0, len(units) - block + 1)
    whole = (within + block <= sizes[owner])[:n_blocks]
    hit = probe_hits(units, place, whole, whole & (start[:n_blocks] % block == 0), block)

    # Extend the hits to the windows around them; each is compared with the first that has its words.
    n = max(0, len(units) - window + 1)
    reach = np.concatenate([[0], np.cumsum(hit)])
    around = (reach[np.arange(n) + window - block + 1] - reach[np.arange(n)] > 0) & (within[:n] + window <= sizes[owner[:n]])
    at = np.flatnonzero(around)
    flags = np.zeros(len(units), dtype=bool)
    if len(at):
        same = rolling(units, window)[at]
        d, s, tie = firsts[owner[at], 0], start[at], firsts[owner[at], 2]
        order = np.lexsort((tie, s, d, same))
        head = np.append(True, same[order][1:] != same[order][:-1])
        source = at[order][np.flatnonzero(head)[np.cumsum(head) - 1]]
        mine = at[order]
        later = place[mine] != place[source]
        for lo, hi, first in maximal_repeats(mine[later], source[later], window):
            if not (units[lo:hi] == units[first : first + hi - lo]).all():
                raise ValueError("two windows share a hash but not their words")
            flags[lo : hi - window + 1] = True
    return [flags[b : b + max(0, k - window + 1)] for b, k in zip(begin.tolist(), sizes.tolist(), strict=True)]


def maximal_repeats(windows: np.ndarray, sources: np.ndarray, window: int) -> list[tuple[int, int, int]]:
    """Neighbouring windows whose sources are neighbours too, joined: first unit, end, first unit of the source."""
    order = np.argsort(windows, kind="stable")
    w, s = windows[order], sources[order]
    head = np.flatnonzero(np.append(True, (np.diff(w) != 1) | (np.diff(s) != 1))[: len(w)])
    last = np.append(head[1:], len(w))[: len(head)] - 1
    return list(zip(w[head].tolist(), (w[last] + window).tolist(), s[head].tolist(), strict=True))


def _removed_words(text: bytes, spans: list[dict] | None, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lo, hi = word_places(np.frombuffer(text, dtype=np.uint8))
    return lo, hi, covered(spans, len(lo), window) if spans else np.zeros(len(lo), dtype=bool)


def _result_batches(window: int):
    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, SLICE_BYTES):
            rows: list[list] = [[], [], [], []]
            for d, text, spans in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                data = text.encode()
                lo, _, gone = _removed_words(data, spans, window)
                words = data.split()  # bytes split at the same six characters
                kept = words if not gone.any() else [words[i] for i in np.flatnonzero(~gone).tolist()]
                for r, v in zip(rows, (None if d == NULL_ID else d, len(lo), int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()), strict=True):
                    r.append(v)
            yield batch_of(out, rows)

    return run


def _spans(keyed: DataFrame, window: int) -> DataFrame:
    if window < 2 * GRAM:
        raise ValueError(f"a window has at least {2 * GRAM} words")

    def compare(contents: list[bytes], firsts: np.ndarray) -> list[list[int]]:
        return [marks_of(f) for f in earlier_windows(contents, firsts, window)]

    return repeats(keyed, word_units(window), compare, "anchors", first_stays=True)


def dedup(docs: DataFrame, window: int = WINDOW_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digest of every document without the words of windows that also start earlier.

    Earlier is a smaller id, or the same id and an earlier word; between rows of one id the hash of their
    texts decides. Null text is empty; a null id comes before all others and stays null; of rows that
    are alike in id and text all count as the first; an empty table gives no rows. Only the two columns
    named are read.
    """
    keyed = keyed_rows(texts(docs, id_col, text_col))
    return keyed.join(_spans(keyed, window), ["d", "th"], "left").select("d", "text", "spans").mapInArrow(_result_batches(window), schema_of(RESULT))


def _stripped_batches(window: int):
    out = pa.schema([("d", pa.int64()), ("th", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, SLICE_BYTES):
            new = []
            for text, spans in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if spans:
                    data = text.encode()
                    lo, hi, gone = _removed_words(data, spans, window)
                    # A removed word goes with the white space before it.
                    ends = np.concatenate([[0], hi[:-1]])
                    keep = np.ones(len(data), dtype=bool)
                    for a, e in zip(ends[gone].tolist(), hi[gone].tolist(), strict=True):
                        keep[a:e] = False
                    text = np.frombuffer(data, dtype=np.uint8)[keep].tobytes().decode().lstrip("\t\n\x0b\x0c\r ")
                new.append(text)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(new, type=pa.string())], schema=out)

    return run


def strip(docs: DataFrame, window: int = WINDOW_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated words taken out of ``text_col``; white space around kept words stays.

    Columns and their order stay; a text that loses nothing stays as it is, null included. Texts are
    dealt out once; the other columns meet the result by the row's key.
    """
    d, th, absent, new = (f"__emberdesk_{x}" for x in ("d", "th", "absent", "text"))
    keyed = keyed_rows(texts(docs, id_col, text_col))
    apart = keyed.select("th").where("th != 0").limit(1).count() > 0  # ids repeat, so texts tell rows apart
    out = keyed.join(_spans(keyed, window), ["d", "th"], "left").select("d", "th", "text", "spans").mapInArrow(_stripped_batches(window), "d long, th long, text string").toDF(d, th, new)
    if apart:
        out = out.dropDuplicates([d, th])
    own = docs.withColumn(d, F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))).withColumn(absent, F.col(text_col).isNull())
    own = own.withColumn(th, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) if apart else F.lit(0).cast("long")).drop(text_col)
    text = F.when(~F.col(absent), F.col(new))
    return own.join(out, [d, th]).select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
