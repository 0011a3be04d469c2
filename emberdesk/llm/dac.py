"""Token files of directly addressable codes.

An id is split into chunks of fixed widths, lowest bits first. Level k holds the k-th chunk of every id
that has one, and a bitmap with a bit for each of its chunks: set if the id goes on in level k + 1. A
rank directory counts the set bits before each block, so token i of a segment is found by one rank a
level, with no decoding of its neighbours.

A segment is one binary value::

    magic "DAC1", levels (u4), n (u8), then for each level: width (u4), chunks (u8),
    payload of u1 or u2 values, bitmap bytes (padded to 8), rank directory of u4 counts

Segments lie in a Parquet table, in ascending doc_id order by (part, seg), with the ids of their
documents and where these end.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path, schema_of, slices, texts, vocabulary
from .encode import CachedEncoder, kept_for_worker
from .windows import NULL_ID

MAGIC = b"DAC1"
#: Bits of the chunk levels: the commonest ids need one byte.
WIDTHS = (8, 8, 16)
#: Bytes of bitmap for one entry of the rank directory.
RANK_BLOCK = 64
SEGMENT_TOKENS = 1 << 20

SEGMENTS = "part int, seg int, n_tokens long, doc_ids array<long>, doc_ends array<long>, data binary"


def _dtype(width: int) -> str:
    return "<u1" if width <= 8 else "<u2"


def dac_encode(ids: np.ndarray, widths: tuple[int, ...] = WIDTHS) -> bytes:
    """The segment of ``ids`` (unsigned, below 2 to the sum of ``widths``)."""
    rest = np.asarray(ids, dtype=np.uint64)
    if sum(widths) < 64 and rest.size and int(rest.max()) >> sum(widths):
        raise ValueError("an id is wider than all levels")
    out, levels = [], []
    for k, width in enumerate(widths):
        chunk = (rest & np.uint64((1 << width) - 1)).astype(_dtype(width))
        rest = rest >> np.uint64(width)
        more = rest > 0 if k + 1 < len(widths) else np.zeros(rest.size, dtype=bool)
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % 8, dtype=np.uint8)])
        ones = np.bitwise_count(bits).astype(np.int64)
        starts = np.arange(0, len(bits), RANK_BLOCK)
        per_block = np.add.reduceat(ones, starts) if len(bits) else np.zeros(0, dtype=np.int64)
        ranks = (np.cumsum(per_block) - per_block).astype("<u4")
        levels.append(struct.pack("<IQ", width, chunk.size) + chunk.tobytes() + bits.tobytes() + ranks.tobytes())
        rest = rest[more]
        if not rest.size:
            break
    out.append(MAGIC + struct.pack("<IQ", len(levels), len(ids)))
    return b"".join(out + levels)


class DacReader:
    """Random access to one segment."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        count, self.n = struct.unpack_from("<IQ", data, 4)
        at, self.levels, shift = 16, [], 0
        for _ in range(count):
            width, size = struct.unpack_from("<IQ", data, at)
            at += 12
            chunks = np.frombuffer(data, _dtype(width), size, at)
            at += chunks.nbytes
            nbytes = (size + 63) // 64 * 8
            bits = np.frombuffer(data, np.uint8, nbytes, at)
            at += nbytes
            ranks = np.frombuffer(data, "<u4", -(-nbytes // RANK_BLOCK), at)
            at += ranks.nbytes
            self.levels.append((shift, chunks, bits, ranks))
            shift += width

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for shift, chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            byte, bit = divmod(i, 8)
            if not bits[byte] >> bit & 1:
                break
            block = byte // RANK_BLOCK
            i = int(ranks[block]) + int(np.bitwise_count(bits[block * RANK_BLOCK : byte]).sum()) + (int(bits[byte]) & ((1 << bit) - 1)).bit_count()
        return value

    def _rank(self, level: int, i: int) -> int:
        _, _, bits, ranks = self.levels[level]
        byte, bit = divmod(i, 8)
        if byte >= len(bits):
            return int(np.bitwise_count(bits).sum())
        block = byte // RANK_BLOCK
        return int(ranks[block]) + int(np.bitwise_count(bits[block * RANK_BLOCK : byte]).sum()) + (int(bits[byte]) & ((1 << bit) - 1)).bit_count()

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop``: each level is entered at the rank of its first chunk."""
        stop = min(stop, self.n)
        out = np.zeros(max(0, stop - start), dtype=np.uint32)
        where = np.arange(len(out))
        for k, (shift, chunks, bits, _) in enumerate(self.levels):
            if not len(where):
                break
            out[where] |= chunks[start : start + len(where)].astype(np.uint32) << np.uint32(shift)
            lo = start // 8
            more = np.unpackbits(bits[lo : (start + len(where) + 7) // 8], bitorder="little")[start - 8 * lo :][: len(where)].astype(bool)
            start = self._rank(k, start)
            where = where[more]
        return out


CODED = "doc_id long, th long, part int, codes binary"


def _coded_batches(spec: str, bounds: np.ndarray):
    """Each document's ids in as few bytes as the vocabulary needs, and the part that it goes to.

    Parts are ranges of the id, null first. An id that fills several ranges is dealt to them by the range
    of its texts' hashes, so that parts one after another stay in order.
    """
    out = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("part", pa.int32()), ("codes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = kept_for_worker(CachedEncoder, spec)
        kind = code_type(enc)
        for b in slices(batches):
            ids, th = (b.column(i).fill_null(NULL_ID).to_numpy(zero_copy_only=False) for i in (0, 1))
            lo, hi = np.searchsorted(bounds, ids, side="left"), np.searchsorted(bounds, ids, side="right")
            share = (th.astype(np.float64) + 2.0**63) / 2.0**64
            part = np.minimum(lo + (share * (hi - lo + 1)).astype(np.int64), hi)
            codes = [own.astype(kind).tobytes() for own in enc.encode_all(b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1), pa.array(part.astype(np.int32)), pa.array(codes, pa.binary())], schema=out)

    return run


def code_type(enc: CachedEncoder) -> str:
    return "<u2" if len(enc.spaced) <= 1 << 16 else "<u4"


def _segment_batches(spec: str, end_id: int, segment_tokens: int):
    out = pa.schema([("part", pa.int32()), ("seg", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_ends", pa.list_(pa.int64())), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = code_type(kept_for_worker(CachedEncoder, spec))
        end = np.asarray([end_id], dtype=np.uint32)
        part, seg = -1, 0
        docs: list = []
        ends: list[int] = []
        ids: list[np.ndarray] = []
        n = 0

        def flush() -> pa.RecordBatch:
            data = dac_encode(np.concatenate(ids))
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(([part], [seg], [n], [docs], [ends], [data]), out, strict=True)], schema=out)

        for b in slices(batches):
            for doc, p, codes in zip(*(b.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if docs and (p != part or n >= segment_tokens):
                    yield flush()
                    docs, ends, ids, n, seg = [], [], [], 0, seg + 1
                if p != part:
                    part, seg = p, 0
                ids += [np.frombuffer(codes, kind), end]
                n += len(ids[-2]) + 1
                docs.append(doc)
                ends.append(n)
        if docs:
            yield flush()

    return run


def part_bounds(docs: DataFrame, parts: int) -> np.ndarray:
    """Ids that cut the rows into ``parts`` ranges of about equal counts, from the id column alone."""
    marks = [k / parts for k in range(1, parts)]
    if not marks:
        return np.zeros(0, dtype=np.int64)
    got = docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("d")).agg(F.percentile_approx("d", marks, max(10_000, 20 * parts)).alias("b")).collect()[0].b
    return np.array(got or [], dtype=np.int64)


def write_tokens(docs: DataFrame, path: str, end_id: int = 2, vocab_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Encode every document, end it with ``end_id`` and write segments in ascending doc_id order.

    Null or empty text gives the end id alone; a null id sorts first; rows with equal ids lie side by
    side, ordered by their texts' hash; an empty table writes no segment. Texts are encoded where they
    are read, and their ids are dealt to parts by ranges of the id; rows of one id may fill several parts.
    """
    rows = texts(docs, id_col, text_col)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spec = vocabulary(vocab_path)
    coded = rows.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(_coded_batches(spec, part_bounds(rows, parts)), schema_of(CODED))
    ordered = coded.repartitionById(parts, "part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "th")
    ordered.mapInArrow(_segment_batches(spec, end_id, segment_tokens), schema_of(SEGMENTS)).write.parquet(path)


def _range_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("seg", pa.int32()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    for b in slices(batches):
        for part, seg, docs, ends, data in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            reader, ends = DacReader(data), np.asarray(ends)
            starts = np.concatenate([[0], ends[:-1]])
            ids = memoryview(reader.read(0, len(reader)).astype("<u4").tobytes())
            crcs = [zlib.crc32(ids[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
            n = len(docs)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip((docs, [part] * n, [seg] * n, starts, ends - starts, crcs), out, strict=True)], schema=out)


def segments(spark, path: str) -> DataFrame:
    return spark.read.schema(schema_of(SEGMENTS)).parquet(path)


def segment_bases(spark, path: str) -> DataFrame:
    """``part, seg, base``: the ids before each segment.

    Sums run within a part, and over one row a part: neither grows with the tokens of the corpus.
    """
    heads = segments(spark, path).select("part", "seg", "n_tokens")
    own = heads.withColumn("own", F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seg")) - F.col("n_tokens")).drop("n_tokens")
    parts = heads.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("earlier"))
    return own.join(parts, "part").select("part", "seg", (F.col("own") + F.col("earlier")).alias("base"))


def read_ranges(spark, path: str) -> DataFrame:
    """Each document's place in the token file, and the checksum of the ids read there.

    Only places and checksums meet the bases of their segments; the codes stay where they are read.
    """
    places = segments(spark, path).select("part", "seg", "doc_ids", "doc_ends", "data").mapInArrow(_range_batches, schema_of("doc_id long, part int, seg int, at long, n_tokens long, ids_crc32 long"))
    return places.join(segment_bases(spark, path), ["part", "seg"]).select("doc_id", (F.col("at") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def token_ranges(docs: DataFrame, name: str = "tokens", **options) -> DataFrame:
    """Write ``docs`` to a token file in the shared folder and read it back."""
    spark = docs.sparkSession
    path = new_path(spark, name)
    write_tokens(docs, path, **options)
    return read_ranges(spark, path)
