"""Whitening of vectors by a tiled covariance.

Components become whole numbers. Pairs of dimensions fall into tiles: pairs of column blocks. Tasks cut their
vectors into row blocks and these into column blocks; column blocks are shuffled by row block, each pair of
blocks that is a tile is multiplied there, and products are summed per tile, first within a task. The tiles,
one row for each pair of dimensions, are assembled on the driver and decomposed.

Values are centred at the whole number nearest to their mean before they are multiplied, so products are whole
numbers whose sums are exact in any order; what the rounding of the centre left is then taken off exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, bounded_batches, finite_vectors, matrix, stored

SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
#: Dimensions of a column block, and vectors of a row block.
TILE, BLOCK_ROWS = 32, 4_096
#: Components are below this, times the scale; products of centred values below its square are summed exactly.
MOST = 1 << 50
EXACT = 1 << 20
#: An eigenvalue below this share of the largest is none: its direction has no spread.
LEAST_SHARE = 1e-12
BLOCKS = pa.schema([("row_block", pa.int64()), ("col_block", pa.int32()), ("n", pa.int32()), ("data", pa.binary())])


def _whole(column: pa.Array) -> np.ndarray:
    x = np.floor(matrix(column) * SCALE)
    if np.abs(x).max(initial=0) >= MOST:
        raise OverflowError(f"a component times {SCALE} is {MOST} or more")
    return x.astype(np.int64) + OFFSET


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each dimension and task: sums as two halves of whole numbers, which can't overflow."""
    n, high, low = 0, None, None
    for b in batches:
        if b.num_rows:
            x = _whole(b.column(0))
            high, low = (np.zeros(x.shape[1], dtype=np.int64), np.zeros(x.shape[1], dtype=np.int64)) if high is None else (high, low)
            high += (x >> 26).sum(axis=0)
            low += (x & ((1 << 26) - 1)).sum(axis=0)
            n += len(x)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(high))), pa.array(np.full(len(high), n)), pa.array(high), pa.array(low)], names=["at", "n", "high", "low"])


def _block_batches(centre: np.ndarray):
    """Column blocks of row blocks. A row block is known by its task and its number there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, nth = TaskContext.get().partitionId(), 0
        for whole in batches:
            for start in range(0, whole.num_rows, BLOCK_ROWS):
                y = _whole(whole.column(0).slice(start, BLOCK_ROWS)) - centre
                cuts = range(0, y.shape[1], TILE)
                yield batch_of(BLOCKS, [[(task << 32) + nth] * len(cuts), list(range(len(cuts))), [len(y)] * len(cuts), [y[:, c : c + TILE].tobytes() for c in cuts]])
                nth += 1

    return run


def _tile_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Products of the tiles, summed over the task's row blocks; rows come in the order of row and column blocks."""
    tiles: dict[tuple[int, int], np.ndarray] = {}
    held: list[np.ndarray] = []
    current = None

    def multiply() -> None:
        for i, a in enumerate(held):
            for j in range(i, len(held)):
                b = held[j]
                if max(np.abs(a).max(), np.abs(b).max()) < EXACT:
                    # Below 2 to the 52nd: floats are exact here, and whole numbers where tiles are summed.
                    product = (a.T.astype(float) @ b.astype(float)).astype(np.int64).astype(object)
                else:
                    product = a.T.astype(object) @ b.astype(object)
                tiles[i, j] = tiles[i, j] + product if (i, j) in tiles else product

    for batch in batches:
        for block, _, n, data in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if block != current:
                multiply()
                held, current = [], block
            held.append(np.frombuffer(data, dtype=np.int64).reshape(n, -1))
    multiply()
    for (i, j), total in tiles.items():
        r, c = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array((i * TILE + r).ravel()), pa.array((j * TILE + c).ravel()), pa.array([str(v) for v in total.ravel().tolist()])], names=["r", "c", "total"])


def covariance(rows: DataFrame, length: int) -> tuple[int, list[int], np.ndarray]:
    """Number of vectors, whole sums of each dimension, and covariance of column ``v`` (divisor: the number)."""
    spark = rows.sparkSession
    sums = rows.select("v").mapInArrow(_sums, "at long, n long, high long, low long").groupBy("at").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low"))
    found = sorted(sums.collect(), key=lambda r: r["at"])  # one row for each dimension
    if not found:
        return 0, [], np.zeros((length, length))
    n, total = found[0].n, [(r.high << 26) + r.low for r in found]
    centre = [(2 * s + n) // (2 * n) for s in total]

    blocks = rows.select("v").mapInArrow(_block_batches(np.array(centre)), "row_block long, col_block int, n int, data binary")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = blocks.repartition(parts, "row_block").sortWithinPartitions("row_block", "col_block")
    tiles = dealt.mapInArrow(_tile_batches, "r long, c long, total string").groupBy("r", "c").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    rest = [Fraction(s, n) - m for s, m in zip(total, centre, strict=True)]
    v = np.zeros((length, length))
    for t in tiles.collect():  # one row for each pair of dimensions
        v[t.r, t.c] = v[t.c, t.r] = float(Fraction(int(t.total), n) - rest[t.r] * rest[t.c])
    return n, total, v


def components(v: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, float]:
    """Largest eigenvalues, their unit eigenvectors as columns (largest entry positive), and the trace."""
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:most]
    order = order[values[order] > max(values.max(initial=0), 0) * LEAST_SHARE]
    vectors = vectors[:, order]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))]) if len(order) else np.ones(0)
    return values[order], vectors * sign, float(np.trace(v))


def _white_batches(n: int, total: list[int], directions: np.ndarray, values: np.ndarray):
    exact = np.array(total, dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.array([s // n for s in total])
        rest = np.array([(s % n) / n for s in total])  # the mean is ``whole + rest``
        for b in batches:
            if not b.num_rows:
                continue
            x = _whole(b.column(1))
            y = x - whole
            white = (((y - rest)[:, :, None] * directions[None]).sum(axis=1)) / np.sqrt(values)
            # n * x - S, in whole numbers of Python where 63 bits might not do.
            left = np.array([s % n for s in total], dtype=object)
            most = n * (int(np.abs(y).max()) + 1)
            if most * most * y.shape[1] < 1 << 62:
                far = ((n * y - left.astype(np.int64)) ** 2).sum(axis=1).tolist()
            else:
                far = [v if v < 1 << 63 else None for v in ((n * x.astype(object) - exact) ** 2).sum(axis=1).tolist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(far, type=pa.int64()), pa.array(white.tolist(), type=pa.list_(pa.float64()))], names=["vec_id", "deviation", "white"])

    return run


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of whitened components and of their products, one row for each pair and task; component 0 is the constant 1."""
    total = None
    for b in batches:
        if b.num_rows:
            w = matrix(b.column(0))
            w = np.concatenate([np.ones((len(w), 1)), w], axis=1)
            total = w.T @ w if total is None else total + w.T @ w
    if total is not None:
        i, j = (x.ravel() for x in np.indices(total.shape))
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], names=["i", "j", "s"])


def whiten(rows: DataFrame, most: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: a row for each vector and component.

    A component of a vector becomes ``floor(1024 * c) + 100000``. ``whitened`` is a vector's place on an eigenvector
    of all vectors' covariance, in its standard deviations; ``explained`` that eigenvalue's share of the trace;
    ``deviation`` the exact sum of (n * x - S) squared over dimensions, null where it exceeds a long;
    ``identity_error`` how far the covariance of the whitened vectors is from the identity, at most.

    Vectors null, empty, or with null or non-finite components take no part, nor those of another length than the
    commonest. Directions without spread (an eigenvalue below 1e-12 of the largest) are no components, so one vector,
    or vectors that are all alike, give no rows, as does an empty table. Equal eigenvalues keep the order that the
    decomposition gives them. Repeated rows all count and get their rows; a null id stays. A component whose product
    with 1024 is 2 to the 50th or more raises an error. Only the two columns named are read.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    out = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    own, length = finite_vectors(rows, id_col, vec_col)
    n, total, v = covariance(own, length)
    values, directions, trace = components(v, most)
    if not len(values):
        return spark.createDataFrame([], out)
    white = own.select("vec_id", "v").mapInArrow(_white_batches(n, total, directions, values), "vec_id long, deviation long, white array<double>")
    white = stored(white, "whitened")
    moments = np.zeros((len(values) + 1,) * 2)
    for r in white.select("white").mapInArrow(_moments, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():  # one row for each pair of components
        moments[r.i, r.j] = r.s
    mean = moments[0, 1:] / n
    error = float(np.abs(moments[1:, 1:] / n - np.outer(mean, mean) - np.eye(len(values))).max())
    explained = F.array(*[F.lit(float(e / trace)) for e in values])
    each = white.select("vec_id", "deviation", F.posexplode("white").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
