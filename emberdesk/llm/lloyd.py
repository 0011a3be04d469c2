"""Vector codes by filtering Lloyd: parts of vectors become the numbers of their nearest codebook entries.

Vectors become whole numbers and are cut into equal parts. Every partition builds one kd-tree for each part
position over its vectors' parts; a node keeps the box, the number and the sum of the points below it. A round
walks down from the root with all entries as candidates. At a node, an entry goes if another one is at least as
near to every corner of the box; where one is left, the whole subtree is its own, and the node's sum and number
are added without looking at a point. Trees are built once and stored; a round reads them, and what leaves a
task is one sum for each part position and entry.

All arithmetic is in whole numbers, so results don't depend on how rows were dealt.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import BROADCAST_ROWS, bounded_batches, finite_vectors, matrix, stored

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Points in a leaf, at most; vectors in one set of trees.
LEAF_POINTS = 16
CHUNK_ROWS = 8_192
#: Components are held in 32 bits, and squared distances of a part must fit in 63.
MOST = 1 << 26


def _cuts(n: int) -> list[np.ndarray]:
    """Where the nodes of each level begin, with ``n`` behind them: every node is cut in the middle."""
    levels = [np.array([0, n])]
    while np.diff(levels[-1]).max() > LEAF_POINTS:
        b = levels[-1]
        levels.append(np.append(np.stack([b[:-1], (b[:-1] + b[1:]) // 2], axis=1).ravel(), n))
    return levels


@dataclass(frozen=True)
class Tree:
    """A kd-tree over whole-number points: their order, and box and sum of every node, level by level."""

    order: np.ndarray
    points: np.ndarray  # in that order
    low: np.ndarray
    high: np.ndarray
    total: np.ndarray

    @classmethod
    def build(cls, x: np.ndarray) -> Tree:
        order, levels = np.arange(len(x)), _cuts(len(x))
        for depth, cuts in enumerate(levels):
            p, begin = x[order], cuts[:-1]
            low, high = np.minimum.reduceat(p, begin), np.maximum.reduceat(p, begin)
            if depth + 1 < len(levels):
                node = np.repeat(np.arange(len(begin)), np.diff(cuts))
                along = p[np.arange(len(p)), (high - low).argmax(axis=1)[node]]
                order = order[np.lexsort((order, along, node))]
        p = x[order]
        at = [c[:-1] for c in levels]
        box = [np.concatenate([f.reduceat(p, b) for b in at]) for f in (np.minimum, np.maximum, np.add)]
        return cls(order, p, *box)

    def packed(self) -> dict[str, bytes]:
        return {"ord": self.order.astype(np.int32).tobytes(), "pts": self.points.astype(np.int32).tobytes(), "box": np.concatenate([self.low, self.high]).astype(np.int32).tobytes(), "total": self.total.astype(np.int64).tobytes()}

    @classmethod
    def unpacked(cls, held: dict[str, bytes], width: int) -> Tree:
        of = lambda c, kind: np.frombuffer(held[c], dtype=kind).astype(np.int64)
        low, high = np.split(of("box", np.int32).reshape(-1, width), 2)
        return cls(of("ord", np.int32), of("pts", np.int32).reshape(-1, width), low, high, of("total", np.int64).reshape(-1, width))

    def assign(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest entry of every point, in the tree's order, and number and sum of each entry's points.

        Ties go to the lower entry: where an entry is as near as a lower one at a corner and farther elsewhere, it goes as well.
        """
        k, levels = len(entries), _cuts(len(self.points))
        number, total = np.zeros(k, dtype=np.int64), np.zeros((k, self.points.shape[1]), dtype=np.int64)
        own = np.zeros(len(self.points), dtype=np.int64)
        square = (entries**2).sum(axis=1)
        nodes, could, first = np.zeros(1, dtype=np.int64), np.ones((1, k), dtype=bool), 0
        for depth, cuts in enumerate(levels):
            at = first + nodes
            low, high = self.low[at], self.high[at]
            # Twice the way from the box's middle: whole numbers still.
            middle = ((2 * entries[None] - (low + high)[:, None]) ** 2).sum(axis=2)
            best = np.where(could, middle, np.iinfo(np.int64).max).argmin(axis=1)
            way = entries[None] - entries[best][:, None]
            corner = np.where(way > 0, high[:, None], low[:, None])
            least = square[None] - square[best][:, None] - 2 * (way * corner).sum(axis=2)  # how much farther than ``best``, at least
            could &= ~((least > 0) | (least == 0) & (np.arange(k)[None] > best[:, None]))
            done = could.sum(axis=1) == 1
            np.add.at(number, best[done], np.diff(cuts)[nodes[done]])
            np.add.at(total, best[done], self.total[at[done]])
            for e, a, z in zip(best[done].tolist(), cuts[nodes[done]].tolist(), cuts[nodes[done] + 1].tolist(), strict=True):
                own[a:z] = e
            nodes, could = nodes[~done], could[~done]
            first += len(cuts) - 1
            if not len(nodes):
                break
            if depth + 1 < len(levels):
                nodes, could = np.stack([2 * nodes, 2 * nodes + 1], axis=1).ravel(), np.repeat(could, 2, axis=0)
            else:
                sizes = np.diff(cuts)[nodes]
                rows = np.repeat(cuts[nodes] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                p = self.points[rows]
                far = np.where(np.repeat(could, sizes, axis=0), square[None] - 2 * (p @ entries.T), np.iinfo(np.int64).max)
                own[rows] = mine = far.argmin(axis=1)
                np.add.at(number, mine, 1)
                np.add.at(total, mine, p)
        return own, number, total


def _tree_batches(parts: int, scale: int, width: int, label_type: pa.DataType):
    tree = pa.struct([(c, pa.binary()) for c in ("ord", "pts", "box", "total")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, CHUNK_ROWS):
                b = whole.slice(start, CHUNK_ROWS)
                x = np.floor(matrix(b.column(2)) * scale)
                if np.abs(x).max() >= MOST:
                    raise OverflowError(f"a component times {scale} is {MOST} or more")
                x = x.astype(np.int64)
                trees = [Tree.build(x[:, p * width : (p + 1) * width]).packed() for p in range(parts)]
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0).to_pylist()], type=pa.list_(pa.int64())), pa.array([b.column(1).to_pylist()], type=pa.list_(label_type)), pa.array([trees], type=pa.list_(tree))], names=["ids", "labels", "trees"])

    return run


def _sum_batches(books: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, k, width = books.shape
        number, total = np.zeros((parts, k), dtype=np.int64), np.zeros((parts, k, width), dtype=np.int64)
        for b in batches:
            for trees in b.column(0).to_pylist():
                for p, held in enumerate(trees):
                    _, n, s = Tree.unpacked(held, width).assign(books[p])
                    number[p] += n
                    total[p] += s
        part, entry, at = (x.ravel() for x in np.indices(total.shape))
        n = np.repeat(number.ravel(), width)
        some = n > 0
        yield pa.RecordBatch.from_arrays([pa.array(c[some]) for c in (part, entry, at, n, total.ravel())], names=["part", "entry", "at", "n", "total"])

    return run


def _code_batches(books: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, _, width = books.shape
        for b in batches:
            for i in range(b.num_rows):
                ids, labels = b.column(0)[i].values, b.column(1)[i].values
                codes, error = np.zeros((len(ids), parts), dtype=np.int64), np.zeros(len(ids), dtype=np.int64)
                for p, held in enumerate(b.column(2)[i].as_py()):
                    tree = Tree.unpacked(held, width)
                    own, _, _ = tree.assign(books[p])
                    codes[tree.order, p] = own
                    error[tree.order] += ((tree.points - books[p][own]) ** 2).sum(axis=1)
                digits = 2 if books.shape[1] <= 256 else 4
                text = ["".join(f"{c:0{digits}x}" for c in row) for row in codes.tolist()]
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(text, type=pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return run


def encode(
    rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label"
) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, label, code, error`` of every kept vector, and the codebooks (part, entry, component).

    Vectors null, empty, or with null or non-finite components take no part, nor those of another length than the
    commonest, which ``parts`` must divide. Entries start as the vectors of least id (nulls last; rows of one id in
    the order of their components); with fewer than ``entries`` vectors there are as many entries as vectors. An
    entry that nothing is nearest to stays. Repeated rows all count and get a row each; a null id or label stays;
    an empty table gives no rows and no entries. A component whose product with ``scale`` is 2 to the 26th or more
    raises an error. ``code`` has two hex digits for each part, four if there are more than 256 entries. Only the
    three columns named are read.
    """
    bounded_batches(rows.sparkSession)
    own, length = finite_vectors(rows, id_col, vec_col, extra={"label": label_col})
    if length % parts:
        raise ValueError(f"{parts} parts don't divide vectors of {length} components")
    spark, width = rows.sparkSession, length // parts
    first = own.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()
    books = np.floor(np.array([r.v for r in first], dtype=float).reshape(len(first), parts, width) * scale)
    if books.size and np.abs(books).max() >= MOST:
        raise OverflowError(f"a component times {scale} is {MOST} or more")
    books = books.astype(np.int64).transpose(1, 0, 2).copy()

    kind = own.schema["label"].dataType
    tree = T.StructType([T.StructField(c, T.BinaryType()) for c in ("ord", "pts", "box", "total")])
    chunk = T.StructType([T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("labels", T.ArrayType(kind)), T.StructField("trees", T.ArrayType(tree))])
    trees = stored(own.select("vec_id", "label", "v").mapInArrow(_tree_batches(parts, scale, width, to_arrow_type(kind)), chunk), "lloyd-trees")
    for _ in range(rounds if len(first) else 0):
        sums = trees.select("trees").mapInArrow(_sum_batches(books), "part long, entry long, at long, n long, total long")
        books = books.copy()
        # At most one row for each component of an entry.
        for r in sums.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
            books[r.part, r.entry, r["at"]] = r.total // r.n
    out = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", kind), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    return trees.mapInArrow(_code_batches(books), out), books


def decode(codes: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """``codes`` with ``approximation``: the middle of the cell of whole numbers that each entry names, as doubles.

    Null codes give null; an empty table gives none.
    """
    digits = 2 if books.shape[1] <= 256 else 4
    values = F.array(*[F.array(*[F.array(*[F.lit((float(v) + 0.5) / scale) for v in entry]) for entry in book]) for book in books])
    at = lambda p: F.conv(F.substring("code", p * digits + 1, digits), 16, 10).cast("int")
    return codes.withColumn("approximation", F.when(F.col("code").isNotNull(), F.concat(*[F.get(F.get(values, p), at(p)) for p in range(len(books))])))


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def codes_with_errors(rows: DataFrame, **how) -> DataFrame:
    """``encode``'s rows with the error summed over equal labels (nulls together) and the codebooks' digest."""
    found, books = encode(rows, **how)
    found = stored(found, "lloyd-codes")
    sums = found.groupBy("label").agg(F.sum("error").alias("label_error"))
    sums = stored(sums, "lloyd-labels").withColumnRenamed("label", "__label")
    # A few labels, as usual, are sent to all; very many meet their rows in a join that can split a frequent one.
    few = sums.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    both = found.join(F.broadcast(sums) if few else sums, F.col("label").eqNullSafe(F.col("__label")))
    return both.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
