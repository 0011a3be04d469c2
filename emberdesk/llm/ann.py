"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first.

The tree is fitted on a bounded sample; every row is put into a leaf by walking down it. Leaves that get
many rows are split again, each in a task of its own on a bounded sample of its rows, round by round until
none is large, so that the tree deepens with the table. A query keeps a priority queue of subtrees by the distance to their centres, takes
the nearest first, and visits leaves until enough. How many leaves are enough is calibrated on the whole
tree: visits widen until sampled queries find the wanted share of their true neighbours within the sample.

Equal vectors are held once with as many of their least ids as an answer can hold, so a vector that many
rows share weighs no more than others. Leaves and their queries are cut into chunks by their counts; a
task scores one chunk of vectors against one chunk of queries.
"""

from __future__ import annotations

import heapq
import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import schema_of, stored

#: Rows of the fit, about (those under a threshold of their hash), and sampled queries of the calibration.
FIT_ROWS = 20_000
CALIBRATION_QUERIES = 400
BRANCHES = 8
#: Sampled rows in a leaf, about.
LEAF_ROWS = 64
RECALL = 0.97
#: A leaf with more rows is split again, fitted on about so many of them (those under a threshold of their hash). The
#: driver holds the tree: a leaf for some hundreds to thousands of rows, of which it has the centre.
SPLIT_ROWS = 4096
#: Vectors and queries scored in one task.
CHUNK_VECTORS, CHUNK_QUERIES = 4096, 2048


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Centres and the members' places, started from spread-out members (k-means++)."""
    centres = [x[rng.integers(len(x))]]
    far = np.full(len(x), np.inf)
    for _ in range(k - 1):
        far = np.minimum(far, ((x - centres[-1]) ** 2).sum(axis=1))
        if far.sum() <= 1e-12:
            break
        centres.append(x[rng.choice(len(x), p=far / far.sum())])
    c = np.array(centres)
    for _ in range(rounds):
        own = _nearest(x, c)
        for j in range(len(c)):
            mine = x[own == j]
            if len(mine):
                c[j] = mine.mean(axis=0)
    return c, _nearest(x, c)


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c**2).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)


@dataclass
class Tree:
    """Inner nodes hold centres of their children; ``children`` has inner nodes as is and leaf j as ``-1 - j``."""

    centres: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaves: int = 0
    root: int = -1

    def grow(self, x: np.ndarray, rng: np.random.Generator, depth: int = 0) -> int:
        if len(x) > LEAF_ROWS and depth < 12:
            c, own = k_means(x, BRANCHES, rng)
            used = [j for j in range(len(c)) if (own == j).any()]
            if len(used) > 1:
                at = len(self.centres)
                self.centres.append(c[used])
                self.children.append([])
                self.children[at] = [self.grow(x[own == j], rng, depth + 1) for j in used]
                return at
        self.leaves += 1
        return -self.leaves

    @classmethod
    def fit(cls, x: np.ndarray, seed: int = 3) -> Tree:
        tree = cls()
        tree.root = tree.grow(x, np.random.default_rng(seed))
        return tree

    def graft(self, leaf: int, other: Tree) -> None:
        """Put ``other`` in the place of a leaf; its first leaf takes that number, the others follow the last."""
        if other.root < 0:
            return
        base, leaves = len(self.centres), self.leaves

        def moved(node: int) -> int:
            return node + base if node >= 0 else -1 - leaf if node == -1 else node + 1 - leaves

        self.centres += other.centres
        self.children += [[moved(c) for c in row] for row in other.children]
        self.leaves += other.leaves - 1
        at = -1 - leaf
        if self.root == at:
            self.root = other.root + base
        for row in self.children[:base]:
            if at in row:
                row[row.index(at)] = other.root + base
                break

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        out = np.zeros(len(x), dtype=np.int64)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -1 - node
                continue
            own = _nearest(x[rows], self.centres[node])
            for j, child in enumerate(self.children[node]):
                mine = rows[own == j]
                if len(mine):
                    todo.append((child, mine))
        return out

    def visit(self, q: np.ndarray) -> Iterator[int]:
        """Leaves in best-bin-first order: always the nearest subtree or leaf that waits."""
        queue: list[tuple[float, int]] = [(0.0, self.root)]
        while queue:
            _, node = heapq.heappop(queue)
            while node >= 0:
                d = ((self.centres[node] - q) ** 2).sum(axis=1)
                best = int(d.argmin())
                for j, child in enumerate(self.children[node]):
                    if j != best:
                        heapq.heappush(queue, (float(d[j]), child))
                node = self.children[node][best]
            yield -1 - node

    def visited(self, q: np.ndarray, visits: int, sizes: np.ndarray, least: int) -> list[int]:
        """The first ``visits`` leaves with rows, and more while they hold fewer than ``least`` rows."""
        out, rows = [], 0
        for leaf in self.visit(q):
            if sizes[leaf]:
                out.append(leaf)
                rows += int(sizes[leaf])
            if len(out) >= visits and rows >= least:
                break
        return out


def calibrate(tree: Tree, x: np.ndarray, k: int, recall: float, sizes: np.ndarray, seed: int = 5) -> int:
    """The least number of visits to leaves with rows with which sampled queries reach ``recall`` within the sample ``x``."""
    rng = np.random.default_rng(seed)
    chosen = rng.choice(len(x), size=min(CALIBRATION_QUERIES, len(x)), replace=False)
    leaf, held = tree.assign(x), sizes > 0
    need: list[int] = []  # visits that each true neighbour needs
    for i in chosen:
        score = x @ x[i]
        score[i] = -np.inf
        most = min(k, len(x) - 1)
        true = np.argpartition(-score, most - 1)[:most] if most else np.zeros(0, dtype=int)
        wanted, visits = Counter(leaf[true].tolist()), 0
        for at in tree.visit(x[i]):
            if not wanted:
                break
            visits += bool(held[at]) or at in wanted
            need += [visits] * wanted.pop(at, 0)
    if not need:
        return 1
    return int(np.sort(need)[min(len(need) - 1, max(0, int(np.ceil(recall * len(need))) - 1))])


def _fitted(rows: pd.DataFrame) -> pd.DataFrame:
    tree = Tree.fit(_unit(np.stack(rows["v"].to_numpy())))
    return pd.DataFrame({"leaf": [int(rows["leaf"].iloc[0])], "tree": [pickle.dumps(tree)]})


#: Steps of the thresholds on hashes.
STEPS = 1 << 30


def _share(*columns: str) -> F.Column:
    return F.pmod(F.xxhash64(*columns), F.lit(STEPS))


def deepened(tree: Tree, leafed: DataFrame, counts: dict[int, int], whole: set[int]) -> bool:
    """Split the leaves with more than ``SPLIT_ROWS`` rows; whether any was. Each is fitted in its own task.

    Leaves in ``whole`` are known not to split, as their rows are all alike; those that turn out so are added.
    """
    large = [k for k, n in counts.items() if n > SPLIT_ROWS and k not in whole]
    if not large:
        return False
    shares = leafed.sparkSession.createDataFrame([(k, STEPS * SPLIT_ROWS // counts[k]) for k in large], "leaf long, share long")
    sample = leafed.join(F.broadcast(shares), "leaf").where(_share("vec_id", "v") < F.col("share")).select("leaf", "v")  # a row for each leaf: bounded by the tree
    split = False
    for r in sorted(sample.groupBy("leaf").applyInPandas(_fitted, "leaf long, tree binary").collect()):  # bounded by the tree
        part = pickle.loads(r.tree)
        tree.graft(r.leaf, part)
        if part.root < 0:
            whole.add(r.leaf)
        split |= part.root >= 0
    return split


def valid(rows: DataFrame, id_col: str, vec_col: str, length: int | None = None) -> tuple[DataFrame, int]:
    """``vec_id, v``: rows whose vector has a direction, of the given or else the commonest length; that length."""
    v = F.col(vec_col).cast("array<double>")
    own = rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    own = own.where(F.size("v") > 0).where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).where(F.exists("v", lambda x: x != 0))
    if length is None:
        common = own.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
        length = common[0].n if common else 0
    return own.where(F.size("v") == length), length


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _leaf_batches(tree: Tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                leaf = tree.assign(_unit(_matrix(b.column(1))))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(leaf)], names=["vec_id", "v", "leaf"])

    return run


def _visit_batches(tree: Tree, visits: int, sizes: np.ndarray, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                q = _unit(_matrix(b.column(1)))
                leaves = [tree.visited(row, visits, sizes, least) for row in q]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(leaves, type=pa.list_(pa.int64()))], names=["vec_id", "v", "leaves"])

    return run


def _score(k: int):
    def run(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[np.ndarray, ...]] = []
        if len(queries) and len(vectors):
            x, ids = np.stack(vectors["v"].to_numpy()), vectors["vec_id"].to_numpy()
            norm = np.sqrt((x * x).sum(axis=1))
            for start in range(0, len(queries), 256):
                part = queries.iloc[start : start + 256]
                q, own = np.stack(part["v"].to_numpy()), part["query_id"].to_numpy()
                size = np.sqrt((q * q).sum(axis=1))
                rough = (q @ x.T) / norm / size[:, None]
                rough[own[:, None] == ids[None, :]] = -np.inf
                last = min(k, len(ids)) - 1
                floor = -np.partition(-rough, last, axis=1)[:, last] - 1e-9
                for r in range(len(part)):
                    at = np.flatnonzero((rough[r] >= floor[r]) & (ids != own[r]))
                    exact = (x[at] * q[r]).sum(axis=1) / (norm[at] * size[r])  # one order of sums for all rows
                    top = np.lexsort((ids[at], -exact))[:k]
                    found.append((np.full(len(top), own[r]), ids[at][top], exact[top]))
        if not found:
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        q, i, s = (np.concatenate(c) for c in zip(*found, strict=True))
        return pd.DataFrame({"query_id": q, "vec_id": i, "score": s})

    return run


def search(rows: DataFrame, queries: DataFrame | None = None, k: int = 5, recall: float = RECALL, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest rows found for each query, by cosine.

    ``queries`` has the columns of ``rows``; by default every row is one. A query's own id is no
    candidate. Vectors null, empty, zero, or with null or non-finite components take no part, nor those of
    another length than the commonest. Rows repeated in id and vector count once; rows of one id with
    several vectors are candidates, and queries, with each: their answers share the id's ranks, best first,
    and name a neighbour once, by its nearest vector, so that they may be fewer. Ties go to the smaller id. With fewer than ``k`` candidates, all are returned. An empty table gives no rows.
    """
    every, length = valid(rows, id_col, vec_col)
    asked = every if queries is None else valid(queries, id_col, vec_col, length)[0]
    spark = rows.sparkSession
    n = every.count()
    picked = every if n <= FIT_ROWS else every.where(_share("vec_id", "v") < STEPS * FIT_ROWS // n)
    sample = picked.dropDuplicates(["vec_id", "v"]).toPandas().sort_values("vec_id", kind="stable")  # about FIT_ROWS rows, by the threshold
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    x = _unit(np.stack(sample["v"].to_numpy()))
    tree = Tree.fit(x)

    # Equal vectors: an answer holds at most k of them, and the query itself may be one.
    by_vector = Window.partitionBy(F.xxhash64("v"), "v").orderBy("vec_id")
    held = every.dropDuplicates(["vec_id", "v"]).withColumn("r", F.row_number().over(by_vector)).where(F.col("r") <= k + 1).select("vec_id", "v")

    def into_leaves(vectors: DataFrame) -> tuple[DataFrame, dict[int, int]]:
        out = stored(vectors.mapInArrow(_leaf_batches(tree), schema_of("vec_id long, v array<double>, leaf long")), "ann-leaves")
        return out, {r.leaf: r.n for r in out.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}  # bounded by the tree

    leafed, counts = into_leaves(held)
    whole: set[int] = set()
    while deepened(tree, leafed, counts, whole):
        leafed, counts = into_leaves(leafed.select("vec_id", "v"))
    sizes = np.array([counts.get(i, 0) for i in range(tree.leaves)])
    visits = calibrate(tree, x, k, recall, sizes)
    walks = asked.dropDuplicates(["vec_id", "v"]).mapInArrow(_visit_batches(tree, visits, sizes, k + 1), schema_of("vec_id long, v array<double>, leaves array<long>"))
    walks = stored(walks.select(F.col("vec_id").alias("query_id"), "v", F.explode("leaves").alias("leaf")), "ann-walks")
    asks = {r.leaf: r.n for r in walks.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}  # bounded by the tree
    grid = spark.createDataFrame([(leaf, -(-n // CHUNK_VECTORS), -(-asks.get(leaf, 0) // CHUNK_QUERIES)) for leaf, n in sorted(counts.items())], "leaf long, nv int, nq int")
    grid = F.broadcast(grid)  # one row a leaf: bounded by the tree
    cells_v = leafed.join(grid, "leaf").where("nq > 0").withColumn("cv", F.pmod(F.xxhash64("vec_id"), "nv").cast("int")).withColumn("cq", F.explode(F.sequence(F.lit(0), F.col("nq") - 1))).select("leaf", "cv", "cq", "vec_id", "v")
    cells_q = walks.join(grid, "leaf").withColumn("cq", F.pmod(F.xxhash64("query_id"), "nq").cast("int")).withColumn("cv", F.explode(F.sequence(F.lit(0), F.col("nv") - 1))).select("leaf", "cv", "cq", "query_id", "v")
    cell = ["leaf", "cv", "cq"]
    scored = cells_q.groupBy(*cell).cogroup(cells_v.groupBy(*cell)).applyInPandas(_score(k), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    scored = scored.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
