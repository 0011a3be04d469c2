"""Toxicity by the nearest labelled examples.

Terms are words and the first five letters of longer words. The terms that tell the labels apart, and the most
frequent ones, which carry a text's length, are the dimensions; a text's vector holds count times idf, with
document frequencies counted over the whole corpus, scaled to length 1. A text's score comes from its nearest
examples by cosine. They are found exactly, in an inverted index of the examples whose postings stand in blocks
of similar examples: each term's largest weight in a block bounds what the block can offer, blocks are read by
falling bound, and those that can't reach the examples found so far are never read. Examples vote with weights
that fall with distance; votes of examples on one another, each without itself, calibrate the score.

The examples are a bounded sample of the labelled texts; everything else covers the whole corpus: terms are
counted once for each text, stored, and read again for the frequencies and for the scores.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ann import Tree
from .common import batch_of, bounded_batches, schema_of, slices, stored, texts

#: Labelled texts that are examples, about: those of least id hash.
MAX_EXAMPLES = 8_000
#: Terms: those with this chi-squared at least, the first of them; and the most frequent ones. Both counted in the examples.
LEAST_CHI, MAX_TELLING, FREQUENT, LEAST_TEXTS = 25.0, 1_000, 50, 5
STEM = 5
NEIGHBOURS = 15
#: Added to a distance before its reciprocal is the vote's weight.
SOFT = 0.05
#: Examples in a block, blocks that are read first, and room for rounding below a bound.
BLOCK, FIRST_BLOCKS, ROUNDING = 32, 8, 1e-9
#: Votes in one group of the calibration, at least.
LEAST_GROUP = 20
#: Vectors whose result a task remembers.
REMEMBERED = 4_096

WORD = re.compile(r"[^\W_]+")
COUNTED = pa.schema([("doc_id", pa.int64()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])
SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("neighbours", pa.list_(pa.int64())), ("evidence", pa.list_(pa.string()))])


def term_counts(text: str) -> Counter:
    """How often each word, and each five-letter beginning of longer words, stands in ``text``; case doesn't count."""
    words = Counter(WORD.findall(text.lower()))
    out = Counter(words)
    for w, n in words.items():
        if len(w) > STEM:
            out[w[:STEM] + "-"] += n
    return out


def held_out(doc_id: Column) -> Column:
    """Whether a row's label is kept from learning: by the id's digits."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def _thinned(rows: DataFrame, hashed: Column, most: int) -> DataFrame:
    """``rows``, or about ``most`` of them by a threshold on a hash if there are more."""
    n, steps = rows.count(), 1 << 30
    return rows if n <= most else rows.where(F.pmod(hashed, F.lit(steps)) < int(steps * most / n))


def examples(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int) -> DataFrame:
    """``doc_id, text, toxic`` of about ``most`` labelled texts that are not held out; equal texts are one.

    Several labels of an id, or of equal texts, count by their majority (1 if even).
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("toxic")).where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    known = _thinned(known.groupBy("doc_id").agg(F.avg("toxic").alias("toxic")), F.xxhash64("doc_id"), most)
    found = texts(docs, id_col, text_col).join(F.broadcast(known), "doc_id")  # about ``most`` ids, as counted
    same = found.groupBy(F.xxhash64("text").alias("h")).agg(F.min(F.struct("doc_id", "text")).alias("d"), F.avg("toxic").alias("toxic"))
    same = stored(same.select("d.doc_id", "d.text", (F.col("toxic") >= 0.5).cast("int").alias("toxic")), "toxicity-examples")
    return _thinned(same, F.xxhash64("text"), 2 * most)  # ids that repeat with many texts


def _term_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts, and in how many toxic ones, each term stands; one row for each term of a batch."""
    for b in slices(batches):
        every, toxic = Counter(), Counter()
        for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            terms = term_counts(text).keys()
            every.update(terms)
            if label:
                toxic.update(terms)
        names = list(every)
        yield pa.RecordBatch.from_arrays([pa.array(names, type=pa.string()), pa.array([every[t] for t in names], type=pa.int64()), pa.array([toxic[t] for t in names], type=pa.int64())], names=["term", "n", "toxic"])


def vocabulary(chosen: DataFrame) -> list[str]:
    """The dimensions: terms that tell the labels of the examples apart (chi-squared), and frequent terms."""
    size = chosen.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).collect()[0]
    terms = chosen.select("text", "toxic").mapInArrow(_term_batches, "term string, n long, toxic long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    terms = stored(terms.where(F.col("n") >= LEAST_TEXTS), "toxicity-terms")
    a, n, most, total = F.col("toxic").cast("double"), F.col("n").cast("double"), float(size.toxic), float(size.n)
    cross = a * (total - most - (n - a)) - (n - a) * (most - a)
    chi = cross * cross * total / (n * (total - n) * most * (total - most))
    telling = terms.where(F.col("n") < total).withColumn("chi", chi).where(F.col("chi") >= LEAST_CHI) if 0 < most < total else terms.limit(0).withColumn("chi", F.lit(0.0))
    # Bounded picks from a table that the examples bound.
    first = [r.term for r in telling.orderBy(F.desc("chi"), "term").limit(MAX_TELLING).collect()]
    often = [r.term for r in terms.orderBy(F.desc("n"), "term").limit(FREQUENT).collect()]
    return list(dict.fromkeys(first + often))


def _count_batches(terms: list[str]):
    known = {t: i for i, t in enumerate(terms)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            at, counts = [], []
            for text in b.column(1).to_pylist():
                own: dict[int, int] = {}
                for w, n in Counter(WORD.findall(text.lower())).items():
                    if (i := known.get(w)) is not None:
                        own[i] = n
                    if len(w) > STEM and (i := known.get(w[:STEM] + "-")) is not None:
                        own[i] = own.get(i, 0) + n
                order = sorted(own)
                at.append(order)
                counts.append([own[i] for i in order])
            yield batch_of(COUNTED, [b.column(0).to_pylist(), at, counts])

    return run


class BlockMax:
    """An inverted index of vectors in blocks: a term's postings in a block are the weights of its rows side by
    side, zero where the term is absent, and its largest weight there stands apart. It travels without the zeros."""

    def __init__(self, x: np.ndarray):
        self._place(len(x), x.shape[1], *np.nonzero(x), x[np.nonzero(x)])

    def _place(self, size: int, width: int, row: np.ndarray, term: np.ndarray, weight: np.ndarray) -> None:
        self.size, self.blocks = size, -(-size // BLOCK)
        self.postings = np.zeros((self.blocks, width, BLOCK))
        self.postings[row // BLOCK, term, row % BLOCK] = weight
        self.most = np.ascontiguousarray(self.postings.max(axis=2).T)  # by term and block

    def __reduce__(self):
        block, term, at = np.nonzero(self.postings)
        return _placed, (self.size, self.postings.shape[1], (block * BLOCK + at).astype(np.int32), term.astype(np.int32), self.postings[block, term, at])

    def scores(self, terms: np.ndarray, weights: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``blocks`` and their products with the query, terms summed in one order."""
        total = (self.postings[blocks[:, None], terms[None]] * weights[None, :, None]).sum(axis=1).ravel()
        rows = (blocks[:, None] * BLOCK + np.arange(BLOCK)).ravel()
        return rows[rows < self.size], total[rows < self.size]

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` rows with the largest products, largest first, ties to the lower row; all if fewer."""
        bound = weights @ self.most[terms] + ROUNDING
        order = np.argsort(-bound, kind="stable")
        rows, found = np.zeros(0, dtype=np.int64), np.zeros(0)
        at, step = 0, FIRST_BLOCKS
        while at < len(order):
            least = found[-1] if len(found) >= k else -np.inf
            take = order[at : at + step]
            take = take[bound[take] >= least]
            if not len(take):
                break
            r, s = self.scores(terms, weights, take)
            rows, found = np.concatenate([rows, r]), np.concatenate([found, s])
            if len(found) > k:
                enough = found >= np.partition(found, -k)[-k]
                rows, found = rows[enough], found[enough]
            best = np.lexsort((rows, -found))[:k]
            rows, found = rows[best], found[best]
            at, step = at + step, step * 2
        return rows, found


def _placed(*held) -> BlockMax:
    out = BlockMax.__new__(BlockMax)
    out._place(*held)
    return out


def pooled(votes: np.ndarray, truth: np.ndarray) -> tuple[list[float], list[float]]:
    """Points of a rising line from votes to the share of label 1, by pooling neighbours that would fall."""
    order = np.argsort(votes, kind="stable")
    groups: list[list[float]] = []  # sum of votes, of labels, number
    for part in np.array_split(order, max(1, len(order) // LEAST_GROUP)):
        groups.append([float(votes[part].sum()), float(truth[part].sum()), len(part)])
        while len(groups) > 1 and groups[-2][1] / groups[-2][2] >= groups[-1][1] / groups[-1][2]:
            last = groups.pop()
            groups[-1] = [x + y for x, y in zip(groups[-1], last, strict=True)]
    return [g[0] / g[2] for g in groups], [(g[1] + 0.5) / (g[2] + 1) for g in groups]


@dataclass(frozen=True)
class Model:
    """Fitted on the examples; its size is bounded by theirs."""

    terms: list[str]
    idf: np.ndarray
    ids: np.ndarray
    toxic: np.ndarray
    index: BlockMax | None
    line: tuple[list[float], list[float]]
    prior: float

    @classmethod
    def fit(cls, terms: list[str], idf: np.ndarray, ids: list[int], toxic: list[int], counted: list[tuple[list[int], list[int]]]) -> Model:
        y = np.array(toxic, dtype=float)
        prior = float((y.sum() + 0.5) / (len(y) + 1)) if len(y) else 0.0
        x = np.zeros((len(y), len(terms)))
        for i, (at, n) in enumerate(counted):
            x[i, at] = n
        x *= idf
        size = np.sqrt((x * x).sum(axis=1))
        some = size > 0
        if not some.any():
            return cls(terms, idf, np.zeros(0, dtype=np.int64), np.zeros(0), None, ([0.5], [prior]), prior)
        x, y, names = x[some] / size[some, None], y[some], np.array(ids)[some]
        # Similar examples stand together, so that a block's bound is close to what it holds.
        order = np.lexsort((names, Tree.fit(x).assign(x)))
        x, y, names = x[order], y[order], names[order]
        model = cls(terms, idf, names, y, BlockMax(x), ([], []), prior)
        votes = np.array([model.vote(np.flatnonzero(row), row[row != 0], without=i)[0] for i, row in enumerate(x)])
        return cls(terms, idf, names, y, model.index, pooled(votes, y), prior)

    def vote(self, terms: np.ndarray, weights: np.ndarray, without: int | None = None) -> tuple[float, np.ndarray]:
        """The weighted share of label 1 among the nearest examples, and these."""
        rows, cosine = self.index.nearest(terms, weights, NEIGHBOURS + (without is not None))
        if without is not None:
            rows, cosine = rows[rows != without][:NEIGHBOURS], cosine[rows != without][:NEIGHBOURS]
        w = 1 / (np.maximum(0.0, 1 - cosine) + SOFT)
        return (float((w * self.toxic[rows]).sum() / w.sum()) if len(rows) else self.prior), rows

    def score(self, terms: np.ndarray, counts: np.ndarray) -> tuple[float, list[int], list[str]]:
        """Score, ids of the nearest examples, and the terms that speak most for them."""
        weights = counts * self.idf[terms]
        size = np.sqrt((weights * weights).sum())
        if self.index is None or not size > 0:
            return self.prior, [], []
        keep = weights > 0
        terms, weights = terms[keep], weights[keep] / size
        vote, rows = self.vote(terms, weights)
        first = np.lexsort((terms, -weights))[:3]
        return round(float(np.interp(vote, *self.line)), 9), self.ids[rows[:3]].tolist(), [self.terms[t] for t in terms[first]]


def _score_batches(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple] = {}
        for b in batches:
            out = []
            at, n = b.column(1), b.column(2)
            terms, counts = at.values.to_numpy(), n.values.to_numpy()
            ends = at.offsets.to_numpy()
            for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                t, c = terms[lo:hi], counts[lo:hi]
                key = t.tobytes() + c.tobytes()
                got = known.get(key)
                if got is None:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[key] = got = model.score(t, c)
                out.append(got)
            s, near, why = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, type=pa.float64()), pa.array(near, type=pa.list_(pa.int64())), pa.array(why, type=pa.list_(pa.string()))], schema=SCORED)

    return run


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = MAX_EXAMPLES) -> DataFrame:
    """``doc_id, held_out, score, predicted, neighbours, evidence`` of every document.

    ``score`` is the estimated chance of label 1, ``predicted`` 1 from 0.5 on; ``neighbours`` the ids of the three
    nearest examples, ``evidence`` the document's weightiest terms. Labels are learned only from rows that are not
    ``held_out``, and from about ``most`` of them. A document without any of the terms (null, empty or blank texts
    among them) gets the examples' share of label 1; without any example that is 0. Texts of any length are read
    whole. Equal texts get equal scores; ties of examples go to the lower place in the index; rows that are repeated
    get a row each; a null id stays and is not held out; an empty table gives no rows. Ids that ``labels`` repeats
    count by their majority, null labels not at all. Only the columns named are read, of ``labels`` the id and label.
    """
    bounded_batches(docs.sparkSession)
    chosen = examples(docs, labels, id_col, text_col, label_col, most)
    terms = vocabulary(chosen)
    kind = schema_of("doc_id long, terms array<int>, counts array<int>")
    counted = stored(texts(docs, id_col, text_col).mapInArrow(_count_batches(terms), kind), "toxicity-counts")
    n = counted.count()
    texts_with = {r.t: r.n for r in counted.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each term
    idf = np.array([np.log((1 + n) / (1 + texts_with.get(i, 0))) for i in range(len(terms))])
    held = sorted(chosen.select("doc_id", "text").mapInArrow(_count_batches(terms), kind).collect(), key=lambda r: (r.doc_id, r.terms, r.counts))  # bounded by ``most``
    label = {r.doc_id: r.toxic for r in chosen.select("doc_id", "toxic").collect()}
    model = Model.fit(terms, idf, [r.doc_id for r in held], [label[r.doc_id] for r in held], [(r.terms, r.counts) for r in held])
    # The counts are a small table in few files: dealt out, so that tasks don't grow with the corpus.
    dealt = counted.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    scored = dealt.mapInArrow(_score_batches(model), schema_of("doc_id long, score double, neighbours array<long>, evidence array<string>"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "neighbours", "evidence")
