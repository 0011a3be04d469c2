import pickle
import random
import zlib

import numpy as np
import pytest

from emberdesk.llm import toxicity

BAD = ["vile", "rotten", "scoundrel", "wretched"]


def made(rng, toxic, n):
    words = [rng.choice(["the", "of", "and", "to"]) if rng.random() < 0.4 else "".join(rng.choice("bcdfgaeiou") for _ in range(6)) for _ in range(n)]
    for _ in range(max(2, n // 20) if toxic else 0):
        words[rng.randrange(n)] = rng.choice(BAD).capitalize() + rng.choice(["", ".", "!"])
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    rows = [(i, made(rng, i % 6 == 0, rng.choice([12, 40, 200, 900]))) for i in range(900)]
    rows += [(900 + i, rows[6][1]) for i in range(300)]  # a quarter is one text
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t in rows], "doc_id long, text string, toxic string, score double").repartition(4)
    labels = spark.createDataFrame([(i, 1 if i % 6 == 0 or i >= 900 else 0, i % 2) for i, _ in rows if i % 3 != 2], "doc_id long, toxic int, quality int").repartition(2)
    return rows, docs, labels


def test_held_out_labels_are_told(corpus):
    rows, docs, labels = corpus
    got = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    assert len(got) == len(rows)
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in rows)
    truth = {i: i % 6 == 0 or i >= 900 for i, _ in rows}
    unseen = [i for i, _ in rows if got[i].held_out or i % 3 == 2]
    assert sum((got[i].score >= 0.5) == truth[i] for i in unseen) / len(unseen) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert any(w in BAD for w in got[next(i for i in unseen if truth[i])].evidence)
    assert len({got[i].score for i in [6, *range(900, 1200)]}) == 1  # equal texts


def test_held_out_labels_and_other_columns_are_no_inputs(spark, corpus):
    _, docs, labels = corpus
    turned = labels.selectExpr("doc_id", "case when pmod(crc32(cast(cast(doc_id as string) as binary)), 5) = 0 then 1 - toxic else toxic end as toxic", "1 - quality as quality")
    scores = lambda d, k: {r.doc_id: (r.score, r.neighbours) for r in toxicity.score(d, k).collect()}
    assert scores(docs, labels) == scores(docs.select("text", "doc_id").repartition(7), turned.union(turned))


def test_a_bounded_sample_of_examples(spark, corpus, monkeypatch):
    rows, docs, labels = corpus
    chosen = toxicity.examples(docs, labels, "doc_id", "text", "toxic", 200)
    n = chosen.count()
    assert 100 < n <= 260
    got = {r.doc_id: r.score for r in toxicity.score(docs, labels, most=200).collect()}
    assert np.mean([(got[i] >= 0.5) == (i % 6 == 0) for i in range(900)]) > 0.93


def test_the_index_finds_what_all_products_find():
    rng = np.random.default_rng(2)
    for n, width in ((5, 3), (700, 40), (2000, 12)):
        x = np.round(rng.random((n, width)) * (rng.random((n, width)) < 0.2), 2)
        index = pickle.loads(pickle.dumps(toxicity.BlockMax(x)))
        for _ in range(20):
            q = np.round(rng.random(width) * (rng.random(width) < 0.5), 2)
            terms = np.flatnonzero(q)
            rows, found = index.nearest(terms, q[terms], 15)
            every = sum((x[:, t] * q[t] for t in terms), np.zeros(n))
            want = np.lexsort((np.arange(n), -every))[:15]
            assert rows.tolist() == want.tolist() and np.allclose(found, every[want])


def test_blocks_out_of_reach_are_not_read(monkeypatch):
    x = np.kron(np.eye(40), np.ones((64, 1)))
    index, read = toxicity.BlockMax(x), []
    plain = toxicity.BlockMax.scores
    monkeypatch.setattr(toxicity.BlockMax, "scores", lambda self, t, w, b: (read.append(len(b)), plain(self, t, w, b))[1])
    rows, _ = index.nearest(np.array([17]), np.array([1.0]), 15)
    assert rows.tolist() == list(range(17 * 64, 17 * 64 + 15)) and sum(read) <= toxicity.FIRST_BLOCKS


def test_pooling_rises():
    votes = np.array([0.0] * 40 + [0.2] * 40 + [0.4] * 40 + [0.9] * 40)
    truth = np.array([0] * 40 + [1] * 10 + [0] * 30 + [1] * 4 + [0] * 36 + [1] * 40, dtype=float)
    at, share = toxicity.pooled(votes, truth)
    assert at == sorted(at) and share == sorted(share) and share[0] < 0.05 and share[-1] > 0.95


def test_toxicity_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(5, 1), (5, 0), (7, 0), (9, None), (None, 1), (12, 1), (400, 1), (17, 0)], "doc_id long, toxic int")
    rows = toxicity.score(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(empty, labels).count() == 0
    assert {(r.score, r.predicted, r.held_out) for r in toxicity.score(odd, labels.where("doc_id = 400")).collect() if r.doc_id is None} == {(0.0, 0, False)}
