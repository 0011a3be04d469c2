import numpy as np
import pytest

from emberdesk.llm import ann


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16))
    x = (centres[rng.integers(0, 40, 3000)] + 0.4 * rng.normal(size=(3000, 16))).astype("float32")
    x[100:1100] = x[100]  # a third of the rows are alike
    return x, spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").repartition(4)


def brute(x, i, k):
    y = x.astype(float)
    s = (y * y[i]).sum(axis=1) / np.linalg.norm(y, axis=1) / np.linalg.norm(y[i])
    s[i] = -np.inf
    ids = np.lexsort((np.arange(len(x)), -np.round(s, 12)))[:k]
    return ids, s[ids]


def test_recall_ties_and_scores(table):
    x, rows = table
    found = {}
    for r in ann.search(rows, rows.where("vec_id % 50 = 0"), k=5).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = 0
    for q in range(0, 3000, 50):
        got = sorted(found[q])
        ids, scores = brute(x, q, 5)
        assert [g[0] for g in got] == [1, 2, 3, 4, 5] and q not in [g[1] for g in got]
        hits += len(set(ids) & {g[1] for g in got})
        if 100 <= q < 1100:
            assert [g[1] for g in got] == [i for i in range(100, 107) if i != q][:5]
    assert hits / (60 * 5) >= 0.9


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, None), (4, [0.0, 0.0]), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, []), (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (2, [1.0, 0.1]), (10, [0.0, 1.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, leaf string")
    got = [(r.query_id, r["rank"], r.vec_id) for r in ann.search(df, k=5).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 2), (1, 2, 10), (2, 1, 1), (2, 2, 10), (10, 1, 2), (10, 2, 1)]
    assert ann.search(df.where("vec_id is null")).count() == 0


def test_best_bin_first_visits_every_leaf_once(table):
    x, _ = table
    u = ann._unit(x.astype(float))
    tree = ann.Tree.fit(u)
    seen = list(tree.visit(u[7]))
    assert sorted(seen) == list(range(tree.leaves))
    assert seen[0] == tree.assign(u[7:8])[0]


def test_large_leaves_are_split_again(table, monkeypatch):
    x, rows = table
    rng = np.random.default_rng(9)
    u = ann._unit(rng.normal(size=(2000, 16)))
    tree = ann.Tree.fit(u[:600])
    before, leaf = tree.leaves, tree.assign(u)
    large = np.bincount(leaf, minlength=tree.leaves).argmax()
    monkeypatch.setattr(ann, "LEAF_ROWS", 16)
    part = ann.Tree.fit(u[leaf == large])
    tree.graft(int(large), part)
    assert part.leaves > 1 and tree.leaves == before + part.leaves - 1
    assert sorted(tree.visit(u[7])) == list(range(tree.leaves))
    deep = tree.assign(u)
    assert (deep[leaf != large] == leaf[leaf != large]).all() and set(deep[leaf == large]) <= {int(large), *range(before, tree.leaves)}
    assert all(next(tree.visit(u[i])) == deep[i] for i in range(0, 2000, 97))
    # A sample smaller than the table, leaves that are split in their own tasks.
    monkeypatch.setattr(ann, "FIT_ROWS", 400)
    monkeypatch.setattr(ann, "SPLIT_ROWS", 100)
    hits = 0
    found = {}
    for r in ann.search(rows, rows.where("vec_id % 50 = 0"), k=5).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    for q in range(0, 3000, 50):
        hits += len(set(brute(x, q, 5)[0]) & found[q])
    assert hits / 300 >= 0.9


def test_ids_with_several_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (2, [0.01, 1.0]), (3, [-1.0, 0.0])]
    got = [(r.query_id, r["rank"], r.vec_id) for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=2).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 2), (2, 1, 1), (3, 1, 1), (3, 2, 2)]
