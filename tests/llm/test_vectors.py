import hashlib

import numpy as np
import pytest

from emberdesk.llm import lloyd, whiten

NAMES = ["part", "entry", "at", "n", "total", "v", "ids", "code", "error", "white", "component", "row_block", "__label"]


def table(spark, x, ids=None, labels=None):
    """Rows with columns whose names the operators use."""
    ids = range(len(x)) if ids is None else ids
    labels = [i % 3 if i % 5 else None for i in range(len(x))] if labels is None else labels
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], k, *[None] * len(NAMES)) for i, v, k in zip(ids, x, labels, strict=True)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, " + ", ".join(f"{c} string" for c in NAMES)).repartition(3)


def brute_codes(ids, x, labels, parts, entries, rounds):
    order = sorted(range(len(x)), key=lambda i: (ids[i] is None, ids[i] or 0, tuple(x[i])))
    v = np.floor(np.array(x, dtype=np.float32).astype(float) * 256).astype(int)
    w = v.shape[1] // parts
    books = [[v[i, p * w : p * w + w].tolist() for i in order[:entries]] for p in range(parts)]
    for k in range(rounds + 1):
        own = [[min((sum((a - b) ** 2 for a, b in zip(row[p * w : p * w + w], c, strict=True)), e) for e, c in enumerate(books[p])) for p in range(parts)] for row in v.tolist()]
        if k < rounds:
            for p in range(parts):
                for e in range(len(books[p])):
                    mine = [v[i, p * w : p * w + w] for i in range(len(v)) if own[i][p][1] == e]
                    if mine:
                        books[p][e] = [int(sum(c)) // len(mine) for c in np.array(mine).T.tolist()]
    errors = [sum(d for d, _ in o) for o in own]
    by_label = {k: sum(e for e, m in zip(errors, labels, strict=True) if m == k) for k in set(labels)}
    text = ",".join(str(c) for book in books for entry in book for c in entry)
    return sorted((str(i), "".join(f"{e:02x}" for _, e in o), err, by_label[k]) for i, o, err, k in zip(ids, own, errors, labels, strict=True)), hashlib.sha256(text.encode()).hexdigest()


def got_codes(df):
    rows = df.collect()
    return sorted((str(r.vec_id), r.code, r.error, r.label_error) for r in rows), {r.codebooks_sha256 for r in rows}


def test_codes_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8)) * 0.05
    x[40:140] = x[40]  # a third is alike
    x[200:230] = np.round(x[200:230] * 8) / 8
    ids = [*range(250, 0, -1), *[7] * 20, *[None] * 5, *range(1000, 1025)]
    labels = [None if i % 7 == 0 else i % 4 for i in range(300)]
    got, digests = got_codes(lloyd.codes_with_errors(table(spark, x, ids, labels), parts=4, entries=16))
    want, digest = brute_codes(ids, x, labels, 4, 16, 2)
    assert got == want and digests == {digest}


def test_a_label_join_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(lloyd, "BROADCAST_ROWS", 1)
    x = np.random.default_rng(2).normal(size=(60, 4))
    labels = [i % 5 or None for i in range(60)]
    assert got_codes(lloyd.codes_with_errors(table(spark, x, labels=labels), parts=2, entries=8))[0] == brute_codes(list(range(60)), x, labels, 2, 8, 2)[0]


def test_trees_assign_as_all_distances_do():
    rng = np.random.default_rng(3)
    for spread, n, k in ((3, 400, 20), (50, 1000, 64), (1, 70, 5), (4000, 3000, 64), (2, 1, 9)):
        x, entries = rng.integers(-spread, spread + 1, (n, 4)), rng.integers(-spread, spread + 1, (k, 4))
        tree = lloyd.Tree.unpacked(lloyd.Tree.build(x).packed(), 4)
        own, number, total = tree.assign(entries)
        want = ((x[:, None] - entries[None]) ** 2).sum(axis=2).argmin(axis=1)
        assert (own == want[tree.order]).all() and (number == np.bincount(want, minlength=k)).all()
        assert all((total[e] == x[want == e].sum(axis=0)).all() for e in range(k))


def test_whole_subtrees_are_assigned_without_their_points():
    rng = np.random.default_rng(4)
    centres = np.array([[-5000, 0], [5000, 0], [0, 90000], [0, -90000]])
    x = np.repeat(centres[:2], 1024, axis=0) + rng.integers(-40, 40, (2048, 2))
    tree = lloyd.Tree.build(x)
    tree.points[:] = 0  # no point is looked at
    _, number, total = tree.assign(centres)
    assert number.tolist() == [1024, 1024, 0, 0] and all((total[e] == x[e * 1024 : e * 1024 + 1024].sum(axis=0)).all() for e in range(2))


def test_odd_vectors_have_no_codes(spark):
    x = [[1, 2, 3, 4], None, [], [1, None, 2, 3], [float("nan"), 1, 2, 3], [float("inf"), 0, 0, 0], [1, 2], [0, 0, 0, 0], [-1.5, 0.001, -0.001, 2], [1, 2, 3, 4]]
    ids = [3, 1, 2, 4, 5, 6, 7, 8, None, 3]
    kept = [i for i in (0, 7, 8, 9)]
    got, digests = got_codes(lloyd.codes_with_errors(table(spark, x, ids, [None] * 10), parts=2))
    want, digest = brute_codes([ids[i] for i in kept], [x[i] for i in kept], [None] * 4, 2, 64, 2)
    assert got == want and digests == {digest}
    none = lloyd.codes_with_errors(table(spark, x, ids).where("vec_id = 1"))
    assert none.count() == 0 and none.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    with pytest.raises(ValueError):
        lloyd.encode(table(spark, [[1, 2, 3]]), parts=2)


def test_decoding_gives_the_entries(spark):
    x = np.random.default_rng(5).normal(size=(50, 8))
    codes, books = lloyd.encode(table(spark, x), parts=4, entries=64)
    for r in lloyd.decode(codes, books).collect():
        assert np.abs(np.array(r.approximation) - x[r.vec_id]).max() <= 0.5 / 256 + 1e-6  # as many entries as vectors
    assert lloyd.decode(spark.createDataFrame([(None,)], "code string"), books).collect()[0].approximation is None


def brute_white(x):
    v = np.floor(np.array(x, dtype=np.float32).astype(float) * 1024).astype(np.int64) + 100000
    n, s = len(v), v.sum(axis=0)
    y = v - s / n
    cov = y.T @ y / n
    e, u = np.linalg.eigh(cov)
    order = [i for i in np.argsort(-e) if e[i] > 1e-12 * e.max()][:8]
    far = [sum((n * int(c) - int(t)) ** 2 for c, t in zip(row, s, strict=True)) for row in v.tolist()]
    return far, y @ u[:, order] / np.sqrt(e[order]), e[order] / np.trace(cov)


@pytest.mark.parametrize("dims", [3, 32, 70])
def test_whitening_against_numpy(spark, dims, monkeypatch):
    monkeypatch.setattr(whiten, "BLOCK_ROWS", 57)  # several row blocks in a task
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, dims)) @ np.diag(np.linspace(2, 0.3, dims)) + 5
    x[100:240] = x[100]
    rows = whiten.whiten(table(spark, x)).collect()
    far, white, share = brute_white(x)
    assert len(rows) == 400 * min(dims, 8) and {r.n for r in rows} == {400}
    sign = {}
    for r in rows:
        want = white[r.vec_id, r.component - 1]
        if abs(want) > 1e-6:
            sign.setdefault(r.component, np.sign(want * r.whitened))
            assert abs(r.whitened - sign[r.component] * want) < 1e-7
        assert r.deviation == far[r.vec_id] and abs(r.explained - share[r.component - 1]) < 1e-12 and r.identity_error < 1e-9


def test_whitening_of_odd_vectors(spark):
    x = [[1, 2, 3], None, [], [1, None, 2], [float("nan"), 1, 2], [-float("inf"), 0, 0], [1, 2], [0, 0, 0], [-1.5, 0.001, 900], [1, 2, 3]]
    ids = [3, 1, 2, 4, 5, 6, 7, 8, None, 3]
    rows = whiten.whiten(table(spark, x, ids)).collect()
    far, white, _ = brute_white([x[i] for i in (0, 7, 8, 9)])
    assert sorted((str(r.vec_id), r.deviation) for r in rows) == sorted((str(ids[i]), f) for i, f in zip((0, 7, 8, 9), far, strict=True) for _ in range(white.shape[1]))
    assert whiten.whiten(table(spark, x, ids).where("vec_id = 1")).count() == 0
    assert whiten.whiten(table(spark, [[1, 2]] * 5)).count() == 0 and whiten.whiten(table(spark, [[1, 2]])).count() == 0


def test_large_components_keep_exact_sums(spark):
    rng = np.random.default_rng(7)
    x = np.round(rng.normal(size=(40, 2)) * 2**30)  # beyond what floats multiply exactly
    rows = whiten.whiten(table(spark, x)).collect()
    _, white, share = brute_white(x)
    assert np.allclose(sorted(abs(r.whitened) for r in rows), sorted(np.abs(white).ravel()), atol=1e-6) and {r.component for r in rows} == {1, 2}
    far = {i: f for i, f in enumerate(brute_white(x)[0])}
    assert all(r.deviation == (far[r.vec_id] if far[r.vec_id] < 1 << 63 else None) for r in rows)
