import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberdesk.llm import anchors, neardup, suffixes, windows

SPACES = " \t\n\x0b\x0c\r"


def split(text):
    for c in SPACES:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def test_suffix_array_is_the_sorted_order():
    rng = random.Random(1)
    for _ in range(200):
        t = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 60)))
        data = np.concatenate([np.frombuffer(t, np.uint8), np.zeros(200, np.uint8)])
        order = suffixes.suffix_array(data, len(t), 100)
        assert [t[i:] for i in order] == sorted(t[i:] for i in range(len(t)))
        lcp = suffixes.common_prefixes(data, order, 100)
        for a, b, n in zip(order, order[1:], lcp, strict=False):
            x, y = t[a:] + bytes(100), t[b:] + bytes(100)
            assert n == next((k for k in range(100) if x[k] != y[k]), 100)


def test_repeated_windows_against_counts():
    rng = random.Random(2)
    for k in range(150):
        cs = [bytes(rng.choice(b"ab" if k % 2 else b"abcdefgh") for _ in range(rng.randint(0, 60))) for _ in range(5)]
        cs += [cs[0][:30] + b"zz" + cs[1]]
        w = rng.choice([8, 16, 17])
        n = Counter(c[i : i + w] for c in cs for i in range(len(c) - w + 1))
        assert [f.tolist() for f in suffixes.repeated_windows(cs, w)] == [[n[c[i : i + w]] > 1 for i in range(len(c) - w + 1)] for c in cs]


def brute_bytes(rows, w):
    n = Counter(t[i : i + w] for _, t in rows for i in range(len(t) - w + 1))
    for d, t in rows:
        gone = [False] * len(t)
        for i in range(len(t) - w + 1):
            if n[t[i : i + w]] > 1:
                gone[i : i + w] = [True] * w
        spans = sum(g and not p for g, p in zip(gone, [False, *gone], strict=False))
        yield d, len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()


def test_suffix_dedup_of_odd_rows(odd, plain, empty):
    for rows in (odd, plain):
        held = [(r.doc_id, (r.text or "").encode()) for r in rows.collect()]
        for w in (200, 40):
            assert Counter(map(tuple, suffixes.dedup(rows, w).collect())) == Counter(brute_bytes(held, w))
    assert suffixes.dedup(empty).count() == 0
    kept = {r.doc_id: bytes(r.kept) for r in suffixes.kept_bytes(plain).collect()}
    digest = {r.doc_id: r.kept_sha256 for r in suffixes.dedup(plain).collect()}
    assert {d: hashlib.sha256(k).hexdigest() for d, k in kept.items()} == digest


def brute_words(rows, w):
    """Rows ``id, text`` or, where ids repeat or are null, ``id, text, hash of the text``."""
    first = {}
    place = lambda r, i: (r[0] is not None, r[0] or 0, i, *r[2:])
    for r in rows:
        x = split(r[1])
        for i in range(len(x) - w + 1):
            k = tuple(x[i : i + w])
            first[k] = min(first.get(k, place(r, i)), place(r, i))
    for r in rows:
        d, x = r[0], split(r[1])
        gone = [False] * len(x)
        for i in range(len(x) - w + 1):
            if first[tuple(x[i : i + w])] != place(r, i):
                gone[i : i + w] = [True] * w
        yield d, len(x), sum(gone), hashlib.sha256(" ".join(a for a, g in zip(x, gone, strict=True) if not g).encode()).hexdigest()


def test_anchor_dedup_of_odd_rows(odd, plain, empty):
    held = [(r.doc_id, r.text or "") for r in plain.collect()]
    for w in (20, 6):
        assert Counter(map(tuple, anchors.dedup(plain, w).collect())) == Counter(brute_words(held, w))
    held = [(r.doc_id, r.text or "", r.h) for r in odd.withColumn("h", F.xxhash64(F.coalesce("text", F.lit("")))).select("doc_id", "text", "h").collect()]
    for w in (20, 6):
        assert Counter(map(tuple, anchors.dedup(odd, w).collect())) == Counter(brute_words(held, w))
    assert anchors.dedup(empty).count() == 0


def _contents(rng, n, size):
    shared = rng.integers(1, 1 << 60, 30, dtype=np.uint64)
    out = [rng.integers(1, 1 << 60, size, dtype=np.uint64) for _ in range(n)]
    for k in (1, 4, 6):
        at = int(rng.integers(0, size - 30))
        out[k][at : at + 30] = shared
    return out, np.array([(k, int(rng.integers(0, 40)), 0) for k in range(n)], dtype=np.int64)


def test_only_blocks_of_other_places_are_hits(monkeypatch):
    rng = np.random.default_rng(5)
    for _ in range(20):
        contents, firsts = _contents(rng, 8, 120)
        contents.append(contents[4][50:100])  # the same place once more, as contents overlap
        firsts = np.concatenate([firsts, [[4, firsts[4, 1] + 50, 0]]])
        seen = {}
        for c, (d, s, _) in zip(contents, firsts.tolist(), strict=True):
            for i in range(len(c) - 19):
                k = c[i : i + 20].tobytes()
                seen[k] = min(seen.get(k, (d, s + i)), (d, s + i))
        want = [[seen[c[i : i + 20].tobytes()] != (d, s + i) for i in range(len(c) - 19)] for c, (d, s, _) in zip(contents, firsts.tolist(), strict=True)]
        assert sum(map(sum, want)) == 2 * 11 + sum(want[8])
        hits = []
        probe = anchors.probe_hits
        monkeypatch.setattr(anchors, "probe_hits", lambda *a, probe=probe, hits=hits: hits.append(probe(*a)) or hits[-1])
        assert [f.tolist() for f in anchors.earlier_windows([c.tobytes() for c in contents], firsts, 20)] == want
        assert 0 < hits[0].sum() <= 4 * 21  # of about a thousand rolling blocks
        monkeypatch.setattr(anchors, "probe_hits", lambda units, *a: np.zeros(max(0, len(units) - 9), dtype=bool))
        assert not any(f.any() for f in anchors.earlier_windows([c.tobytes() for c in contents], firsts, 20))
        monkeypatch.undo()


def test_maximal_repeats_join_neighbours_with_one_source():
    assert anchors.maximal_repeats(np.array([7, 5, 6, 20, 21]), np.array([2, 0, 1, 9, 3]), 4) == [(5, 11, 0), (20, 24, 9), (21, 25, 3)]
    assert anchors.maximal_repeats(np.zeros(0, int), np.zeros(0, int), 4) == []


def test_strip_keeps_columns_and_what_is_first(odd, plain, empty):
    out = anchors.strip(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    sizes = {r.doc_id: (r.n_words, r.n_removed) for r in anchors.dedup(plain).collect()}
    before = {r.doc_id: r.text for r in plain.collect()}
    for r in anchors.strip(plain).collect():
        n, gone = sizes[r.doc_id]
        assert r.text == before[r.doc_id] if not gone else len(split(r.text)) == n - gone
    assert anchors.strip(empty).count() == 0


def test_rolling_hashes_tell_windows_apart():
    units = np.array([1, 2, 3, 1, 2, 3, 4], dtype=np.uint64)
    for w in (1, 2, 3, 5, 7):
        h = anchors.rolling(units, w)
        assert len(h) == len(units) - w + 1
        for i in range(len(h)):
            for j in range(len(h)):
                assert (h[i] == h[j]) == (units[i : i + w] == units[j : j + w]).all()


def test_hot_keys_are_split_without_loss(monkeypatch, plain):
    monkeypatch.setattr(windows, "HOT_CONTENTS", 1)
    held = [(r.doc_id, (r.text or "").encode()) for r in plain.collect()]
    assert Counter(map(tuple, suffixes.dedup(plain, 40).collect())) == Counter(brute_bytes(held, 40))
    held = [(r.doc_id, r.text or "") for r in plain.collect()]
    assert Counter(map(tuple, anchors.dedup(plain, 6).collect())) == Counter(brute_words(held, 6))


def test_parts_hold_every_window_once_and_agree():
    rng = np.random.default_rng(3)
    for how, units in ((suffixes.byte_units(40), rng.integers(97, 100, 400).astype(np.uint8)), (anchors.word_units(20), rng.integers(1, 6, 400).astype(np.uint64))):
        doc, start, n, _ = windows.cut_stretches(units, np.array([len(units)]), how)
        groups = {}
        for s, k in zip(start, n, strict=True):
            own = units[s : s + k + how.window - 1]
            for depth in (1, 3, 9):
                seen = np.zeros(k, dtype=int)
                for off, m, fixed in windows.parts_of(own, int(k), how, depth):
                    seen[off : off + m] += 1
                    for i in range(off, off + m):
                        assert groups.setdefault((depth, own[i : i + how.window].tobytes()), fixed) == fixed
                assert (seen == 1).all()


def test_a_hot_passage_makes_no_group_of_all_its_texts(monkeypatch, spark):
    rng = random.Random(5)
    some = lambda n: " ".join(f"w{rng.randint(0, 10**5)}" for _ in range(n))
    passage = some(45)
    rows = [(i, f"{some(30)} {passage} {some(30)}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(windows, "HOT_CONTENTS", 2)
    monkeypatch.setattr(windows, "BLOCK_BYTES", 0)  # each group is compared alone

    def bounded(keyed, how, compare, name, first_stays):
        def checked(contents, firsts):
            if len(contents) > 40:
                raise ValueError(f"a group of {len(contents)}")
            return compare(contents, firsts)

        return windows.repeats(keyed, how, checked, name, first_stays)

    monkeypatch.setattr(suffixes, "repeats", bounded)
    monkeypatch.setattr(anchors, "repeats", bounded)
    assert Counter(map(tuple, suffixes.dedup(docs, 40).collect())) == Counter(brute_bytes([(d, t.encode()) for d, t in rows], 40))
    assert Counter(map(tuple, anchors.dedup(docs, 20).collect())) == Counter(brute_words(rows, 20))


def test_cuts_end_at_single_windows():
    rng = np.random.default_rng(8)
    for how, units in ((suffixes.byte_units(40), rng.integers(97, 100, 400).astype(np.uint8)), (suffixes.byte_units(41), rng.integers(97, 123, 400).astype(np.uint8)), (anchors.word_units(20), rng.integers(1, 6, 400).astype(np.uint64))):
        _, start, n, _ = windows.cut_stretches(units, np.array([len(units)]), how)
        for s, k in zip(start, n, strict=True):
            own = units[s : s + k + how.window - 1]
            parts = sorted(windows.parts_of(own, int(k), how, 20))
            assert parts == [(i, 1, own[i : i + how.window].tobytes()) for i in range(k)]


def shingles(text):
    x = split(text or "")
    return {tuple(x[i : i + 5]) for i in range(len(x) - 4)} if len(x) >= 5 else ({tuple(x)} if x else set())


def brute_classes(rows):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    least = {}
    for (d, _), c in zip(rows, label, strict=True):
        least[c] = min(least.get(c, d), d)
    return {d: least[c] for (d, _), c in zip(rows, label, strict=True)}


def odd_classes(odd):
    """Classes of rows with repeated and null ids, with plain code: equal and near texts, least id first, null before all."""
    rows = [(r.doc_id, r.text or "") for r in odd.collect()]
    texts = sorted({t for _, t in rows})
    of = {t: c for t, c in zip(texts, [brute_classes(list(enumerate(texts)))[i] for i in range(len(texts))], strict=True)}
    low = lambda d: -1 if d is None else d
    least = {}
    for d, t in rows:
        if split(t):
            least[of[t]] = min(least.get(of[t], low(d)), low(d))
    return Counter((d, d if not split(t) else None if least[of[t]] < 0 else least[of[t]]) for d, t in rows)


def test_rare_groups_hold_every_near_pair(spark):
    rng = random.Random(17)
    common = [f"c{k}" for k in range(60)]
    texts = []
    for k in range(60):
        words = list(common) if k % 3 else [f"o{k // 6}x{i}" for i in range(60)]
        for _ in range(rng.randrange(5)):
            words[rng.randrange(60)] = f"r{rng.randrange(40)}"
        texts.append(" ".join(words))
    bodies = spark.createDataFrame(list(enumerate(texts)), "sid long, text string")
    got = {r.sid: r.rare for r in neardup.rare_groups(bodies, bodies.select("sid"), 0.8).collect()}
    sets = []
    for t in texts:
        value, _, _ = neardup.shingle_sets([t.encode()])
        sets.append(set(value.tolist()))
    near = [(i, j) for i in range(60) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(near) > 20 and all(got[i] == got[j] for i, j in near) and len(set(got.values())) > 1


def test_classes_against_all_pairs(spark, plain, odd, empty):
    rng = random.Random(6)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(150)]
    more = []
    for k in range(60):  # a chain of edits: near to neighbours, not to all
        base[rng.randrange(150)] = f"e{k}"
        more.append((1000 + k, " ".join(base)))
    for k in range(40):  # copies that differ too much from each other
        other = list(base)
        for _ in range(6):
            other[rng.randrange(150)] = f"o{k}{rng.random()}"
        more.append((2000 + k, " ".join(other)))
    rows = plain.union(spark.createDataFrame(more, plain.schema))
    got = {r.doc_id: r.class_id for r in neardup.classes(rows).collect()}
    assert got == brute_classes([(r.doc_id, r.text) for r in rows.collect()])
    kept = neardup.keep_one(rows).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(got.values()))
    assert Counter((r.doc_id, r.class_id) for r in neardup.classes(odd).collect()) == odd_classes(odd)
    one = neardup.keep_one(odd)
    assert one.columns == odd.columns and one.where("doc_id = 900").count() <= 1
    assert neardup.classes(empty).count() == 0 and neardup.keep_one(empty).count() == 0


def test_a_line_repeated_often_hides_no_near_text(spark):
    rng = random.Random(12)
    rows = []
    for k in range(30):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(120)]
        line = words[60:75]
        rows.append((2 * k, " ".join(words)))
        rows.append((2 * k + 1, " ".join([*words[:60], *line * 40, *words[75:]])))
    # One shingle, once and nine times: sets that differ in counts alone.
    rows += [(900, "a a a a a"), (901, "a " * 13)]
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows) == {d: d - d % 2 for d, _ in rows}


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(4)
    value = rng.integers(1, 1 << 62, 300).astype(np.uint64)
    value.sort()
    wa, wb = rng.integers(1, 5, 300).astype(float), rng.integers(1, 5, 300).astype(float)
    wa[:60], wb[240:] = 0, 0
    a, b = wa > 0, wb > 0
    sig = neardup.prob_minhash(np.concatenate([value[a], value[b]]), np.concatenate([wa[a], wb[b]]), np.array([a.sum(), a.sum() + b.sum()]), 4000)
    both = np.flatnonzero(a & b)
    true = sum(1 / np.maximum(wa / wa[i], wb / wb[i]).sum() for i in both)
    assert abs((sig[0] == sig[1]).mean() - true) < 0.03


def test_components(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 90), (95, 100), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in neardup.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}
    assert neardup.components(links.where(F.lit(False))).count() == 0


def test_passing_tables_go_and_kept_ones_stay(spark):
    from emberdesk.llm import common
    from emberdesk.shared import shared_dir

    def there(df) -> bool:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0]).getParent()
        return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    assert shared_dir(spark)
    with common.passing(spark, keep=("b",)):
        a, b = common.stored(spark.range(3), "a"), common.stored(spark.range(4), "b")
        with common.passing(spark, keep=("c",)):
            c = common.stored(spark.range(5), "c")
        assert there(a) and there(c)
    assert not there(a) and not there(c) and there(b) and b.count() == 4
    with pytest.raises(ValueError), common.passing(spark, keep=()):
        d = common.stored(spark.range(6), "d")
        raise ValueError
    assert there(d)


def test_only_parts_that_may_repeat_reach_a_suffix_array(monkeypatch):
    rng, how = random.Random(5), suffixes.byte_units(40)
    texts = ["".join(rng.choices("ab", k=rng.randint(30, 300))).encode() for _ in range(60)]
    texts += [texts[0][:150] + t[:90] for t in texts[:20]] + [b"x" * 120, b"x" * 90, "é€ñ".encode() * 20]
    units, ends = how.load(texts)
    doc, start, n, key = windows.cut_stretches(units, ends, how)
    groups = {}
    for d, s, k, h in zip(doc.tolist(), start.tolist(), n.tolist(), key.tolist(), strict=True):
        groups.setdefault(h, {})[texts[d][s : s + k + 39]] = None
    contents = [c for g in groups.values() for c in g]
    seen, whole = [], suffixes.repeated_windows
    monkeypatch.setattr(suffixes, "repeated_windows", lambda cs, w: seen.append(sum(map(len, cs))) or whole(cs, w))
    assert [f.tolist() for f in suffixes._compared(contents, 40)] == [f.tolist() for f in whole(contents, 40)]
    assert seen[0] < sum(map(len, contents))

    pool = np.frombuffer(bytes(rng.choices(range(97, 123), k=20_000)), dtype=np.uint8)
    low = int(suffixes._byte_grams(pool).argmin())
    gram, sides = pool[low : low + 16].tobytes(), [bytes(rng.choices(range(97, 123), k=100)) for _ in range(40)]
    alone = [c for c in (a + gram + b for a, b in zip(sides[::2], sides[1::2], strict=True)) if int(suffixes._byte_grams(np.frombuffer(c, dtype=np.uint8)).argmin()) == 100]
    assert len(alone) > 1 and not any(f.any() for f in suffixes._compared(alone, 200)) and len(seen) == 1  # no side is another's: nothing to sort


def test_few_links_take_few_tasks_whatever_the_partitions(monkeypatch, spark):
    from emberdesk.llm import common

    monkeypatch.setattr(common, "_CALL", type("Call", (), {})())
    links = spark.createDataFrame([(i + 1, i) for i in range(40)], "a long, b long")
    before, read = spark.conf.get("spark.sql.shuffle.partitions"), []
    keep = neardup.stored
    monkeypatch.setattr(neardup, "stored", lambda df, name: read.append(keep(df, name)) or read[-1])
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert {r.root for r in neardup.components(links).collect()} == {0}
        with common.passing(spark, keep=("x",)):
            common.spread(5)
            assert len(common.stored(spark.range(500).repartition(64, "id"), "x").inputFiles()) <= common.LEAST_TASKS
        assert len(common.stored(spark.range(500).repartition(64, "id"), "x").inputFiles()) > common.LEAST_TASKS
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert all(len(t.inputFiles()) <= common.LEAST_TASKS for t in read[1:])
