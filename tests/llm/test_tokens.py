import hashlib
import json
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from emberdesk.llm import bpe, dac, packing
from emberdesk.llm.common import vocabulary
from emberdesk.llm.encode import CachedEncoder


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_str(vocabulary())


def ids_of(tok, text):
    return tok.encode(text or "", add_special_tokens=False).ids


def test_encoders_agree_with_the_library(tok):
    rng = random.Random(1)
    odd = ["".join(rng.choice(" \n\tab é1'.,s<|\x85\x00×ÿ") for _ in range(rng.randrange(60))) for _ in range(1500)] + ["a\n \tb", "x <|endoftext|> y", " lead", "trail ", "don't WE'LL", "日本語 テキスト"]
    cached, prefix = CachedEncoder(vocabulary()), bpe.PrefixEncoder(vocabulary())
    for text in odd + odd:
        want = ids_of(tok, text)
        assert np.frombuffer(cached.encode(text), "<u4").tolist() == want
        assert prefix.encode(text) == want
        n, joined, decoded = prefix.digest(text)
        assert (n, joined, decoded) == (len(want), ",".join(map(str, want)), tok.decode(want, skip_special_tokens=False))


def test_texts_encoded_together_are_as_alone(tok):
    rng = random.Random(2)
    held = ["", "a" * 40 + " " + "b" * 15 + " c", "Anew\nline.\nEnd", "<|endoftext|>", "日本", ""] + ["".join(rng.choice(" \n\tabcé1'.,s") for _ in range(rng.randrange(90))) for _ in range(300)]
    enc = CachedEncoder(vocabulary())
    for _ in range(2):
        assert [x.tolist() for x in enc.encode_all(held)] == [ids_of(tok, t) for t in held]
    grown = CachedEncoder(vocabulary())
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 24))) for _ in range(60_000)]  # tables grow
    text = " ".join(words)
    assert grown.encode_all([text])[0].tolist() == ids_of(tok, text) == grown.encode_all([text])[0].tolist()


def test_other_pre_tokenizers_use_the_library(tok):
    spec = json.loads(vocabulary())
    spec["pre_tokenizer"]["add_prefix_space"] = True
    other = Tokenizer.from_str(json.dumps(spec))
    assert [x.tolist() for x in CachedEncoder(json.dumps(spec)).encode_all(["a b. c", ""])] == [ids_of(other, "a b. c"), []]


def test_prefix_encoder_refuses_other_rules():
    spec = json.loads(vocabulary())
    for part, name, value in (("pre_tokenizer", "add_prefix_space", True), ("pre_tokenizer", "use_regex", False), ("model", "ignore_merges", True), ("model", "end_of_word_suffix", "</w>")):
        other = spec | {part: spec[part] | {name: value}}
        with pytest.raises(ValueError, match="byte-level"):
            bpe.PrefixEncoder(json.dumps(other))
    with pytest.raises(ValueError, match="byte-level"):
        bpe.PrefixEncoder(json.dumps(spec | {"normalizer": {"type": "Lowercase"}}))


def test_a_full_cache_changes_nothing(tok):
    cached, prefix = CachedEncoder(vocabulary(), 3), bpe.PrefixEncoder(vocabulary(), 3)
    for text in ("alpha beta gamma delta", "delta epsilon, zeta eta", "alpha beta. gamma"):
        assert np.frombuffer(cached.encode(text), "<u4").tolist() == ids_of(tok, text) == list(map(int, prefix.joined(text).split(",")))


def test_round_trip_of_odd_rows(odd, empty, tok):
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(odd).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = Counter()
    for r in odd.collect():
        ids = ids_of(tok, r.text)
        want[r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))] += 1
    assert got == want
    assert bpe.round_trip(empty).count() == 0
    back = {(r.doc_id, r.text) for r in bpe.decode(bpe.encode(odd)).collect()}
    assert back == {(r.doc_id, r.text or "") for r in odd.collect()}


def test_codes_give_every_id_back():
    rng = np.random.default_rng(2)
    for ids in ([], [0], [255, 256, 65535, 65536, (1 << 32) - 1], rng.integers(0, 70_000, 5000)):
        ids = np.asarray(ids, dtype=np.uint64)
        r = dac.DacReader(dac.dac_encode(ids))
        assert len(r) == len(ids) and (r.read(0, len(r)) == ids).all()
        for i in rng.integers(0, max(1, len(ids)), 100 if len(ids) else 0):
            assert r[int(i)] == ids[i] and (r.read(int(i), int(i) + 77) == ids[i : i + 77]).all()
    with pytest.raises(IndexError):
        r[len(r)]
    with pytest.raises(ValueError):
        dac.dac_encode(np.array([1 << 40], dtype=np.uint64))


def test_token_files_keep_the_order_of_ids(odd, empty, tok):
    got = dac.token_ranges(odd, segment_tokens=500).collect()
    assert sum(r.n_tokens for r in got) == max(r.start + r.n_tokens for r in got)
    by_start = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in by_start] == sorted((r.doc_id for r in got), key=lambda i: -1 if i is None else i)
    at = 0
    for r in by_start:
        assert r.start == at
        at += r.n_tokens
    crc = lambda t: zlib.crc32(np.array([*ids_of(tok, t), 2], dtype="<u4").tobytes())
    assert Counter((r.doc_id, r.ids_crc32) for r in got) == Counter((r.doc_id, crc(r.text)) for r in odd.collect())
    assert dac.token_ranges(empty).count() == 0


def test_one_id_may_fill_several_parts(spark, tok):
    rows = [(7, f"text {k}") for k in range(60)] + [(k, f"own {k}") for k in range(20)] + [(None, "n")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(dac.token_ranges(docs, segment_tokens=5).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got[:-1])]).tolist()
    want = Counter((d, zlib.crc32(np.array([*ids_of(tok, t), 2], "<u4").tobytes())) for d, t in rows)
    assert Counter((r.doc_id, r.ids_crc32) for r in got) == want


def test_packing_holds_every_piece_once(odd, empty, tok):
    got = packing.pack(odd, capacity=64).collect()
    assert all(0 < r.length <= 64 and r.offset + r.length <= 64 for r in got)
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
    want = Counter()
    for r in odd.collect():
        ids = np.array([*ids_of(tok, r.text), 0], dtype="<u4")
        cut = (len(ids) - 1) % 64 + 1
        edges = [0, *range(cut, len(ids) + 1, 64)]
        for i, (a, e) in enumerate(zip(edges, edges[1:], strict=False)):
            want[r.doc_id, i, a, e - a, zlib.crc32(ids[a:e].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert len(by_sequence) <= max(-(-sum(r.length for r in got) // 64), sum(r.length > 32 for r in got)) + 1
    assert packing.pack(empty).count() == 0


def least_bins(items, capacity):
    """Exact, for a few items."""
    best = len(items)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= items[i]}.values():
            go(i + 1, [*rooms[:k], rooms[k] - items[i], *rooms[k + 1 :]])
        go(i + 1, [*rooms, capacity - items[i]])

    go(0, [])
    return best


def test_bin_completion_reaches_the_optimum():
    rng = random.Random(3)
    for _ in range(60):
        items = sorted((rng.randint(3, 20) for _ in range(rng.randint(1, 10))), reverse=True)
        plan = packing.pack_lengths(np.bincount(items, minlength=21), 20)
        assert sum(t for _, t in plan) == least_bins(items, 20)
        held = Counter()
        for pattern, times in plan:
            assert sum(k * c for k, c in pattern.items()) <= 20
            for k, c in pattern.items():
                held[k] += c * times
        assert held == Counter(items)
    assert packing.pack_lengths(np.zeros(21, dtype=int), 20) == []


def test_lower_bound_is_below_every_packing_and_often_met():
    rng = np.random.default_rng(8)
    met = 0
    for _ in range(60):
        sizes = rng.integers(1, 21, 9).tolist()
        counts = np.bincount(sizes, minlength=21)
        bound = packing.lower_bound(counts, 20)
        made = sum(t for _, t in packing.pack_lengths(counts, 20, nodes=3000, width=20))
        assert bound <= made
        met += bound == made
    assert met >= 50


def test_search_beats_best_fit_where_it_can():
    rng = np.random.default_rng(3)
    counts = np.bincount(rng.integers(400, 900, 600), minlength=2049)
    plain = sum(t for _, t in packing.pack_lengths(counts, 2048, nodes=0))
    searched = packing.pack_lengths(counts, 2048, nodes=3000)
    used = np.zeros(2049, dtype=int)
    for pattern, times in searched:
        assert sum(k * c for k, c in pattern.items()) <= 2048
        for k, c in pattern.items():
            used[k] += c * times
    assert (used == counts).all() and packing.lower_bound(counts, 2048) <= sum(t for _, t in searched) <= plain
