import itertools
from collections import Counter

import corpus_pipeline
from emberdesk.llm import anchors, neardup, packing, privacy, quality, queries
from pyspark.sql import functions as F

#: Names that operators give to their own columns.
CLASHING = [
    "kept", "n_words", "cleaned", "columns", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_words", "n_removed_lines", "base_failed", "lines", "words", "h", "q", "fails", "doc", "th", "start", "n", "key",
    "content", "marks", "spans", "sub", "off", "data", "class_id", "class_d", "class_th", "root", "sid", "s1", "s2", "buckets", "band", "a", "b", "similarity", "base_sha256", "n_email", "piece", "length", "ids_crc32", "sequence_id",
    "offset", "salt", "rank", "before", "r", "kept_sha256", "n_removed", "absent", "with.dot",
]


def test_stages_keep_columns_and_decide(spark, odd, empty):
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == odd.columns, name
        rows = out.collect()
        assert rows and not Counter(r.doc_id for r in rows) - Counter(r.doc_id for r in docs.collect())
        docs = spark.createDataFrame(rows, odd.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0, name


def test_other_columns_may_have_any_name(spark, plain):
    docs = plain.select("doc_id", *[F.lit(f"held {c}").alias(c) for c in CLASHING[:20]], "text", *[F.lit(f"held {c}").alias(c) for c in CLASHING[20:]])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        if name != "packing":
            assert out.columns == docs.columns, name
            assert all(r[c] == f"held {c}" for r in out.collect() for c in CLASHING), name
        else:
            assert out.count() > 0


def test_every_operator_takes_any_other_column(spark, plain):
    docs = plain.withColumns({c: F.lit("x") for c in CLASHING if c != "with.dot"})
    for f in (quality.quality, neardup.classes, anchors.dedup, privacy.find, packing.pack):
        assert f(docs).count() >= plain.count()


def shingles(t):
    w = (t or "").split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def removed_repeats(docs):
    """Texts without the words of twenty-word windows that stand earlier, in plain Python."""
    import re

    seen, out = set(), {}
    for i in sorted(docs):
        places = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", docs[i])]
        words, gone = [docs[i][a:b] for a, b in places], set()
        for k in range(len(words) - 19):
            w = tuple(words[k : k + 20])
            if w in seen:
                gone.update(range(k, k + 20))
            seen.add(w)
        parts, at = [], 0
        for k, (_, b) in enumerate(places):
            if k not in gone:
                parts.append(docs[i][at:b])
            at = b
        parts.append(docs[i][at:])
        out[i] = "".join(parts).lstrip("\t\n\x0b\x0c\r ") if gone else docs[i]
    return out


def test_the_whole_run_against_plain_versions(spark, tmp_path):
    from tokenizers import Tokenizer

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    judged = {r.doc_id: r for r in quality.quality(docs).collect()}  # compared with plain rules in test_rules
    held = {i: r.cleaned for i, r in judged.items() if r.kept}
    sets, root = {i: shingles(t) for i, t in held.items()}, {i: i for i in held}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(held), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    held = removed_repeats({i: t for i, t in held.items() if find(i) == i})
    chain = privacy.train()
    held = {i: privacy.redacted(t, every) for (i, t), (_, every) in zip(held.items(), privacy.find_all(chain, list(held.values())), strict=True)}
    import zlib

    import numpy as np
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, text in held.items():
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        cut = (len(ids) - 1) % 2048 + 1
        for k, (lo, hi) in enumerate(zip([0, *range(cut, len(ids), 2048)], [cut, *range(cut + 2048, len(ids) + 1, 2048)], strict=True)):
            want[i, k, lo, hi - lo, zlib.crc32(np.array(ids[lo:hi], dtype="<u4").tobytes())] += 1
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    places = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    assert all(o == (p + n if s == q else 0) for (q, p, n), (s, o, _) in zip([(None, 0, 0), *places], places)) and all(o + n <= 2048 for _, o, n in places)


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))
