import random

import pytest

WORDS = ["the", "ver", "tion", "and", "lo", "mi", "gen", "ör", "è", "consta", "retor", "in", "of", "alpha", "beta"]
SCHEMA = "doc_id long, text string, lang string, d long, th long, key string, content string, n int, start int, piece string, words string, lines string, sid string, value string, spans string, hashes string, q string"


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


def texts():
    """Texts of every odd kind: null, empty, blank, tiny, repeated, near, sharing passages, junk, long."""
    rng = random.Random(4)
    base, passage = sentence(rng, 120), sentence(rng, 45)
    near = base.split(" ")
    near[7] = "changed"
    out = [None, "", " \n\t ", "one", "one two three", base, base, " ".join(near), base + "\n" + base]
    out += [sentence(rng, 30) + " " + passage + " " + sentence(rng, 30) for _ in range(4)] + [passage]
    out += ["a b. " * 60, "x " * 300, "\n".join(["same line here."] * 20), "É" * 250 + " " + "É" * 250, "tok\x00en \U0001f600 \x85 z", "<|endoftext|> in  a   text \r\n b"]
    out += ["mail me at jo.doe@mail4.example.com or +1 (640) 555-0953, 4111 1111 1111 1111 from 10.0.0.1", 'token = "8f3a9c0b7d2e4f6a1b5c9d8e7f6a5b4c3d2e1f0a" done', sentence(rng, 9000)]
    return out


@pytest.fixture(scope="session")
def odd(spark):
    """Those texts with repeated rows, repeated and null ids, nulls elsewhere, and columns whose names operators use."""
    held = list(enumerate(texts())) + [(5, texts()[5]), (5, texts()[7]), (None, texts()[9]), (None, None), (900, texts()[9]), (900, texts()[9])]
    rest = (None,) * 14
    rows = [(i, t, "en" if i else None, *rest) for i, t in held]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def plain(spark, odd):
    """The same with ids that are unique and not null."""
    rows = [(i, r.text) for i, r in enumerate(sorted(odd.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "")))]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
