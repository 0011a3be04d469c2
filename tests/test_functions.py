"""Column functions on hand-made values, and the invariants of the score."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from emberdesk.functions import score as S
from emberdesk.functions import text as T
from emberdesk.functions import url as U
from emberdesk.operators import cluster, rank

NOW = datetime(2026, 3, 20)


def each(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", f(F.col("v")).alias("o")).collect()
    return [r.o for r in sorted(rows, key=lambda r: r.i)]


def test_strip_urls(spark):
    values = ["look at https://example.com/a/b now", "www.example.org/x and text", "plain words", "see example.gov/page", ""]
    assert each(spark, values, T.strip_urls) == ["look at  now", "and text", "plain words", "see", ""]


def test_trimming_takes_every_white_space_there_is(spark):
    c = F.col("value")
    rows = spark.range(0x20, 0x30000).union(spark.range(0, 0x20)).where("id not between 55296 and 57343").selectExpr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32') as ch")
    rows = rows.select(F.concat("ch", F.lit(" a "), "ch", F.lit("b"), "ch", F.lit("\t"), "ch").alias("value"))
    assert rows.where(T.strip(c) != F.regexp_replace(c, r"(?U)^\s+|\s+$", "")).count() == 0 and rows.where("value like 'A a Ab%'").count() == 1
    plain = F.regexp_replace(c, r"(?U)\s+", " ")
    assert rows.where(T.clean_headline(c) != F.regexp_replace(F.regexp_replace(plain, r"(?U)#\w+\s*$", ""), r"(?U)^\s+|\s+$", "")).count() == 0


def test_canonical_links(spark):
    cases = {
        "https://www.Example.com/a?utm_source=x&id=7#top": "https://example.com/a?id=7",
        "http://example.com:80/a;p?b=&c=2&c=3&b=1": "http://example.com/a?c=2&c=3&b=1",
        "https://user@example.com:8080/a/": "https://example.com:8080/a/",
        "https://m.youtube.com/shorts/abc?si=1": "https://youtube.com/watch?v=abc",
        "https://youtu.be/abc": "https://youtube.com/abc",
        "https://e.com/?q=a%20b~c": "https://e.com/?q=a+b~c",
        "": "",
    }
    assert each(spark, list(cases), U.canonical) == list(cases.values())


def test_domains(spark):
    assert each(spark, ["www.reuters.com", "reuters.com", "storage.courtlistener.com", "bsky.app", "x.bsky.app", "notreuters.com", None], U.bonus) == [2.0, 2.0, 3.5, 0.0, 0.0, 0.0, 0.0]
    assert each(spark, ["https://www.A.com:80/x", "at://did/x", None, "nonsense"], U.host) == ["a.com", "did", None, None]


def test_truncate(spark):
    t = "This is the first whole sentence. And then some more words follow here"
    assert each(spark, [t, "short", "w" * 70], lambda c: T.truncate(c, 50)) == ["This is the first whole sentence.", "short", "w" * 50 + "..."]


def test_commands_and_titles(spark):
    assert each(spark, ["Opt out.", "don't include me", " INCLUDE ME ", "hello", None], T.command) == ["opt_out", "opt_out", "opt_in", None, None]
    assert each(spark, ["The council votes on a bridge: https://x.com/a tolls!", "a b cd"], lambda c: T.title_key(F.lit("wire"), c)) == ["wire:bridge council tolls votes", None]
    assert each(spark, ["at://d/app/feed", "plain"], U.last_segment) == ["feed", "plain"]


def test_excerpts(spark):
    rows = spark.createDataFrame([("A headline.", "A headline and more"), ("Title of the article", "own words"), ("x", ""), (None, "t"), ("Long headline here", "Long")], "h string, t string")
    assert [r.d for r in rows.select(T.excerpt_differs(F.col("h"), F.col("t")).alias("d")).collect()] == [False, True, False, False, False]


def post(**kw):
    base = {
        "uri": "test://1", "author_did": "did:1", "created_at": NOW, "text": "", "reply_to_uri": None, "root_uri": None, "quote_uri": None, "external_uri": "https://example.com/a", "external_domain": "example.com",
        "has_external_embed": True, "has_image": False, "has_video": False, "is_repost": False, "link_count": 1, "facets_count": 0, "is_known": False, "handle": None, "seed_class": None, "trusted_score": None, "posts_24h": 0, "stink_score": 0.0, "outsider_posts": 0, "age_hours": 0.0,
    }
    return base | kw


TYPES = "uri string, author_did string, created_at timestamp_ntz, text string, reply_to_uri string, root_uri string, quote_uri string, external_uri string, external_domain string, has_external_embed boolean, has_image boolean, has_video boolean, is_repost boolean, link_count long, facets_count long, is_known boolean, handle string, seed_class string, trusted_score double, posts_24h long, stink_score double, outsider_posts long, age_hours double"


def scored(spark, *posts):
    names = [t.split()[0] for t in TYPES.split(", ")]
    return S.scored(spark.createDataFrame([tuple(p[n] for n in names) for p in posts], TYPES)).collect()


def test_relay_penalties(spark):
    dump, short, real = scored(spark, post(text="https://example.com/a"), post(text="This is worth a look today https://example.com/a"), post(text="A long and thoughtful comment on why this matters so much to all of us here " * 2))
    assert "relay:-3" in dump.reasons
    assert "low_commentary:-1.5" in short.reasons
    assert not {"relay:-3", "low_commentary:-1.5"} & set(real.reasons)


def test_stink_and_rank_of_graph_members(spark):
    known = {"is_known": True, "handle": "h", "seed_class": "mutual", "trusted_score": 4.0}
    high, low, mutual, outsider = scored(spark, post(stink_score=0.85, **known), post(stink_score=0.2, **known), post(external_domain="congress.gov", **known), post(external_domain="congress.gov"))
    assert any(r.startswith("stink") for r in high.reasons) and not any(r.startswith("stink") for r in low.reasons)
    assert mutual.score > outsider.score


def test_representatives(spark):
    long = "a comment of real length that says something about the matter at hand, with care"
    rows = [("a", "x", 9.0, ["unknown_author"], "relay https://e.com/1"), ("b", "y", 1.0, ["mutual"], long), ("c", "z", 5.0, ["mutual"], "lazy")]
    df = spark.createDataFrame([(u, a, s, r, t, "https://e.com/1", "e.com", None, None, k) for k, (u, a, s, r, t) in enumerate(rows)], "uri string, author_did string, score_r double, reasons array<string>, text string, external_uri string, external_domain string, root_uri string, quote_uri string, rank int")
    assert [r.uri for r in cluster.members(df).orderBy("place").collect()] == ["b", "c", "a"]


@pytest.mark.parametrize("block", [5, 40, 2000])
def test_composition_equals_a_plain_loop(spark, block):
    import random

    rng = random.Random(block)
    rows = [(f"u{i}", f"a{rng.randrange(12)}", datetime(2026, 1, 1, rng.randrange(24)), None if rng.random() < 0.5 else f"r{rng.randrange(9)}", None if rng.random() < 0.4 else f"l{rng.randrange(20)}", round(rng.random() * 9, 1)) for i in range(300)]
    df = spark.createDataFrame(rows, "uri string, author_did string, created_at timestamp_ntz, root_uri string, external_uri string, score double")
    order = sorted(rows, key=lambda r: (-r[5], -r[2].timestamp(), r[0]))
    from collections import Counter

    kept, a, t, link = [], Counter(), Counter(), Counter()
    for u, who, _, root, ext, _ in order:
        if len(kept) < 20 and a[who] < 2 and t[root or u] < 3 and (not ext or link[ext] < 2):
            kept.append(u)
            a[who] += 1
            t[root or u] += 1
            link[ext] += bool(ext)
    got = rank.composed(df, size=20, block=block).orderBy("rank").collect()
    assert [r.uri for r in got] == kept
