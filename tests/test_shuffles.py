"""What is shuffled and stored: texts of documents, not one for each post."""

from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from emberdesk.functions import score as S
from emberdesk.operators import edition, views
from emberdesk.plans import queries as Q
from emberdesk.plans.queries import Feed
from emberdesk.sources import fixtures, served

SF = "/root/testdata/sf0.001"


@contextmanager
def sort_merge_only(spark):
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def exchanged(df):
    """The columns of every shuffle in the plan."""

    def walk(node):
        if node.nodeName() == "Exchange":
            yield {node.output().apply(k).name() for k in range(node.output().size())}
        for k in range(node.children().size()):
            yield from walk(node.children().apply(k))

    return list(walk(df._jdf.queryExecution().executedPlan()))


def test_posts_shuffle_each_text_once_with_its_document(spark):
    with sort_merge_only(spark):
        found = exchanged(fixtures.posts(spark, SF))
    assert [c for c in found if c & {"body", "text"}] == [{"doc", "body", "lang", "source"}]


def test_the_posts_that_scores_read_are_held_without_texts(spark):
    f = Feed(spark, SF)
    assert "text" not in f.held.columns and {"text_len", "stripped_len"} <= set(f.held.columns)
    told = f.told(f.held.where("created_at >= timestamp_ntz'2024-01-25 00:00:00'"))
    want = f.posts.where("created_at >= timestamp_ntz'2024-01-25 00:00:00'")
    assert sorted((r.uri, r.text, len(r.text)) for r in want.collect()) == sorted((r.uri, r.text, r.text_len) for r in told.collect())


@pytest.mark.parametrize("uris", [[], ["at://did:u1/post/nothing"], None])
def test_a_few_posts_are_those_of_all(spark, uris):
    every = fixtures.posts(spark, SF)
    few = every.select("uri").where("event_id % 97 = 0") if uris is None else spark.createDataFrame([(u,) for u in uris], "uri string")
    want = sorted(map(str, every.join(few, "uri", "left_semi").select(*every.columns).collect()))
    with sort_merge_only(spark):
        got = fixtures.posts(spark, SF, few)
        assert exchanged(got.where("text is not null")) == exchanged(few)
    assert sorted(map(str, got.collect())) == want


def test_posts_are_measured_by_document_without_shuffling_texts(spark):
    with sort_merge_only(spark):
        found = exchanged(fixtures.measured(spark, SF))
    assert found and not [c for c in found if c & {"body", "bare", "text"}]


def test_lengths_from_a_document_are_those_of_the_whole_text(spark, tmp_path):
    bodies = ["", None, "  ", " see http://a.b/c ", "www.x.y", "plain", "\n lead", "trail \n", "a.com/x b", "a/b c.d", "x.org/", " wide ", "no end http://"]  # as many as go round with the rule's other periods
    spark.createDataFrame([(i, b, "en", f"s{i} x.com/y") for i, b in enumerate(bodies)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    urls = ["https://p.org/1", "not a link", " spaced http://x.y/z ", "plain", None]
    spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    rows = spark.range(4000).selectExpr("id as event_id", "timestamp_ntz'2024-01-01 00:00:00' as ts", "id % 97 as user_id", "element_at(array('click', 'view', 'error', 'purchase', 'signup'), cast(id % 5 + 1 as int)) as event_type")
    rows = rows.union(rows.selectExpr("event_id + 4000", "ts", "user_id", "'click'"))
    rows.write.parquet(f"{tmp_path}/events.parquet")
    want = S.measured(fixtures.posts(spark, str(tmp_path))).select("uri", "text_len", "stripped_len")
    got = fixtures.measured(spark, str(tmp_path)).select("uri", "text_len", "stripped_len")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.select("stripped_len").distinct().count() > 12


def test_lookups_shuffle_keys_alone(spark):
    with sort_merge_only(spark):
        found = exchanged(Q.REGISTRY["looked_up_views"][0](spark, SF))
    assert found and not [c for c in found if c & {"answer", "request", "text", "body", "view"}]


def test_a_store_of_views_answers_as_the_views_do(spark, tmp_path, monkeypatch):
    bodies = ["plain “quoted” \\ text\n\twith  ünïcode 🙂", None, "", "  see http://a.b/c  ", 'a "b" #tag ', " wide　"]
    spark.createDataFrame([(i * 3, b, "en", f"s{i}") for i, b in enumerate(bodies)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")  # with gaps
    spark.createDataFrame([(0, "https://p.org/1")], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    rows = spark.range(600).selectExpr("id as event_id", "timestamp_ntz'2024-01-01 00:00:00' as ts", "id % 97 as user_id", "element_at(array('click', 'view', 'error', 'purchase', 'signup'), cast(id % 7 % 5 + 1 as int)) as event_type")
    rows.union(rows.where("event_id < 50").withColumn("event_type", F.lit("view"))).union(rows.where("event_id = 1")).write.parquet(f"{tmp_path}/events.parquet")  # uris with several posts
    monkeypatch.setattr(served, "BUCKET_VIEWS", 100)
    shown = views.shown(fixtures.post_views(fixtures.posts(spark, str(tmp_path))))
    want = shown.select("uri", F.col("external_title").alias("title"), edition.display_headline().alias("headline"), "author_handle", "like_count").collect()
    got = Q.REGISTRY["looked_up_views"][0](spark, str(tmp_path)).collect()
    assert len(want) > 500 and sorted(map(str, got)) == sorted(map(str, want))


def test_a_store_holds_each_text_once_in_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(served, "BUCKET_TEXTS", 50)
    store = served.written(spark, SF, str(tmp_path))
    texts = spark.read.parquet(f"{tmp_path}/texts")
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    assert store.buckets == 4 and texts.groupBy("b").count().where("count > 50").count() == 0
    assert sorted(map(tuple, texts.select("doc", "body").collect())) == sorted(map(tuple, documents.select("doc_id", "text").collect()))
    uris = [r.uri for r in fixtures.posts(spark, SF).select("uri").limit(300).collect()]
    opened = []
    real = store._rows
    monkeypatch.setattr(store, "_rows", lambda kind, b: opened.append((kind, b)) or real(kind, b))
    ordered = [r.uri for r in spark.createDataFrame([(u,) for u in uris], "uri string").orderBy(*store.places(F.col("uri"))).collect()]
    for k in range(0, 300, 25):
        store(ordered[k : k + 25])
    assert sorted(opened) == [(kind, b) for kind in ("texts", "views") for b in range(4)]


def test_frames_land_compressed_with_repeats_side_by_side(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Q, "new_path", lambda s, name: f"file://{tmp_path}/{name}")
    with sort_merge_only(spark):
        told = Q.REGISTRY["landed_frames"][0](spark, SF).first()
    n = fixtures.posts(spark, SF).count()
    assert (told.posts, told.frames) == (n, n + told.deletes) and told.deletes == n // 50
    landed_bytes = sum(p.stat().st_size for p in (tmp_path / "landed").glob("part-*"))
    lines = spark.read.text(f"{tmp_path}/landed").where("value like '%commit%'")
    assert landed_bytes < lines.agg(F.sum(F.octet_length("value"))).first()[0] / 4
    rows = spark.read.format("frames").load(f"file://{tmp_path}/landed")
    assert sorted(r.value for r in rows.collect()) == sorted(r.value for r in lines.collect())
