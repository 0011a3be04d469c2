from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from emberdesk import schema, shared
from emberdesk.engine import Engine
from emberdesk.operators import cluster, display, edition, state, views
from emberdesk.plans.queries import Feed
from emberdesk.sources import commits, fixtures
from emberdesk.streaming import ingest

SF = "/root/testdata/sf0.001"


def test_upsert_keeps_other_columns(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "k int, v string, w int")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, state.upsert(old, new, "k", ["k", "v"]).collect())) == [(1, "a", 5), (2, "c", 6), (3, "d", None)]


def test_partitions_are_replaced_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    state.append(spark.createDataFrame([(1, "a"), (2, "b")], "x int, feed_name string"), path)
    state.replace_partition(spark.createDataFrame([(9, "a")], "x int, feed_name string"), path)
    assert sorted((r.x, r.feed_name) for r in spark.read.parquet(path).collect()) == [(2, "b"), (9, "a")]


def test_lifecycle(spark):
    old = spark.createDataFrame([("a", 1, "emerging"), ("b", 2, "active"), ("c", 4, "persistent")], "cluster_id string, editions_present int, state string")
    now = spark.createDataFrame([("a",), ("b",), ("d",)], "cluster_id string")
    assert {r.cluster_id: (r.editions_present, r.state) for r in cluster.lifecycle(old, now).collect()} == {"a": (2, "active"), "b": (3, "persistent"), "c": (4, "fading"), "d": (1, "emerging")}


def test_samples_repeat_and_vary(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(20)], "id int, kind string")
    one, two = (state.sampled(rows, "kind", "id", F.lit(7), 2).collect() for _ in range(2))
    assert one == two and {r.kind for r in one} == {"a", "b"}


def test_tags_dedupe_by_category(spark):
    rows = [["mutual", "flood:-1.0", "original", "has_link", "domain:congress.gov:+3.5", "substance:+1.0"], ["followed", "domain:x.com:+0.5", "substantive_reply", "substance:+1.3"], ["domain:e.org:+1.5", "domain:x"], []]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, reasons array<string>")
    got = {r.k: r for r in df.select("k", edition.tags(F.col("reasons")).alias("t"), edition.tags(F.col("reasons"), 2, F.lit("fading")).alias("u"), edition.tags(F.col("reasons"), 2, F.lit("active")).alias("v")).collect()}
    assert [[(t.css, t.label) for t in got[k].t] for k in range(4)] == [
        [("mutual", "mutual"), ("original", "original"), ("link", "linked"), ("source", "primary source")], [("graph", "graph"), ("link", "x.com"), ("substance", "good reply")], [("reporting", "reporting")], [],
    ]
    assert [t.label for t in got[0].u] == ["fading", "mutual"] and [t.label for t in got[0].v] == ["mutual", "original"] and [t.css for t in got[3].u] == ["state-fading"]


def test_views(spark):
    view = '{"uri":"at://d/app.bsky.feed.post/1","author":{"did":"d","handle":"h","labels":[]},"record":{"text":"short"},"embed":{"$type":"app.bsky.embed.record#view","record":{"embeds":[{"$type":"app.bsky.embed.external#view","external":{"uri":"https://e.com","title":"A proper headline"}}]}}}'
    hidden = view.replace('"labels":[]', '"labels":[{"val":"!no-unauthenticated"}]')
    rows = views.shown(spark.createDataFrame([(view,), (hidden,)], "v string").select(F.from_json("v", views.VIEW).alias("j")).select("j.*")).collect()
    assert [(r.external_uri, r.display_headline, r.web_url) for r in rows] == [("https://e.com", "A proper headline", "https://bsky.app/profile/d/post/1")]


def test_parsing_odd_frames(spark):
    now = datetime(2026, 3, 20)
    lines = [
        "junk", '{"kind":"identity","did":"d"}', '{"kind":"commit","did":"d","commit":{"operation":"delete","collection":"app.bsky.feed.post","rkey":"1"}}',
        '{"kind":"commit","did":"d","time_us":1774000000000000,"commit":{"operation":"create","collection":"app.bsky.feed.post","rkey":"2","record":{"text":"t","embed":{"$type":"app.bsky.embed.recordWithMedia","media":{"external":{"uri":"https://www.e.com/x"}}},"facets":[{"features":[{"$type":"app.bsky.richtext.facet#link"},{"$type":"other"}]}]}}}',
        '{"kind":"commit","did":"d","commit":{"operation":"create","collection":"app.bsky.graph.follow","rkey":"3"}}',
    ]
    got = {r.uri: r for r in commits.parsed(spark.createDataFrame([(x,) for x in lines], "value string"), now).collect()}
    assert sorted(got) == ["at://d/app.bsky.feed.post/1", "at://d/app.bsky.feed.post/2"]
    two = got["at://d/app.bsky.feed.post/2"]
    assert (two.external_domain, two.link_count, two.facets_count, two.op) == ("e.com", 1, 1, "create")
    assert got["at://d/app.bsky.feed.post/1"].op == "delete"


def test_exclusions(spark):
    held = spark.createDataFrame([("a", 0, "page", "excluded", "n"), ("b", 0, "dm", "included", None)], "did string, requested_at int, source string, state string, note string")
    said = spark.createDataFrame([("a", 1, "opt_in"), ("b", 2, "opt_out"), ("c", 1, "opt_in"), ("d", 1, "opt_out"), ("d", 5, "opt_in")], "did string, sent_at int, command string")
    got = {r.did: (r.requested_at, r.source, r.state, r.note) for r in state.exclusions(held, said).collect()}
    assert got == {"a": (1, "page", "included", "n"), "b": (2, "dm", "excluded", ""), "d": (5, "dm", "included", "")}


def test_every_table_takes_older_rows(spark):
    for name in schema.TABLES:
        old = spark.createDataFrame([(1,)], "unknown int")
        got = schema.migrated(old, name)
        assert got.schema.fieldNames() == schema.schema(name).fieldNames() and got.first()[0] is None


def test_release_removes_what_was_stored(spark):
    kept = shared.stored(spark.range(3), "test")
    assert kept.count() == 3 and shared.release(spark) >= 1 and shared.release(spark) == 0


def test_a_cluster_without_a_shared_folder_is_refused():
    class Session:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return {}

        class conf:  # noqa: N801
            @staticmethod
            def get(*_):
                return None

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session)


def test_hourly_stream(spark, tmp_path):
    at = datetime(2026, 1, 1)
    spark.createDataFrame([(at + timedelta(minutes=20 * k), "click") for k in range(9)], "ts timestamp_ntz, event_type string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp_ntz, event_type string").parquet(str(tmp_path / "in"))
    q = ingest.hourly(stream).writeStream.format("memory").queryName("hourly").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.n for r in spark.table("hourly").orderBy("window").collect()] == [3, 3, 3]


def test_engine(spark):
    f = Feed(spark, SF)
    e = Engine(spark, f.now, f.posts, f.known, f.commands, f.views, per_author=8)
    page = e.feed_page("ranked", 5).collect()
    assert len(page) == 5 and page[0].next_cursor is not None
    behind = e.feed_page("ranked", 5, page[0].next_cursor).collect()
    assert max(r.score for r in behind) < min(r.score for r in page)
    with pytest.raises(ValueError, match="UnknownFeed"):
        e.feed_page("none")
    with pytest.raises(ValueError, match="BadCursor"):
        e.feed_page("edition", 5, "x")
    story = e.clusters().orderBy(F.desc("cluster_score")).first()
    assert 0 < e.story(story.cluster_id).count() <= story.post_count
    assert e.top(3).count() == 3 and {r.rank for r in e.top(3).collect()} == {1, 2, 3}
    held = fixtures.editions(spark, SF).where("feed_name = 'view'")
    assert e.freeze(held, "x", "view").first().stats.edition_num == held.count() + 1
    members = cluster.members(e.ranked())
    assert members.count() == members.select("uri").distinct().count() == e.ranked().count()


def test_display(spark):
    items = spark.createDataFrame([(i, f"u{i}", f"Headline number {i}") for i in range(12)], "pos int, uri string, headline string")
    got = display.change_previews(items.where("pos < 9"), items.where("pos > 1")).collect()
    assert [(r.change, r.uri, r.total) for r in got] == [("new", "u0", 2), ("new", "u1", 2), ("fading", "u9", 3), ("fading", "u10", 3), ("fading", "u11", 3)]
    nameless = items.where("pos < 2").withColumn("headline", F.lit(""))
    assert [(r.change, r.uri, r.total) for r in display.change_previews(nameless, items.limit(0)).collect()] == [("new", None, 2), ("fading", None, 0)]
    assert [(r.slice, r.side) for r in display.wire_slices(items).orderBy("pos").collect()] == [("strip", None)] * 5 + [(None, None)] + [("fold", k % 2) for k in range(6)]
    m = spark.createDataFrame([("c", "b", 1), ("c", "a", 2), ("c", "b", 3)], "cluster_id string, author_did string, place int")
    assert display.story_authors(m).collect()[0].authors == ["b", "a"]
    f = Feed(spark, SF)
    assert display.high_water(f.commands, 1).collect()[0].high_water == 3 and display.high_water(f.commands.where("sent_at > 9"), 7).collect()[0].high_water == 7
    assert display.house_posts(f.posts, ["did:u0"]).count() <= 10
    assert {r.place for r in display.watched(f.posts, ["did:u3", "did:u1"]).collect()} == {1, 2}
    now = datetime(2026, 1, 2)
    rows = spark.createDataFrame([("2026-01-01T00:00:00Z",), ("nonsense",), (None,)], "v string").select(F.unix_seconds(display.utc(F.col("v"), now)).alias("s")).collect()
    assert [r.s for r in rows] == [1767225600, 1767312000, 1767312000]
