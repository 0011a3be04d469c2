from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from emberdesk import cadence, dims, tables
from emberdesk.engine import Engine
from emberdesk.operators import lookup, rank, trailing
from emberdesk.plans.queries import Feed
from emberdesk.sources import fixtures

SF = "/root/testdata/sf0.001"


def folders_of(path):
    return {(p.parent.name, p.name) for p in path.glob("data/w=*/bucket=*")}


def test_an_upsert_writes_only_the_buckets_it_touches(spark, tmp_path):
    rows = spark.range(2000).select(F.concat(F.lit("k"), "id").alias("key"), F.lit("old").alias("value"), F.col("id").alias("n"))
    table = tables.Keyed(spark, str(tmp_path), "key", rows.schema, buckets=32)
    table.write(lambda a, b: a.unionByName(b), rows)
    before = folders_of(tmp_path)
    assert len(before) == 32 and table.read().count() == 2000
    new = spark.createDataFrame([("k5", "new"), ("k77", "new"), ("other", "new")], "key string, value string")
    touched = {r.b for r in new.select(table.bucket().alias("b")).collect()}
    assert table.upsert(new, ["key", "value"]) == len(touched)
    added = folders_of(tmp_path) - before
    assert {int(b[7:]) for _, b in added} == touched and len(added) == len(touched) <= 3
    assert {(r.key, r.value, r.n) for r in table.read().where("value = 'new'").collect()} == {("k5", "new", 5), ("k77", "new", 77), ("other", "new", None)}
    assert table.read(1).where("value = 'new'").count() == 0 and table.read().count() == 2001  # the version before is still there
    assert [r.value for r in table.lookup("k77").collect()] == ["new"] and len(table.lookup("k77").inputFiles()) == 1
    assert table.delete(spark.createDataFrame([("k5",), ("none",)], "key string")) <= 2 and table.read().count() == 2000
    assert table.vacuum(keep=1) >= 1 and table.read().count() == 2000 and table.versions() == [3]


def test_a_lost_write_leaves_the_version_before_readable(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(f"k{i}", i) for i in range(50)], "key string, n int")
    table = tables.Keyed(spark, str(tmp_path), "key", rows.schema, buckets=4)
    table.write(lambda a, b: a.unionByName(b), rows)

    def lost(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(tables.Keyed, "_publish", lost)
        with pytest.raises(RuntimeError, match="lost"):
            table.upsert(spark.createDataFrame([("k1", -1)], "key string, n int"), ["key", "n"])
    assert table.versions() == [1] and sorted(r.n for r in table.read().collect()) == list(range(50))
    table.upsert(spark.createDataFrame([("k1", -2)], "key string, n int"), ["key", "n"])  # goes beside what the lost one left
    assert sorted(r.n for r in table.read().collect())[:2] == [-2, 0] and table.read().count() == 50
    table.write(lambda a, b: a, rows.limit(0))
    assert table.versions() == [1, 2]


def test_days_are_dropped_whole_and_the_border_day_is_filtered(spark, tmp_path):
    now = datetime(2026, 3, 20, 15, 30)
    rows = spark.createDataFrame([(i, now - timedelta(hours=5 * i)) for i in range(40)], "i long, created_at timestamp_ntz")
    table = tables.Daily(spark, str(tmp_path / "t"), rows.schema)
    table.append(rows)
    cutoff = now - timedelta(hours=48)
    kept = table.since(now, 48)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "day#" in plan.split("PartitionFilters")[1][:60]
    want = sorted(r.i for r in rows.where(F.col("created_at") >= F.lit(cutoff).cast("timestamp_ntz")).collect())
    assert sorted(r.i for r in kept.collect()) == want
    days = len(table.days())
    assert table.purge(now, 48) == days - 3 and table.days() == [cutoff.date() + timedelta(days=k) for k in range(3)]
    assert sorted(r.i for r in table.since(now, 48).collect()) == want


def test_snapshots_stay_for_those_who_read_them(spark, tmp_path):
    s = tables.Snapshots(spark, str(tmp_path))
    assert [s.publish(spark.range(k), keep=2) for k in (1, 2, 3)] == [1, 2, 3]
    assert s.versions() == [2, 3] and s.read(2).count() == 2 and s.read().count() == 3


def test_trailing_sums_equal_profiles_at_any_time(spark):
    f = Feed(spark, SF)
    posts = f.posts.persist()
    partials = trailing.hourly(posts.where("event_id % 2 = 0")).unionByName(trailing.hourly(posts.where("event_id % 2 = 1"))).persist()
    rounded = lambda df: Counter(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    for now in (f.now, f.now - timedelta(hours=30, minutes=17), (f.now - timedelta(days=9)).replace(minute=0, second=0, microsecond=0)):
        past = posts.where(F.col("created_at") <= F.lit(now).cast("timestamp_ntz"))
        assert rounded(trailing.profiles(partials, posts, now)) == rounded(rank.profiles(past, now)) != Counter()
        assert rounded(trailing.post_counts(partials, posts, now)) == rounded(rank.post_counts(past, now))


def test_running_counts_at_the_borders_of_their_spans(spark):
    t = datetime(2026, 3, 20, 10)
    at = [t, t, t + timedelta(hours=24), t + timedelta(hours=24, microseconds=1), t + timedelta(minutes=59), t + timedelta(days=3)]
    posts = spark.createDataFrame([(f"p{i}", "a", x) for i, x in enumerate(at)] + [("q", "b", t)], "uri string, author_did string, created_at timestamp_ntz")
    want = {f"p{i}": sum(x - timedelta(hours=24) <= y <= x for y in at) for i, x in enumerate(at)} | {"q": 1}
    assert {r.uri: r.n for r in trailing.running_counts(posts, {"n": 24}).collect()} == want


def test_lookups_ask_for_a_key_once_in_chunks(spark, tmp_path):
    log = str(tmp_path)

    def service(keys):
        import json
        import uuid

        with open(f"{log}/{uuid.uuid4().hex}", "w") as f:
            json.dump(keys, f)
        if "k13" in keys:
            raise OSError("down")
        return {k: {"n": int(k[1:]), "tags": [k, None]} for k in keys if int(k[1:]) % 2}

    keys = spark.createDataFrame([(f"k{i % 90}",) for i in range(400)] + [(None,)] * 5 + [("k1",)] * 300, "key string").repartition(5)
    got = lookup.looked_up(keys, "key", service, "key string, n long, tags array<string>", partitions=2).collect()
    import json

    calls = [json.loads(p.read_text()) for p in tmp_path.iterdir()]
    asked = Counter(k for c in calls for k in c)
    assert set(asked) == {f"k{i}" for i in range(90)} and set(asked.values()) == {1}
    assert all(len(c) <= 25 for c in calls) and len(calls) <= 90 // 25 + 2
    lost = next(set(c) for c in calls if "k13" in c)
    assert {(r.key, r.n, tuple(r.tags)) for r in got} == {(k, int(k[1:]), (k, None)) for k in asked if int(k[1:]) % 2 and k not in lost}
    assert lookup.looked_up(keys.limit(0), "key", service, "key string, n long").count() == 0


def test_a_simulated_clock_runs_jobs_in_order(spark, tmp_path):
    ran, start = [], datetime(2026, 3, 20)

    def job(name):
        def run(now):
            ran.append((int((now - start).total_seconds()), name))
            if name == "messages" and len(ran) < 9:
                raise OSError("down")

        return run

    clock = lambda: cadence.Clock(spark, str(tmp_path), {j: job(j) for j in ("rank", "edition", "messages", "graph")})
    c = clock()
    for s in range(0, 1000, 10):
        if s == 500:
            c = clock()  # a clock that is started again goes on from the stored runs
        c.tick(start + timedelta(seconds=s))
    want = sorted([(s, "rank") for s in range(0, 1000, 120)] + [(30, "edition"), (930, "edition")] + [(s, "messages") for s in (60, 360, 660, 960)] + [(300, "graph")])
    assert sorted(ran) == want and [s for s, _ in ran] == sorted(s for s, _ in ran)
    failed = c.runs().where("failed is not null").collect()
    assert failed and {r.job for r in failed} == {"messages"} and dims.CADENCE["rank"] == 120


def test_the_engine_serves_what_its_passes_stored(spark, tmp_path):
    f = Feed(spark, SF)
    e = Engine(spark, f.now, f.posts, f.known, f.commands, f.views, per_author=8, store=str(tmp_path))
    fresh = e.feed_page("ranked", 5).collect()
    assert e.rank_pass() == 1
    first = e.feed_page("ranked", 5)
    assert "documents.parquet" not in first._jdf.queryExecution().optimizedPlan().toString() and len(first.inputFiles()) == 1
    first = first.collect()
    assert [(r.uri, r.score) for r in first] == [(r.uri, r.score) for r in fresh] and first[0].next_cursor.startswith("1:")
    e.per_author = 1
    assert e.rank_pass() == 2
    second = e.feed_page("ranked", 5, first[0].next_cursor).collect()  # of the first pass still
    assert max(r.score for r in second) < min(r.score for r in first)
    with pytest.raises(ValueError, match="BadCursor"):
        e.feed_page("ranked", 5, "x:1.0")
    assert e.edition_pass("one", "view") == 1 and e.edition_pass("two", "view") == 2
    held = {r.edition_id: r.stats.edition_num for r in e.frozen_editions().collect()}
    assert held == {"one": 1, "two": 2}
    assert e.feed_page("edition", 5).count() == 5
    assert {r.editions_present for r in e.stories().read().collect()} == {2}
    assert fixtures.as_of(spark, SF) == f.now
