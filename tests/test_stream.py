import json
import random
import time

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from emberdesk.plans import queries as Q
from emberdesk.sources import landed
from emberdesk.sources.commits import parsed
from emberdesk.streaming import ingest

NOW = {"availableNow": True}


def frame(key, op="create", who="d", at="2026-03-20T00:00:00Z", text="c"):
    record = {} if op == "delete" else {"record": {"text": text, "createdAt": at}}
    return json.dumps({"kind": "commit", "did": who, "time_us": 1774000000000000, "commit": {"operation": op, "collection": "app.bsky.feed.post", "rkey": str(key), **record}}, separators=(",", ":"))


def land(path, *files, first=0):
    path.mkdir(exist_ok=True)
    for k, lines in enumerate(files):
        (path / f"f{first + k:03}.txt").write_text("".join(x + "\n" for x in lines))
        time.sleep(0.01)  # files are taken in the order of their times


def run(spark, tmp_path, graph=None, files=1, **how):
    graph = spark.createDataFrame([("d",)], "author_did string") if graph is None else graph
    ingest.start(ingest.read_frames(spark, str(tmp_path / "in"), files), graph, str(tmp_path / "posts"), str(tmp_path / "c"), NOW, **how).awaitTermination()


def held(spark, tmp_path):
    return sorted((r.uri.rsplit("/", 1)[1], r.text) for r in ingest.current(spark, str(tmp_path / "posts")).collect())


def test_first_write_wins_and_deletes_stand_in_either_order(spark, tmp_path):
    days = ["2026-03-20", "2031-01-01", "2020-05-05"]  # clients' dates decide nothing
    land(tmp_path / "in", [frame(k, at=f"{d}T00:00:00Z") for k, d in enumerate(days)] + [frame(0, text="later"), "junk"], [frame(7, "delete"), frame(1, text="again"), frame(2, "delete")], [frame(7), frame(2), frame(8), frame(8, "delete")])
    run(spark, tmp_path)
    assert held(spark, tmp_path) == [("0", "c"), ("1", "c")]
    counts = [(r.kept, r.inserted, r.deleted) for r in ingest.counters(spark, str(tmp_path / "posts")).orderBy("batch_id").collect()]
    assert counts == [(3, 3, 0), (2, 0, 2), (2, 1, 1)]
    # A restart from the checkpoint reads only what is new.
    land(tmp_path / "in", [frame(9), frame(0), frame(7)], first=3)
    run(spark, tmp_path)
    assert held(spark, tmp_path) == [("0", "c"), ("1", "c"), ("9", "c")]
    folded = ingest.compact(spark, str(tmp_path / "posts"), 3)
    assert folded == 4 and held(spark, tmp_path) == [("0", "c"), ("1", "c"), ("9", "c")]
    assert ingest.changes(spark, str(tmp_path / "posts")).select("batch").distinct().count() == 1


def test_a_loss_between_the_write_and_the_commit_of_offsets_doubles_nothing(spark, tmp_path, monkeypatch):
    land(tmp_path / "in", [frame(0), frame(1)], [frame(2), frame(0)], [frame(3), frame(1, "delete")])
    graph, calls, table = spark.createDataFrame([("d",)], "author_did string"), [], str(tmp_path / "posts")
    # The second batch's folder is written, then the query dies before its offsets are committed.
    from pyspark.sql import SparkSession

    real = SparkSession.createDataFrame

    def failing(self, data, schema=None, *a, **k):
        if schema == ingest.COUNTERS and data[0][0] == 1 and not calls.count("lost"):
            calls.append("lost")
            raise RuntimeError("lost after writing")
        return real(self, data, schema, *a, **k)

    monkeypatch.setattr(SparkSession, "createDataFrame", failing)
    with pytest.raises(Exception, match="lost after writing"):
        run(spark, tmp_path, graph=graph)
    assert (tmp_path / "posts" / "batch=1").exists() and ingest.counters(spark, table).count() == 1
    run(spark, tmp_path, graph=graph)
    assert held(spark, tmp_path) == [("0", "c"), ("2", "c"), ("3", "c")]
    assert [(r.batch_id, r.inserted, r.deleted) for r in ingest.counters(spark, table).orderBy("batch_id").collect()] == [(0, 2, 0), (1, 1, 0), (2, 1, 1)]


def test_a_uri_is_forgotten_after_its_time(spark, tmp_path):
    land(tmp_path / "in", [frame(0)])
    run(spark, tmp_path, forget_ms=1)
    time.sleep(0.1)
    land(tmp_path / "in", [frame(1)], first=1)
    run(spark, tmp_path, forget_ms=1)  # its timer has passed: the state goes
    land(tmp_path / "in", [frame(0, text="new")], first=2)
    run(spark, tmp_path, forget_ms=1)
    assert held(spark, tmp_path) == [("0", "c"), ("0", "new"), ("1", "c")]


def test_a_graph_that_changes_counts_from_the_next_batch_on(spark, tmp_path):
    land(tmp_path / "in", *[[frame(n), frame(n, who="b"), frame(0)] for n in range(3)])
    calls = []

    def graph():
        calls.append(1)
        return spark.createDataFrame([("d",)] if len(calls) == 1 else [("d",), ("b",)], "author_did string")

    run(spark, tmp_path, graph=graph)
    counts = ingest.counters(spark, str(tmp_path / "posts")).orderBy("batch_id").collect()
    assert [(r.read, r.kept, r.inserted) for r in counts] == [(2, 1, 1), (2, 2, 2), (2, 2, 2)]
    assert len(held(spark, tmp_path)) == 5


def test_no_batch_reads_the_table_it_writes(spark, tmp_path):
    land(tmp_path / "in", [frame(0), frame(1)], [frame(2)])
    run(spark, tmp_path)
    for f in (tmp_path / "posts" / "batch=0").glob("*.parquet"):
        f.write_bytes(b"broken")
    land(tmp_path / "in", [frame(0), frame(3)], first=2)
    run(spark, tmp_path)  # would fail if it looked
    assert (tmp_path / "posts" / "batch=2").exists()


def test_own_source_equals_the_text_source_from_any_offset(spark, tmp_path):
    landed.register(spark)
    files = [[frame(0), "junk", '{"kind":"identity"}', "[1]", "\udcff".encode("utf-8", "surrogateescape").decode("latin-1")], [frame(1), frame(2, who="é")], [], ["", frame(3, "delete"), frame(4)]]
    land(tmp_path / "in", *files)
    (tmp_path / "in" / "_hidden").write_text(frame(99))
    text = spark.read.text(str(tmp_path / "in")).where("value like '%feed.post%'")
    rows = spark.read.format("frames").load(str(tmp_path / "in"))
    assert sorted(r.value for r in rows.collect()) == sorted(r.value for r in text.collect())
    assert sorted((r.file, r.line) for r in rows.collect()) == [("f000.txt", 0), ("f001.txt", 0), ("f001.txt", 1), ("f003.txt", 1), ("f003.txt", 2)]
    assert rows.where("did = 'é'").count() == 1
    for k in range(4):
        behind = spark.read.format("frames").option("after", f"f{k:03}.txt").load(str(tmp_path / "in"))
        assert behind.count() == sum("feed.post" in x for f in files[k + 1 :] for x in f)
    assert spark.read.format("frames").option("collections", "app.bsky.feed.like").load(str(tmp_path / "in")).count() == 0

    def stream(table):
        frames = spark.readStream.format("frames").load(str(tmp_path / "in")).select("value")
        graph = spark.createDataFrame([("d",), ("é",)], "author_did string")
        ingest.start(frames, graph, str(tmp_path / table), str(tmp_path / f"{table}-c"), NOW).awaitTermination()
        return sorted(r.uri.rsplit("/", 1)[1] for r in ingest.current(spark, str(tmp_path / table)).collect())

    listener = ingest.Progress(spark, str(tmp_path / "progress"), lambda: len(landed.landed_files(str(tmp_path / "in"))))
    spark.streams.addListener(listener)
    try:
        assert stream("own") == ["0", "1", "2", "4"]
        land(tmp_path / "in", [frame(5), frame(0)], first=4)
        assert stream("own") == ["0", "1", "2", "4", "5"]
        for _ in range(100):
            if (tmp_path / "progress").exists() and ingest.progress(spark, str(tmp_path / "progress")).count() == 2:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    seen = ingest.progress(spark, str(tmp_path / "progress")).orderBy("batch_id").collect()
    assert [(r.batch_id, r.rows_in, r.backlog) for r in seen] == [(0, 5, 0), (1, 2, 0)] and all(r.batch_ms > 0 for r in seen)


def test_backlog_counts_files_that_no_batch_has_taken(spark):
    class P:
        sources = [type("S", (), {"endOffset": '{"last": "f1", "files": 3}'})()]

    assert ingest.Progress(spark, "x", lambda: 10).backlog(P) == 7 and ingest.Progress(spark, "x").backlog(P) is None


def test_edge_pages_are_followed_by_cursor(spark, tmp_path):
    landed.register(spark)
    pages = {"follows": [["a", "b"], ["c"], []], "followers": [["b"], ["d", "e"]]}
    for edge, lists in pages.items():
        (tmp_path / edge).mkdir()
        for k, who in enumerate(lists):
            name = "start" if not k else f"c{k}"
            (tmp_path / edge / f"{name}.json").write_text(json.dumps({edge: [{"did": f"did:{w}", "handle": w} for w in who], "cursor": f"c{k + 1}" if k + 1 < len(lists) else None}))
    rows = spark.read.format("edge_pages").load(str(tmp_path))
    assert {(r.edge, r.did, r.handle) for r in rows.collect()} == {(e, f"did:{w}", w) for e, lists in pages.items() for who in lists for w in who}
    (tmp_path / "followers" / "c1.json").write_text(json.dumps({"followers": [{"did": "did:z"}], "cursor": "start"}))  # cursors that go round end
    assert rows.where("edge = 'followers'").agg(F.count(F.lit(1))).first()[0] == 2


def test_a_table_keeps_the_columns_that_are_asked_for(spark, tmp_path):
    files = [[frame(0), frame(1), frame(2, who="x")], [frame(0, text="again"), frame(1, "delete"), frame(3)]]
    land(tmp_path / "in", *files)
    run(spark, tmp_path, keep=("uri",))
    assert [(k, t) for k, t in held(spark, tmp_path)] == [("0", None), ("3", None)]
    stored = spark.read.parquet(str(tmp_path / "posts"))
    assert "text" not in stored.columns and {"uri", "op", "author_did", "external_domain"} < set(stored.columns)


def test_state_equals_a_plain_loop_and_is_kept_without_python(spark, tmp_path):
    rng, what, batches, want = random.Random(3), {}, [], []
    for _ in range(5):
        batches.append([(rng.randrange(14), rng.choice(["create", "create", "delete"])) for _ in range(rng.randrange(1, 25))])
        done = [0, 0]
        for key, op in batches[-1]:
            if op == "delete" and what.get(key) != "gone":
                what[key] = "gone"
                done[1] += 1
            elif op == "create" and key not in what:
                what[key] = "held"
                done[0] += 1
        want.append(tuple(done))
    land(tmp_path / "in", *[[frame(key, op) for key, op in b] for b in batches])
    graph = spark.createDataFrame([("d",)], "author_did string")
    q = ingest.start(ingest.read_frames(spark, str(tmp_path / "in"), 1), graph, str(tmp_path / "posts"), str(tmp_path / "c"), NOW)
    q.awaitTermination()
    assert [s.operatorName for s in q.lastProgress.stateOperators] == ["dedupe"]
    assert [(r.inserted, r.deleted) for r in ingest.counters(spark, str(tmp_path / "posts")).orderBy("batch_id").collect()] == want
    assert [k for k, _ in held(spark, tmp_path)] == sorted(str(k) for k, w in what.items() if w == "held")


def test_a_line_is_parsed_once(spark):
    plan = parsed(spark.read.text(__file__)).select("uri", "op")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_folders_land_one_after_the_other(spark, tmp_path):
    for n in (2, 0, 1):
        folder = tmp_path / "spans" / f"span={n}"
        folder.mkdir(parents=True)
        (folder / "part-0.txt").write_text(f"{n}\n")
        (folder / ".part-0.txt.crc").write_bytes(b"")
    landed.land(spark, [f"file://{tmp_path}/spans/span={n}" for n in (1, 3, 2, 0)], f"file://{tmp_path}/in")
    found = sorted((tmp_path / "in").glob("*part-*.txt"), key=lambda p: p.stat().st_mtime)
    assert [p.read_text() for p in found] == ["1\n", "2\n", "0\n"] and [p.name for p in found] == landed.landed_files(f"{tmp_path}/in")


def test_frames_of_all_spans_are_written_once_without_a_sort(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Q, "new_path", lambda s, name: f"file://{tmp_path}/{name}")
    written = []
    real = DataFrameWriter.text
    monkeypatch.setattr(DataFrameWriter, "text", lambda self, path, *a, **k: written.append(path) or real(self, path, *a, **k))
    rows = Q.REGISTRY["stream_equals_batch"][0](spark, "/root/testdata/sf0.001")
    assert len(written) == 1 and rows.count() > 500
    spans = {n[:3] for n in landed.landed_files(f"{tmp_path}/stream/in")}
    assert len(spans) == 9 and ingest.counters(spark, f"file://{tmp_path}/stream/posts").count() > 1
