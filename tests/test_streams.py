"""A stream of fragments gives what a batch over them gives."""

from collections import Counter

from pyspark.sql import Observation

from threadline.operators import extract as E
from threadline.operators import harvest as H
from threadline.operators import runs as S
from threadline.plans import fixtures as fx
from threadline.sources import snapshots as SRC
from threadline.streaming import harvest as ST
from threadline.streaming.state import COMMENTS


def shown(df):
    return sorted(tuple(r) for r in df.select("run_id", "_key", "text", "likes").collect())


def test_batch_and_stream_agree_over_restarts(spark, sf_dir, tmp_path):
    rows = fx.live_snapshots(spark, sf_dir).cache()
    for seq in (1, 3, 5, 7):
        rows.filter(f"snapshot_seq = {seq}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if seq > 1:  # the queries stop after each, and go on from their checkpoints
            ST.stream_harvest(SRC.stream_snapshots(spark, str(tmp_path / "in"), files_per_trigger=1), str(tmp_path))
    rows.filter("snapshot_seq = 5").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))  # all of it was there before
    ST.stream_harvest(SRC.stream_snapshots(spark, str(tmp_path / "in")), str(tmp_path))
    got = ST.committed(spark, str(tmp_path / "out"))
    assert got.select("batch").distinct().count() > 1
    assert shown(got) == shown(H.dedup_first_wins(ST.parse_batch(rows.filter("snapshot_seq <= 7"))))
    rows.unpersist()


def comment(run, seq, key, text):
    return (run, seq, 1, 0, "classic", text, 0, 0, key)


def test_gate_by_arriving_events(spark, tmp_path):
    steps = [
        ([("a", 0, None, "startExport", 5)], [comment("a", 1, "k1", "first"), comment("a", 2, "k1", "again"), comment("b", 1, "k1", "never started")]),
        ([("a", 5, None, "cancelExport", None), ("b", 5, None, "startExport", None)], [comment("a", 4, "k2", "just before"), comment("a", 5, "k3", "with the cancel"), comment("b", 6, "k1", "started")]),
        ([("a", 9, None, "getProgress", None)], [comment("a", 3, "k4", "late, after the end"), comment("b", 7, "k1", "again"), comment("b", 8, None, "no key")]),
        ([("a", 20, None, "startExport", None), ("b", 30, None, "finishExport", None)], [comment("a", 21, "k2", "known"), comment("a", 22, "k5", "a new start"), comment("b", 29, "k9", "last"), comment("b", 31, "k8", "over")]),
    ]
    for k, (events, comments) in enumerate(steps):
        spark.createDataFrame(events, SRC.RUN_EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
        spark.createDataFrame(comments, COMMENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "parsed"))
        stream = spark.readStream.schema(COMMENTS).parquet(str(tmp_path / "parsed"))
        ST.stream_first_wins(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"), SRC.stream_run_events(spark, str(tmp_path / "events"))).awaitTermination()
        assert k or ST.committed(spark, str(tmp_path / "out")).count() == 1
    got = ST.committed(spark, str(tmp_path / "out"))
    assert sorted(r.text for r in got.collect()) == ["a new start", "first", "just before", "last", "no key", "started"]


def test_control_stream_and_bounded_dedup(spark, tmp_path):
    SRC_ROWS = [("r", 0, None, "startExport", 5), ("r", 1, None, "finishExport", None)]
    spark.createDataFrame(SRC_ROWS, SRC.RUN_EVENTS).write.parquet(str(tmp_path / "in"))
    q = SRC.stream_run_events(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("control").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert spark.table("control").count() == 2
    import datetime as dt

    spark.createDataFrame([("r", "a", dt.datetime(2024, 1, 1)), ("r", "a", dt.datetime(2024, 1, 1)), ("r", "b", dt.datetime(2024, 1, 1))], "run_id string, _key string, captured_at timestamp").write.parquet(str(tmp_path / "d"))
    stream = spark.readStream.schema("run_id string, _key string, captured_at timestamp").parquet(str(tmp_path / "d"))
    q = ST.bounded_dedup(stream).writeStream.format("memory").queryName("bounded").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "e")).start()
    q.awaitTermination()
    assert sorted(r._key for r in spark.table("bounded").collect()) == ["a", "b"]


def test_view_after_each_batch(spark, tmp_path):
    kind = "run_id string, seq long, kind string, n long, total long, message string"
    steps = [[("a", 1, "reset", 0, 9, None), ("b", 1, "progress", 4, 9, "Loading")], [("a", 2, "complete", 7, 9, None), ("b", 0, "reset", 0, 9, None)], [("c", 1, "fail", 1, 9, "gone")]]
    told = []
    for k, rows in enumerate(steps):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ST.stream_run_state(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), str(tmp_path / "checkpoint")).awaitTermination()
        told += rows
        want = sorted(map(str, S.run_state(spark.createDataFrame(told, kind)).collect()))
        assert sorted(map(str, ST.view_run_state(spark, str(tmp_path / "checkpoint")).collect())) == want
    assert {r.run_id for r in ST.view_run_state(spark, str(tmp_path / "checkpoint"), 0).collect()} == {"a", "b"}


def test_sketches_stay_within_their_error(spark):
    rows = spark.range(60_000).selectExpr("'r' as run_id", "id % 7 as snapshot_seq", "concat('k', id % 40000) as _key")
    n = H.merged_count(H.key_sketches(rows)).first().n
    assert abs(n - 40_000) < 4 * 0.0163 * 40_000
    assert H.merged_count(H.key_sketches(rows.limit(0))).collect() == []


def test_issues_are_counted_in_the_same_pass(spark, sf_dir):
    seen = Observation("issues")
    rows = E.with_issue_counts(E.examine_threads(E.find_threads(fx.watch_snapshots(spark, sf_dir), ST.KEYS), ST.KEYS), seen)
    found = Counter(r.code for r in E.extraction_issues(rows, ST.KEYS).collect())
    assert {c: seen.get[c] for c in E.CODES} == {c: found.get(c, 0) for c in E.CODES} and seen.get["threads"] > sum(found.values()) > 0
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("posexplode") == 1


def test_ungated_keys_are_kept_by_sparks_own_state(spark, tmp_path):
    def keep(*files):
        for rows in files:
            spark.createDataFrame(rows, COMMENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "parsed"))
        q = ST.stream_first_wins(spark.readStream.schema(COMMENTS).parquet(str(tmp_path / "parsed")), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        q.awaitTermination()
        return q

    # one batch of several files: the first of a key is not the first that is read
    q = keep([comment("a", 9, "k1", "late"), comment("b", 5, None, "no key")], [comment("a", 3, "k1", "first"), comment("a", 4, "k2", "other")], [comment("a", 7, "k1", "again"), comment("b", 4, "", "empty key")])
    assert [o.operatorName for o in q.lastProgress.stateOperators] == ["dedupe"]
    keep([comment("a", 1, "k1", "known"), comment("b", 1, "k1", "another run"), comment("b", 2, None, "known")])
    got = ST.committed(spark, str(tmp_path / "out"))
    assert sorted((r.batch, r.run_id, r.text) for r in got.collect()) == [(0, "a", "first"), (0, "a", "other"), (0, "b", "empty key"), (1, "b", "another run")]
    assert {tuple(r.arrival_seq) for r in got.filter("text = 'first'").collect()} == {(0, 3, 0)}


def test_pages_are_dealt_once_and_tags_cut_once(spark):
    pages = spark.range(50).selectExpr("concat('r', id) run_id", "1000L snapshot_seq", "id page_id", "concat('<ytd-comment-thread-renderer><p id=a ID=b class>', id, '</p></ytd-comment-thread-renderer>') html")
    threads = E.find_threads(pages, ST.KEYS)
    plan = threads._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # also with a key that is the same for all pages
    assert plan.count("regexp_extract_all") == 2  # into tokens, and each tag into attributes
    rows = threads.collect()
    assert len(rows) == 50 and {(e.attrs.id, e.attrs["class"], e.attrs.href) for r in rows for e in r.els if e.tag == "p" and e.kind == "open"} == {("a", "", None)}
