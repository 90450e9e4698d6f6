"""Dedup, runs and rendering."""

import datetime as dt
import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadline.operators import harvest as H
from threadline.operators import render as R
from threadline.operators import runs as S
from threadline.sources import snapshots as SRC

DDL = "run_id string, snapshot_seq long, thread_ord long, text string, likes long, replyCount long, _key string"


def comments(spark, rows):
    return H.with_arrival(spark.createDataFrame(rows, DDL))


def keys(frame):
    return [r._key for r in frame.orderBy("arrival_seq").collect()]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=st.lists(st.tuples(st.integers(0, 4), st.integers(0, 3), st.sampled_from("abcd")), max_size=20))
def test_first_wins_for_any_partitioning(spark, data):
    rows = [("r", s, i, f"{k}{s}", 1, 0, k) for i, (s, _, k) in enumerate(data)]
    want = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        want.setdefault(r[6], r[3])
    base = comments(spark, rows)
    for n in (1, 3):
        once = H.dedup_first_wins(base.repartition(n))
        assert {r._key: r.text for r in once.collect()} == want
        assert H.dedup_first_wins(once).count() == len(want)
    assert H.limit_n(H.dedup_first_wins(base), 2).count() == min(2, len(want))


def test_prefer_complete(spark):
    base = comments(spark, [("r", 0, 0, "", 0, 0, "a"), ("r", 1, 0, "late", 0, 0, "a")])
    assert H.dedup_first_wins(base).first().text == ""
    assert H.dedup_first_wins(base, prefer="complete").first().text == "late"


def test_reconcile_puts_old_threads_last(spark):
    full = comments(spark, [("r", 9, i, k, 0, 0, k) for i, k in enumerate("abcda")])
    live = H.dedup_first_wins(comments(spark, [("r", 0, 0, "c", 0, 0, "c"), ("r", 1, 0, "b", 0, 0, "b")]))
    out = H.reconcile(live, full)
    assert keys(out) == ["c", "b", "a", "d"]
    assert keys(H.limit_n(out, 3)) == ["c", "b", "a"]
    assert [r._key for r in H.limit_n(out, 2, order="document").collect()] == ["c", "b"]


def test_counts(spark):
    base = comments(spark, [("r", 0, 0, "a", 0, 0, "a"), ("r", 1, 0, "a", 0, 0, "a"), ("r", 1, 1, "b", 0, 0, "b")])
    assert {(r.snapshot_seq, r.added) for r in H.harvest_added(base).collect()} == {(0, 1), (1, 1)}
    assert [r.collected for r in H.running_distinct(base).orderBy("arrival_seq").collect()] == [1, 1, 2]
    assert H.distinct_count(base).first().n == H.distinct_count(base, approximate=True).first().n == 2
    runs = spark.createDataFrame([("r",), ("empty",)], "run_id string")
    assert {(r.run_id, r.n) for r in H.export_count(runs, base).collect()} == {("r", 3), ("empty", 0)}
    assert [r.run_id for r in SRC.empty_exports(runs, base).collect()] == ["empty"]
    assert "_key" not in H.strip_key(base).columns


def test_valid_request():
    assert SRC.valid_request() == (500, "txt")
    for bad in ((0, "txt"), (5, "xml")):
        with pytest.raises(ValueError, match="limit"):
            SRC.valid_request(*bad)


T0 = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize(
    ("samples", "want"),
    [([(0, 0)], None), ([(0, 0), (10, 100)], 40.0), ([(0, 0), (10, 0)], None), ([(0, 0), (10, 500)], 0.0), ([(i, 10 * i) for i in range(11)], 40.0), ([(0, 0), (0, 5)], None)],
)
def test_eta(spark, samples, want):
    rows = spark.createDataFrame([("r", i, T0 + dt.timedelta(seconds=s), n, 500) for i, (s, n) in enumerate(samples)], "run_id string, seq long, ts timestamp, n long, total long")
    assert S.eta_ring(rows).orderBy(F.col("seq").desc()).first().eta == want


@pytest.mark.parametrize(
    ("rendered", "flags", "want"),
    [([20] * 6, {}, "stalled"), ([20, 20, 20, 20, 20, 30], {}, None), ([20, 60, 100], {}, "done"), ([20] * 6, {5: "aborted"}, "aborted"), ([20, 21], {1: "ended"}, "done")],
)
def test_stop_reason(spark, rendered, flags, want):
    rows = [("r", i, n, 0, 100, flags.get(i) == "aborted", flags.get(i) == "ended") for i, n in enumerate(rendered)]
    polls = spark.createDataFrame(rows, "run_id string, poll_seq long, rendered long, distinct_keys long, limit long, aborted boolean, ended boolean")
    assert S.stop_reason(polls).first().stop == want


@pytest.mark.parametrize(
    ("box", "marker", "stop", "n", "cancelled", "want"),
    [(True, True, "done", 100, False, "complete"), (True, False, "stalled", 40, False, "complete"), (True, False, "stalled", 0, False, S.NO_COMMENTS), (False, True, None, 0, False, S.DISABLED), (False, False, None, 0, False, S.NOT_FOUND), (True, False, "done", 5, True, S.CANCELLED)],
)
def test_outcome(spark, box, marker, stop, n, cancelled, want):
    row = spark.createDataFrame([(box, marker, stop, n, cancelled)], "a boolean, b boolean, c string, d long, e boolean")
    assert row.select(S.run_outcome(F.col("a"), F.col("b"), F.col("c"), F.col("d"), F.col("e")).alias("o")).first().o == want


def test_state_and_endings(spark):
    events = spark.createDataFrame([("a", 0, "reset", 0, 9, "go"), ("a", 1, "complete", 1234, 9, None), ("b", 0, "fail", 0, 9, "why"), ("c", 0, "cancel", 3, 9, None)], "run_id string, seq long, kind string, n long, total long, message string")
    got = {r.run_id: (r.running, r.done, r.collected, r.status, r.error) for r in S.run_state(events).collect()}
    assert got == {"a": (False, True, 1234, "Export complete — 1,234 comments", None), "b": (False, False, 0, "Error", "why"), "c": (False, False, 3, "Cancelled.", None)}
    actions = spark.createDataFrame([("a", 0, "cancelExport"), ("a", 1, "finishExport"), ("b", 0, "cancelExport")], "run_id string, seq long, action string")
    rows = spark.createDataFrame([("a",), ("b",), ("c",)], "run_id string")
    assert sorted(r.run_id for r in S.cancel_vs_finish(rows, actions).collect()) == ["a", "c"]


def test_documents(spark):
    base = comments(spark, [("r", 0, 0, "hi", 1200, 3, "a"), ("r", 0, 1, "x", 1, 0, "b"), ("r", 0, 2, "y", 0, 3, "c"), ("r", 0, 3, "", 0, 0, "d"), ("s", 0, 0, 'q"\\\n\té', None, 0, "e")])
    d = "-" * 40
    text = {r.run_id: r.body for r in R.fmt_txt(base).collect()}
    assert text["r"] == f"1200 likes (+ 3 replies)\nhi\n{d}\n1 likes\nx\n{d}\n+ 3 replies\ny\n{d}\n{d}"
    body = {r.run_id: r.body for r in R.fmt_json(base).collect()}
    for run in "rs":
        rows = [{"text": r.text, "likes": r.likes, "replyCount": r.replyCount} for r in base.filter(F.col("run_id") == run).orderBy("arrival_seq").collect()]
        assert body[run] == json.dumps(rows, indent=2, ensure_ascii=False)


def test_written_exports(spark, tmp_path):
    base = comments(spark, [("r", 0, 0, "hi", 1, 0, "a"), ("r", 0, 1, "ho", 0, 0, "b")])
    titles = spark.createDataFrame([("r", "A b")], "run_id string, title string")
    SRC.write_exports(R.exports(base, titles, "json"), str(tmp_path / "out"))
    assert json.loads("\n".join(r.value for r in spark.read.option("wholetext", "true").text(str(tmp_path / "out")).collect()))[1]["text"] == "ho"
    SRC.write_comments(base.select("run_id", *H.EXPORTED), str(tmp_path / "bulk"))
    assert spark.read.json(str(tmp_path / "bulk")).count() == 2


def test_run_outcome_deals_events_once(spark, sf_dir):
    """One shuffle, and no windows of other keys; nothing is written and joined again."""
    from threadline.plans.queries import QUERIES

    plan = QUERIES["run_outcome"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert "island" not in plan
