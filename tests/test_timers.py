"""Streams with timers, over files that arrive one after the other."""

import datetime as dt

from threadline.streaming import timers as TM

T0 = dt.datetime(2024, 1, 1)
MS = int(T0.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)


def arriving(spark, path, batches, ddl):
    for rows in batches:
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(path))


def gathered(result, tmp_path, name):
    q = result.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return result.sparkSession.table(name).collect()


def test_throttle(spark, tmp_path):
    at = lambda ms, n, run="r": (run, T0 + dt.timedelta(milliseconds=ms), n, n)
    late = [at(10_000_000, 99, "other")]  # moves the watermark on
    batches = [[at(0, 1), at(100, 2)], [at(400, 3), at(600, 4), at(1050, 5)], [at(1200, 6)], late, [at(10_000_001, 99, "third")]]
    stream = arriving(spark, tmp_path / "in", batches, "run_id string, ts timestamp, seq long, n long")
    rows = [(r.at_ms - MS, r.n) for r in gathered(TM.throttle_exact(stream), tmp_path, "throttled") if r.run_id == "r"]
    assert sorted(rows) == [(500, 3), (1100, 5), (1700, 6)]


def test_stall(spark, tmp_path):
    at = lambda s, run="r": (run, T0 + dt.timedelta(seconds=s))
    batches = [[at(0), at(10)], [at(70), at(80)], [at(10_000, "x")], [at(20_000, "x")], [at(20_001, "y")], [at(20_002, "y")], [at(20_003, "y")], [at(20_004, "y")], [at(20_005, "y")], [at(20_006, "y")]]
    stream = arriving(spark, tmp_path / "in", batches, "run_id string, ts timestamp")
    rows = gathered(TM.stall_exact(stream), tmp_path, "stalled")
    assert [(r.stalled_at_ms - MS) // 1000 for r in rows if r.run_id == "r"] == [80 + 75]


def test_entry_without_llm(monkeypatch):
    import importlib
    import sys

    import __spark_entry__ as entry

    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("threadline.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    alone = importlib.reload(entry)
    assert len(alone.queries()) > 60 and not any(n.startswith("op") and n[2].isdigit() for n in alone.queries())
    monkeypatch.undo()
    importlib.reload(entry)


def test_calls_serve_many_runs(spark, tmp_path):
    """Runs that share a bucket keep their own timers, and the number of states doesn't grow with the runs."""
    at = lambda ms, run: (run, T0 + dt.timedelta(milliseconds=ms), ms, ms)
    runs = [None, *(f"r{i}" for i in range(40))]
    batches = [[at(i, r) for i, r in enumerate(runs)], [at(700 + i, r) for i, r in enumerate(runs[::2])], [at(10_000_000, "x")], [at(20_000_000, "x")]]
    result = TM.throttle_exact(arriving(spark, tmp_path / "in", batches, "run_id string, ts timestamp, seq long, n long"), buckets=3)
    rows = [(r.run_id, r.at_ms - MS, r.n) for r in gathered(result, tmp_path, "shared") if r.run_id != "x"]
    want = [(r, i + 500, i) for i, r in enumerate(runs)] + [(r, 1200 + i, 700 + i) for i, r in enumerate(runs[::2])]
    assert sorted(rows, key=repr) == sorted(want, key=repr)
    assert spark.read.format("statestore").load(str(tmp_path / "shared")).count() <= 3
