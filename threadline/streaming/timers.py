"""Stateful streams with timers of their own: the exact throttle and stall rules of a run.

State is a few numbers per run. Runs are dealt out over buckets, and a call serves all runs of a bucket: most of the
time goes into calls, whose number is so bounded for any number of runs. A batch writes the state of the buckets
that it meets anew; with very many runs take more of them. Timers run on event time, so they fire once the
watermark has passed them, in the same way for a replayed stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.runs import MAX_STALLS

THROTTLE_MS, STALL_MS, BUCKETS = 500, 15_000, 1024


def _changes(frames: Iterator[pd.DataFrame], *columns: str) -> Iterator[tuple]:
    """(run_id, milliseconds, the first of columns) of the rows of frames, in the order of time and then of columns."""
    rows = pd.concat(list(frames))
    rows = rows.sort_values(["ts", *columns]) if len(rows) > 1 else rows
    return zip(rows["run_id"].tolist(), rows["ts"].to_numpy().astype("datetime64[ms]").astype(np.int64).tolist(), rows[columns[-1] if columns else "run_id"].tolist(), strict=True)


def _kept(state: GroupState, runs: dict, due: int) -> None:
    """Writes runs(run_id: two numbers) as the state of a bucket, with a timer at the time ``due``."""
    if runs:
        first, second = zip(*runs.values(), strict=True)
        state.update((list(runs), list(first), list(second)))
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
    elif state.exists:
        state.remove()


def _runs(state: GroupState) -> dict:
    runs, first, second = state.get if state.exists else ((), (), ())
    return dict(zip(runs, zip(first, second, strict=True), strict=True))


def _by_bucket(rows: DataFrame, late: str, buckets: int):
    return rows.withWatermark("ts", late).withColumn("bucket", F.pmod(F.xxhash64("run_id"), F.lit(buckets)).cast("int")).groupBy("bucket")


def throttle_exact(samples: DataFrame, width_ms: int = THROTTLE_MS, late: str = "1 minute", buckets: int = BUCKETS) -> DataFrame:
    """(run_id, at_ms, n) of samples(run_id, ts, seq, n): the first change arms a timer, and when it
    fires the latest count is told; changes meanwhile only renew that count."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        runs, met, told = _runs(state), set(), []
        if not state.hasTimedOut:
            for run, at, n in _changes(frames, "seq", "n"):
                armed, last = runs.get(run, (at, n))
                if at >= armed + width_ms:
                    told.append((run, armed + width_ms, last))
                    armed = at
                runs[run] = armed, n
                met.add(run)
        now = state.getCurrentWatermarkMs()
        for run in [r for r, (armed, _) in runs.items() if armed + width_ms < now and r not in met]:
            armed, last = runs.pop(run)
            told.append((run, armed + width_ms, last))
        _kept(state, runs, min((armed for armed, _ in runs.values()), default=0) + width_ms)
        if told:
            yield pd.DataFrame(told, columns=["run_id", "at_ms", "n"])

    return _by_bucket(samples, late, buckets).applyInPandasWithState(step, "run_id string, at_ms long, n long", "runs array<string>, armed array<long>, last array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def stall_exact(growth: DataFrame, gap_ms: int = STALL_MS, most: int = MAX_STALLS, late: str = "1 minute", buckets: int = BUCKETS) -> DataFrame:
    """(run_id, stalled_at_ms) of growth(run_id, ts): a gap without growth counts one stall, growth
    sets the count back, and the run ends when it reaches ``most``."""
    width = most * gap_ms

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        runs, met, ended = _runs(state), set(), []
        if not state.hasTimedOut:
            for run, at, _ in _changes(frames):
                last, grown = runs.get(run, (at, 0))
                if at - last >= width:
                    ended.append((run, last + width))
                runs[run] = max(last, at), grown + 1
                met.add(run)
        now = state.getCurrentWatermarkMs()
        for run in [r for r, (last, _) in runs.items() if last + width < now and r not in met]:
            ended.append((run, runs.pop(run)[0] + width))
        _kept(state, runs, min((last for last, _ in runs.values()), default=0) + width)
        if ended:
            yield pd.DataFrame(ended, columns=["run_id", "stalled_at_ms"])

    return _by_bucket(growth, late, buckets).applyInPandasWithState(step, "run_id string, stalled_at_ms long", "runs array<string>, last array<long>, grown array<long>", "append", GroupStateTimeout.EventTimeTimeout)
