"""The life of export runs as windows and folds over polls, progress samples and events."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Polls without growth that end a run, samples in the ring, and what runs report.
MAX_STALLS, RING, THROTTLE, THROTTLE_MS = 5, 10, "500 milliseconds", 500
DISABLED = "Comments are disabled for this video."
NOT_FOUND = "Could not find the comments section. The video may be age-restricted or unavailable."
NO_COMMENTS = "No comments found. The video may have comments disabled or restricted."
CANCELLED, FAILED = "Cancelled.", "Error"


def _run(order: str, *more: Column) -> object:
    return Window.partitionBy("run_id").orderBy(order, *more)


def eta_ring(samples: DataFrame) -> DataFrame:
    """samples(run_id, seq, ts, n, total) with eta: seconds left by the rate between the oldest and
    newest of the last ten samples; null without time or gain between them."""
    ring = _run("seq").rowsBetween(1 - RING, 0)
    seconds = F.unix_micros("ts") / 1e6
    rows = samples.withColumns({"elapsed": seconds - F.first(seconds).over(ring), "gained": F.col("n") - F.first("n").over(ring)})
    left = F.col("total") - F.col("n")
    eta = F.when((F.col("elapsed") > 0) & (F.col("gained") > 0), F.when(left > 0, left / (F.col("gained") / F.col("elapsed"))).otherwise(0.0))
    return rows.withColumn("eta", eta).drop("elapsed", "gained")


def growth_flag(polls: DataFrame) -> DataFrame:
    """polls(run_id, poll_seq, rendered, ...) with grew: more than at the poll before; the first
    poll is the baseline and doesn't count as growth."""
    return polls.withColumn("grew", F.coalesce(F.col("rendered") > F.lag("rendered").over(_run("poll_seq")), F.lit(False)))


def stall_streak(polls: DataFrame) -> DataFrame:
    """polls with streak: polls in a row without growth, 0 at growth and at the baseline. A poll's place less that of the
    latest growth, so that all windows share one sort."""
    rows = growth_flag(polls).withColumn("place", F.row_number().over(_run("poll_seq")).cast("long"))
    grown = F.max(F.when(F.col("grew") | (F.col("place") == 1), F.col("place"))).over(_run("poll_seq").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("streak", F.col("place") - grown).drop("place")


def poll_reasons(polls: DataFrame) -> DataFrame:
    """polls(..., distinct_keys, limit, aborted, ended) with reason, in order: aborted, done by
    predicate (ended by a message, or enough keys), stalled, done by count, else null."""
    reason = (
        F.when(F.col("aborted"), "aborted").when(F.col("ended") | (F.col("distinct_keys") >= F.col("limit")), "done")
        .when(F.col("streak") >= MAX_STALLS, "stalled").when(F.col("rendered") >= F.col("limit"), "done")
    )
    return stall_streak(polls).withColumn("reason", reason)


def stop_reason(polls: DataFrame, *shown: str) -> DataFrame:
    """(run_id, stop, stop_seq): the first reason of each run, null for one that goes on; and the columns ``shown``
    of that poll, without a join."""
    hit = F.when(F.col("reason").isNotNull(), F.col("poll_seq"))
    return poll_reasons(polls).groupBy("run_id").agg(F.min_by("reason", hit).alias("stop"), F.min(hit).alias("stop_seq"), *[F.min_by(c, hit).alias(c) for c in shown])


def run_outcome(has_container: Column, has_marker: Column, stop: Column, n_rows: Column, cancelled: Column) -> Column:
    """What a run reports: cancelled, an error, or complete. The marker counts only without container;
    stalled and finished runs with rows are complete."""
    missing = F.when(has_marker, DISABLED).otherwise(NOT_FOUND)
    return F.when(cancelled, CANCELLED).when(~has_container, missing).when((stop == "stalled") & (n_rows == 0), NO_COMMENTS).otherwise("complete")


def latest_events(events: DataFrame) -> DataFrame:
    """(run_id, e): the latest of each run's events(run_id, seq, kind, n, total, message)."""
    return events.groupBy("run_id").agg(F.max_by(F.struct("kind", "n", "total", "message", "seq"), "seq").alias("e"))


def state_of(last: DataFrame) -> DataFrame:
    """What each run shows after its latest event e; kind is reset, progress, complete, fail or cancel."""
    kind = F.col("e.kind")
    status = F.when(kind == "cancel", CANCELLED).when(kind == "fail", FAILED).when(kind == "complete", F.concat(F.lit("Export complete — "), F.format_number("e.n", 0), F.lit(" comments"))).otherwise(F.col("e.message"))
    return last.select(
        "run_id", kind.isin("reset", "progress").alias("running"), (kind == "complete").alias("done"), F.when(kind == "reset", 0).otherwise(F.col("e.n")).cast("long").alias("collected"),
        F.col("e.total").alias("total"), status.alias("status"), F.when(kind == "fail", F.col("e.message")).alias("error"), F.col("e.seq").alias("seq"),
    )


def run_state(events: DataFrame) -> DataFrame:
    """(run_id, running, done, collected, total, status, error, seq) by the latest of each run's events."""
    return state_of(latest_events(events))


def run_supersede(starts: DataFrame) -> DataFrame:
    """starts(run_id, page_id, start_ts) with is_current: the page's latest start (by time, then id)."""
    latest = Window.partitionBy("page_id").orderBy(F.col("start_ts").desc(), F.col("run_id").desc())
    return starts.withColumn("is_current", F.row_number().over(latest) == 1)


def kept_runs(events: DataFrame) -> DataFrame:
    """(run_id, ending): the last cancel or finish of each run, null without one."""
    ends = F.when(F.col("action").isin("cancelExport", "finishExport"), F.col("seq"))
    return events.groupBy("run_id").agg(F.max_by("action", ends).alias("ending"))


def cancel_vs_finish(comments: DataFrame, events: DataFrame) -> DataFrame:
    """The comments of runs that weren't cancelled; a finished run keeps its rows."""
    return comments.join(kept_runs(events).filter("ending = 'cancelExport'").select("run_id"), "run_id", "left_anti")


def snapshot_view(state: DataFrame, samples: DataFrame) -> DataFrame:
    """state with the eta of each run's latest sample."""
    last = eta_ring(samples).groupBy("run_id").agg(F.max_by("eta", "seq").alias("eta"))
    return state.join(last, "run_id", "left")


def throttle_grid(samples: DataFrame, width: str = THROTTLE) -> DataFrame:
    """(run_id, window_start, n): the last count of every window of the clock grid that has one."""
    return samples.groupBy("run_id", F.window("ts", width).alias("w")).agg(F.max_by("n", "seq").alias("n")).select("run_id", F.col("w.start").alias("window_start"), "n")


def throttle_progress(samples: DataFrame, width_ms: int = THROTTLE_MS) -> DataFrame:
    """(run_id, at_ms, n) of samples(run_id, ts, seq, n): the first change arms a timer; when it fires, after width_ms,
    the latest count is told, and the next change arms it again. A change at the very time comes too late.

    One ordered pass over each run, from one armed sample to the next; a task holds a batch and two numbers, so a
    run may be of any length. Samples without a time or count are left out; a null run_id is a run."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, armed, last = None, None, 0
        for batch in batches:
            told: list[tuple] = []
            runs, ms, n = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            ends = [i for i in range(1, len(runs)) if runs[i] != runs[i - 1]] + [len(runs)]
            at = 0
            for end in ends:
                if runs[at] != run:
                    if armed is not None:
                        told.append((run, armed + width_ms, last))
                    run, armed = runs[at], None
                while at < end:
                    if armed is None:
                        armed = int(ms[at])
                    following = at + int(np.searchsorted(ms[at:end], armed + width_ms))
                    if following > at:
                        last = n[following - 1]
                    if following < end:
                        told.append((run, armed + width_ms, last))
                        armed = None
                    at = following
            yield _told(told)
        if armed is not None:
            yield _told([(run, armed + width_ms, last)])

    rows = samples.filter("ts is not null and n is not null").select(F.col("run_id").cast("string"), F.unix_millis("ts").alias("ms"), F.col("n").cast("long"), "seq")
    rows = rows.repartition("run_id").sortWithinPartitions("run_id", "ms", "seq")
    return rows.select("run_id", "ms", "n").mapInArrow(fold, "run_id string, at_ms long, n long")


def _told(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["run_id", "at_ms", "n"])
