"""The keys of a run, and whether it goes on, as keyed state: work is in proportion to a batch.

Without control events the first comment of each key in a batch goes to Spark's own deduplication, whose
state is a key each; a batch then holds a key once, so that no choice is left to it. With them a run's keys are
dealt out over buckets, so that a run with very many comments is kept by many tasks; each bucket has a map of
the keys it has seen, and control events are told to every bucket of their run.
State lies in RocksDB, and its changes in the checkpoint."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

BUCKETS = 8
#: What starts a run, and what ends it.
START, ENDS = "startExport", ("cancelExport", "finishExport")
COMMENTS = "run_id string, snapshot_seq long, page_id long, thread_ord long, layout string, text string, likes long, replyCount long, _key string"
_NAMES = [c.split()[0] for c in COMMENTS.split(", ")]
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocks_db(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state in RocksDB."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


class GatedFirstWins(StatefulProcessor):
    """Lets the first comment of each key through while the run goes on."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "_key string", "snapshot_seq long")
        self.going = handle.getValueState("going", "going boolean")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        before = going = self.going.exists() and self.going.get()[0]
        met = set()
        for row in sorted(rows, key=lambda r: (r.snapshot_seq or 0, r.action is None, r.thread_ord or 0)):
            if row.action == START or row.action in ENDS:
                going = row.action == START
            elif row.action is None and going and row["_key"] not in met:
                met.add(row["_key"])
                known = (row["_key"] or "",)
                if not self.seen.containsKey(known):
                    self.seen.updateValue(known, (row.snapshot_seq or 0,))
                    yield Row(**{c: row[c] for c in _NAMES})
        if going != before:
            self.going.update((going,))

    def close(self) -> None:
        pass


def _first_of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a task that are the first of their run_id and known; holds those of one task of a batch."""
    held: list[pa.RecordBatch] = []
    first: dict[tuple, tuple] = {}
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("run_id", "known", "snapshot_seq", "thread_ord"))
        for i, (run, known, seq, place) in enumerate(zip(*columns, strict=True)):
            at = (seq or 0, place or 0, len(held), i)
            if at < first.get((run, known), (at[0], at[1] + 1)):
                first[run, known] = at
        held.append(batch)
    kept: list[list[int]] = [[] for _ in held]
    for *_, k, i in first.values():
        kept[k].append(i)
    for batch, rows in zip(held, kept, strict=True):
        if rows:
            yield batch.take(pa.array(sorted(rows)))


def first_wins(comments: DataFrame, control: DataFrame | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The first comment of each (run_id, _key) of a stream, for good.

    control: a stream of RUN_EVENTS; then only comments that arrive between a start and the next cancel or finish of
    their run get through. Events and comments meet on the run's own count: an event of seq s acts
    before comments of snapshot_seq s. What arrives after a run has ended is refused, also if its number is
    smaller; a run may start again, and keeps its keys. Other actions change nothing."""
    rows = comments.select(*_NAMES, F.coalesce("_key", F.lit("")).alias("known"))
    if control is None:
        firsts = rows.repartition("run_id", "known").mapInArrow(_first_of_batch, rows.schema)
        return firsts.dropDuplicates(["run_id", "known"]).select(*_NAMES)
    columns = {"run_id": F.col("run_id"), "snapshot_seq": F.col("seq")}
    told = control.filter(F.col("action").isin(START, *ENDS)).select(
        *[columns.get(c, F.lit(None).cast(kind)).alias(c) for c, kind in (x.split() for x in COMMENTS.split(", "))], "action", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket")
    )
    rows = comments.select(*_NAMES, F.lit(None).cast("string").alias("action"), F.pmod(F.xxhash64("_key"), F.lit(buckets)).cast("int").alias("bucket")).unionByName(told)
    return rows.groupBy("run_id", "bucket").transformWithState(GatedFirstWins(), COMMENTS, "Append", "None")
