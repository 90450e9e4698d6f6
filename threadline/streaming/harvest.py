"""Structured Streaming jobs: the harvest of a run while its fragments arrive.

Two queries: one parses arriving fragments (windows are not allowed on streams, so inside foreachBatch, on
the batch alone), the other lets the first comment of each key through by keyed state. A batch writes its
own folder, so that a retried batch replaces itself, and no batch reads what earlier ones wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.extract import find_threads, parse_threads
from ..operators.harvest import dedup_first_wins, with_arrival
from ..operators.runs import latest_events, state_of
from .state import COMMENTS, first_wins, rocks_db

KEYS = ("run_id", "snapshot_seq", "page_id")
COMMENTS_DDL = f"{COMMENTS}, arrival_seq struct<pass:int,snapshot_seq:bigint,thread_ord:bigint>"


def parse_batch(snapshots: DataFrame, outermost: bool = False) -> DataFrame:
    """The comments of a batch of fragments or whole pages, with their arrival."""
    rows = with_arrival(parse_threads(find_threads(snapshots, KEYS, outermost=outermost), KEYS))
    return rows.select(*KEYS, "thread_ord", "layout", "text", "likes", "replyCount", "_key", "arrival_seq")


def committed(spark: SparkSession, out: str) -> DataFrame:
    """What earlier batches committed; empty before the first."""
    return spark.read.schema(f"{COMMENTS_DDL}, batch long").option("ignoreMissingFiles", "true").parquet(out)


def stream_parse(snapshots: DataFrame, parsed: str, checkpoint: str) -> StreamingQuery:
    """Parses fragments as they arrive into a table of comments, the first of each key in a batch. Takes what is
    there and stops (availableNow), as the queries below do."""

    def run(batch: DataFrame, batch_id: int) -> None:
        dedup_first_wins(parse_batch(batch, outermost=True)).drop("arrival_seq").write.mode("overwrite").parquet(f"{parsed}/batch={batch_id}")

    return snapshots.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_first_wins(comments: DataFrame, out: str, checkpoint: str, control: DataFrame | None = None) -> StreamingQuery:
    """Commits the comments whose keys no earlier batch had, while their run goes on (see first_wins())."""
    new = with_arrival(first_wins(comments, control))
    with rocks_db(comments.sparkSession):
        return collect_stream(new, out, checkpoint, "append")


def stream_harvest(snapshots: DataFrame, base: str, control: DataFrame | None = None) -> None:
    """Parses, gates and commits what has arrived, below the folder base; committed(spark, base + "/out") has the
    result. Called again it goes on where it stopped."""
    spark = snapshots.sparkSession
    stream_parse(snapshots, f"{base}/parsed", f"{base}/parsing").awaitTermination()
    comments = spark.readStream.schema(f"{COMMENTS}, batch long").parquet(f"{base}/parsed")
    stream_first_wins(comments, f"{base}/out", f"{base}/keeping", control).awaitTermination()


def bounded_dedup(comments: DataFrame, late: str = "10 minutes") -> DataFrame:
    """One row for each key as far as it comes again within the watermark; any of them, not the first."""
    return comments.withWatermark("captured_at", late).dropDuplicatesWithinWatermark(["run_id", "_key"])


def stream_throttle(samples: DataFrame, width: str = "500 milliseconds", late: str = "1 minute") -> DataFrame:
    """The last count of every window of a run, once the watermark has passed it."""
    return samples.withWatermark("ts", late).groupBy("run_id", F.window("ts", width).alias("w")).agg(F.max_by("n", "seq").alias("n")).select("run_id", F.col("w.start").alias("window_start"), "n")


def stream_stall(growth: DataFrame, gap: str = "15 seconds", late: str = "1 minute") -> DataFrame:
    """(run_id, began, last_until, grown): stretches of growth with no gap of that length; each
    end is a stall."""
    rows = growth.withWatermark("ts", late).groupBy("run_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("grown"))
    return rows.select("run_id", F.col("w.start").alias("began"), F.col("w.end").alias("last_until"), "grown")


def stream_run_state(events: DataFrame, checkpoint: str) -> StreamingQuery:
    """Keeps the latest event of each run as the state of a stream; view_run_state() reads it, at any time."""
    return latest_events(events).writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def view_run_state(spark: SparkSession, checkpoint: str, batch_id: int | None = None) -> DataFrame:
    """run_state() of what the stream has taken in by its last batch (or by batch_id), from its state store beside the
    running query."""
    reader = spark.read.format("statestore")
    reader = reader if batch_id is None else reader.option("batchId", batch_id)
    return state_of(reader.load(checkpoint).select("key.run_id", F.col("value.valueWithExtremumOrdering").alias("e")))


def collect_stream(result: DataFrame, out: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Runs an aggregating stream over what is there; in complete mode the last batch is the result."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return result.writeStream.outputMode(mode).foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
