"""From parsed threads to the comments of a run: first arrival wins, repair scan, limit.

Arrival is a struct (pass, snapshot_seq, thread_ord) that the source gives, never the clock, so
results are the same for any partitioning. Picking the first rows is a ranked window whose limit
Spark also applies before the shuffle, so a key with very many rows sends few.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXPORTED = ("text", "likes", "replyCount")


def with_arrival(comments: DataFrame, scan: int = 0) -> DataFrame:
    """scan: 0 for what arrives while a run goes on, 1 for its repair scan."""
    return comments.withColumn("arrival_seq", F.struct(F.lit(scan).alias("pass"), F.col("snapshot_seq"), F.col("thread_ord")))


def dedup_first_wins(comments: DataFrame, keys: Sequence[str] = ("run_id", "_key"), prefer: str = "first") -> DataFrame:
    """The first arrival of each key. prefer="complete" takes the first that has text, if any has."""
    order: list[Column] = [F.col("text") == ""] * (prefer == "complete") + [F.col("arrival_seq")]
    rows = comments.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return rows.filter("rn = 1").drop("rn")


def with_is_new(comments: DataFrame, keys: Sequence[str] = ("run_id", "_key")) -> DataFrame:
    """comments with is_new: whether each row is its key's first."""
    return comments.withColumn("is_new", F.row_number().over(Window.partitionBy(*keys).orderBy("arrival_seq")) == 1)


def reconcile(live: DataFrame, full: DataFrame) -> DataFrame:
    """The first rows of the live keys and, after them, the rows of a full scan whose keys are new: one
    ranking over both, as live rows arrive before those of the scan. live may hold repeats."""
    return dedup_first_wins(live.unionByName(with_arrival(full, 1).select(*live.columns)))


def limit_n(comments: DataFrame, limit: int, order: str = "arrival") -> DataFrame:
    """The first rows of each run, by arrival or by place in the page ("document")."""
    by = F.col("arrival_seq") if order == "arrival" else F.struct("snapshot_seq", "thread_ord")
    rows = comments.withColumn("rn", F.row_number().over(Window.partitionBy("run_id").orderBy(by)))
    return rows.filter(F.col("rn") <= limit).drop("rn")


def strip_key(comments: DataFrame) -> DataFrame:
    return comments.drop("_key")


def harvest_added(comments: DataFrame) -> DataFrame:
    """(run_id, snapshot_seq, added): new keys of each batch."""
    return with_is_new(comments).groupBy("run_id", "snapshot_seq").agg(F.count_if("is_new").alias("added"))


def distinct_count(comments: DataFrame, approximate: bool = False) -> DataFrame:
    return comments.groupBy("run_id").agg((F.approx_count_distinct("_key") if approximate else F.count_distinct("_key")).alias("n"))


def key_sketches(comments: DataFrame, precision: int = 12) -> DataFrame:
    """(run_id, snapshot_seq, sketch): a mergeable sketch of the keys of each batch, of 2^precision bytes at most."""
    return comments.groupBy("run_id", "snapshot_seq").agg(F.hll_sketch_agg("_key", precision).alias("sketch"))


def merged_count(sketches: DataFrame) -> DataFrame:
    """(run_id, n): the distinct keys of each run by its batches' sketches alone (standard error about 1.04 /
    2^(precision / 2), 1.6 % at 12); no keys are read again."""
    return sketches.groupBy("run_id").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n"))


def running_distinct(comments: DataFrame) -> DataFrame:
    """comments with collected: the distinct keys of the run up to each row."""
    run = Window.partitionBy("run_id").orderBy("arrival_seq").rowsBetween(Window.unboundedPreceding, 0)
    return with_is_new(comments).withColumn("collected", F.sum(F.col("is_new").cast("long")).over(run))


def export_count(runs: DataFrame, exported: DataFrame) -> DataFrame:
    """(run_id, n) of every run, 0 without rows."""
    counts = exported.groupBy("run_id").agg(F.count("*").alias("n"))
    return runs.select("run_id").distinct().join(counts, "run_id", "left").select("run_id", F.coalesce("n", F.lit(0)).alias("n"))
