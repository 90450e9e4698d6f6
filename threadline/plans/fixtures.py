"""Snapshots made from the given tables, so that extraction can be held against their columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def escape(x: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(char), F.lit(entity))
    return x


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations with what their threads say: label, key, replies."""
    raw = F.coalesce(F.col("text"), F.lit(""))
    n = F.pmod(F.length(raw).cast("long") * 37, F.lit(5_000_000))
    label = (
        F.when(n < 1000, n.cast("string"))
        .when(n < 1_000_000, F.concat(F.floor(n / 1000), F.lit("."), F.floor(n % 1000 / 100), F.lit("K")))
        .otherwise(F.concat(F.floor(n / 1_000_000), F.lit("."), F.floor(n % 1_000_000 / 100_000), F.lit("M")))
    )
    key = F.concat(F.lit("c"), F.col("conv_id"), F.lit("-"), F.floor(F.col("turn") / 2))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", raw.alias("text"), label.alias("label"), key.alias("key"))


def thread_html() -> Column:
    """The markup of a turn's thread: classic, view model or not filled yet, by turn % 3."""
    text, label, key = escape(F.col("text")), F.col("label"), F.col("key")
    more = F.when(F.col("turn") == 0, "").otherwise(F.concat(F.lit('<ytd-button-renderer id="more-replies"><button>View '), F.format_number(F.col("turn") * 1234, 0), F.lit(" replies</button></ytd-button-renderer>")))
    classic = F.concat(
        F.lit('<ytd-comment-thread-renderer data-comment-id="'), key, F.lit('"><ytd-comment-renderer id="comment"><yt-attributed-string id="content-text">'), text,
        F.lit('</yt-attributed-string><span id="vote-count-middle"> '), label, F.lit(" </span></ytd-comment-renderer>"), more, F.lit("</ytd-comment-thread-renderer>"),
    )
    model = F.concat(
        F.lit('<ytd-comment-thread-renderer><ytd-comment-view-model><published-time-text><a href="/watch?v=x&amp;lc='), key, F.lit('&amp;t=1#f">1 day ago</a></published-time-text><yt-attributed-string>'), text,
        F.lit('</yt-attributed-string><button aria-label="'), label, F.lit(' likes"></button></ytd-comment-view-model>'), more, F.lit("</ytd-comment-thread-renderer>"),
    )
    late = F.lit('<ytd-comment-thread-renderer><div class="skeleton"><br></div></ytd-comment-thread-renderer>')
    return F.when(F.col("turn") % 3 == 0, classic).when(F.col("turn") % 3 == 1, model).otherwise(late)


def _page(rows: DataFrame, part: Column, head: Column, tail: str) -> DataFrame:
    """One page for each conversation: its parts in the order of turns, which a page bounds."""
    parts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "part"))), lambda x: x["part"]), "\n")
    return rows.withColumn("part", part).groupBy("conv_id").agg(parts.alias("parts")).select("conv_id", F.concat(head, F.col("parts"), F.lit(tail)).alias("html"))


def watch_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One whole page for each conversation, as the repair scan sees it."""
    head = F.concat(F.lit("<html><head><title> Video "), F.col("conv_id"), F.lit(": a/b  c </title></head><body><p>intro<ytd-comments>"))
    pages = _page(turns(spark, sf_dir), thread_html(), head, "</ytd-comments></body></html>")
    return pages.select(
        F.concat(F.lit("r"), F.col("conv_id")).alias("run_id"), F.lit(1_000).cast("long").alias("snapshot_seq"), F.col("conv_id").alias("page_id"),
        F.concat(F.lit("https://www.youtube.com/watch?v="), F.col("conv_id")).alias("url"), "html", F.lit(None).cast("timestamp").alias("captured_at"),
    )


def live_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fragment for each odd turn, in the order of turns, as they arrive while a run goes on."""
    return turns(spark, sf_dir).filter("turn % 2 = 1").select(
        F.concat(F.lit("r"), F.col("conv_id")).alias("run_id"), F.col("turn").cast("long").alias("snapshot_seq"), F.col("conv_id").alias("page_id"),
        F.concat(F.lit("https://www.youtube.com/watch?v="), F.col("conv_id")).alias("url"), thread_html().alias("html"), F.lit(None).cast("timestamp").alias("captured_at"),
    )


def post_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the second family for each conversation; every fourth turn has no author link."""
    turn = F.col("turn")
    link = F.when(turn % 4 == 3, "").otherwise(F.concat(F.lit('<a href="/user'), F.col("conv_id"), F.lit("_"), turn, F.lit('/">user</a>')))
    part = F.concat(
        F.lit('<div class="c">'), link, F.lit("<span>"), escape(F.col("text")), F.lit('</span><a href="/p/X/y"><time datetime="2024-01-01">1d</time></a><button aria-label="Like '), turn,
        F.lit('"><b></button><button>View '), turn + 1, F.lit(" replies</button></div>"),
    )
    head = F.lit('<html><body><main><div id="list" aria-label="Comments" style="overflow:auto">')
    pages = _page(turns(spark, sf_dir), part, head, '</div><button role="button">Load more comments</button></main></body></html>')
    return pages.select(F.col("conv_id").alias("page_id"), F.concat(F.lit("https://www.instagram.com/p/"), F.col("conv_id")).alias("url"), "html")


def ordered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as runs: run_id is the user, seq the place of an event in the user's time line. Windows over run_id
    that follow need no other shuffle."""
    from pyspark.sql import Window

    of = Window.partitionBy("run_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("run_id"), "event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    return rows.select("run_id", F.row_number().over(of).cast("long").alias("seq"), "ts", "event_type", "value", "event_id", "user_id")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress samples: each event collects one more."""
    return ordered_events(spark, sf_dir).select("run_id", "seq", "ts", F.col("seq").alias("n"), F.lit(60).cast("long").alias("total"))


def polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polls of a growing page: clicks make it grow; dear errors abort, dear signups end a run."""
    from pyspark.sql import Window

    run = Window.partitionBy("run_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    grown = F.sum((F.col("event_type") == "click").cast("long")).over(run)
    dear = lambda kind: (F.col("event_type") == kind) & (F.col("value") > 60)
    return ordered_events(spark, sf_dir).select(
        "run_id", F.col("seq").alias("poll_seq"), grown.alias("rendered"), (F.floor(grown / 2)).cast("long").alias("distinct_keys"), F.lit(12).cast("long").alias("limit"), dear("error").alias("aborted"), dear("signup").alias("ended")
    )
