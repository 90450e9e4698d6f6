"""Comments as text and JSON documents, one for each run.

fmt_txt() and fmt_json() make a run's document one row, by an ordered aggregate: for runs that fit
into a row, as limited exports do. export_lines() makes it many rows, for runs of any size: in order of
arrival they are the same document, with the head on the first and the tail on the last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import DIVIDER, export_name, meta_line


def txt_block(text: Column, likes: Column, replies: Column) -> Column:
    return F.concat_ws("\n", meta_line(likes, replies), F.nullif(text, F.lit("")), F.lit(DIVIDER))


def json_string(x: Column) -> Column:
    """A JSON string literal."""
    return F.coalesce(F.regexp_replace(F.to_json(F.struct(x.alias("v"))), r"(?s)^\{\"v\":|\}$", ""), F.lit("null"))


def json_block(text: Column, likes: Column, replies: Column) -> Column:
    field = lambda name, value: F.concat(F.lit(f'    "{name}": '), value)
    number = lambda n: F.coalesce(n.cast("string"), F.lit("null"))
    return F.concat(F.lit("  {\n"), F.concat_ws(",\n", field("text", json_string(text)), field("likes", number(likes)), field("replyCount", number(replies))), F.lit("\n  }"))


def _joined(comments: DataFrame, block: Column, between: str) -> DataFrame:
    rows = comments.select("run_id", "arrival_seq", block.alias("block"))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("arrival_seq", "block"))), lambda x: x["block"])
    return rows.groupBy("run_id").agg(F.array_join(parts, between).alias("body"))


def fmt_txt(comments: DataFrame) -> DataFrame:
    """(run_id, body): blocks in order of arrival."""
    return _joined(comments, txt_block(F.col("text"), F.col("likes"), F.col("replyCount")), "\n")


def fmt_json(comments: DataFrame) -> DataFrame:
    """(run_id, body): an array of objects, indented by two."""
    out = _joined(comments, json_block(F.col("text"), F.col("likes"), F.col("replyCount")), ",\n")
    return out.withColumn("body", F.concat(F.lit("[\n"), F.col("body"), F.lit("\n]")))


def export_lines(comments: DataFrame, form: str, salts: int = 16) -> DataFrame:
    """(run_id, arrival_seq, value): a comment each; the values of a run in order of arrival, joined by newlines, are what
    fmt_txt() or fmt_json() make of it. No run is gathered: which rows are first and last comes from an
    aggregate, joined back over ``salts`` keys a run. Arrivals of a run must differ; a null run_id is left out."""
    block = (txt_block if form == "txt" else json_block)(F.col("text"), F.col("likes"), F.col("replyCount"))
    rows = comments.select("run_id", "arrival_seq", block.alias("value"))
    if form == "txt":
        return rows.filter("run_id is not null")
    ends = comments.groupBy("run_id").agg(F.min("arrival_seq").alias("first"), F.max("arrival_seq").alias("last"))
    ends = ends.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    found = rows.withColumn("salt", F.pmod(F.xxhash64("arrival_seq"), F.lit(salts)).cast("int")).join(ends, ["run_id", "salt"])
    head = F.when(F.col("arrival_seq") == F.col("first"), "[\n").otherwise("")
    tail = F.when(F.col("arrival_seq") == F.col("last"), "\n]").otherwise(",")
    return found.select("run_id", "arrival_seq", F.concat(head, "value", tail).alias("value"))


def exports(comments: DataFrame, titles: DataFrame, form: str) -> DataFrame:
    """(run_id, name, body) of every run with rows; titles(run_id, title)."""
    body = fmt_txt(comments) if form == "txt" else fmt_json(comments)
    return body.join(titles, "run_id", "left").select("run_id", export_name(F.col("title"), form).alias("name"), "body")
