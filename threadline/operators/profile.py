"""A structural profile of pages of the second family.

What stands inside what is found by one ordered pass over a page (intervals.py). Elements are reduced to the
few that matter first (times, profile links, and the ancestors of times), and nodes are written once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import js_trim, slice_n
from ..functions.urls import is_profile
from .intervals import inner_text, innermost, outer_markup

#: What triggers and replies say, and how much of everything is shown.
LOAD_MORE = r"(?i)load\s*more\s*comments|view\s*(all\s*)?\d|more\s*comments"
REPLY = r"(?i)repl(y|ies)|view\s*\d+\s*repl"
LINKS, LIKES, LABELS, REPLIES, STYLE = 3, 4, 20, 3, 120
NONE = "(none)"
#: How many characters of an element's markup are shown.
MARKUP = {"block": 2500, "container": 1000, "load_more": 600, "link": 200, "like": 300, "reply": 300}


def is_time() -> Column:
    return (F.col("tag") == "time") & F.col("attrs.datetime").isNotNull()


def is_profile_link() -> Column:
    return F.coalesce((F.col("tag") == "a") & is_profile(F.col("attrs.href")), F.lit(False))


def time_count(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("page_id").agg(F.count_if(F.coalesce(is_time(), F.lit(False))).alias("time_count"))


def ancestor_counts(nodes: DataFrame) -> DataFrame:
    """(page_id, ord, end, tag, attrs, times, links, first_time) of every element around a time: how many times and
    profile links it holds. Running counts over the page give the counts inside an interval as a
    difference, so elements are never joined with each other."""
    page = Window.partitionBy("page_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    t, p = F.coalesce(is_time(), F.lit(False)).cast("long"), is_profile_link().cast("long")
    rows = nodes.select("page_id", "ord", "end", "kind", "tag", "attrs", F.sum(t).over(page).alias("t"), F.sum(p).over(page).alias("p"))
    ends = rows.filter("kind = 'close'").select("page_id", F.col("ord").alias("end"), F.col("t").alias("te"), F.col("p").alias("pe"))
    opens = rows.filter("kind = 'open' and end > ord and tag not in ('body', 'html')")
    return opens.join(ends, ["page_id", "end"]).select("page_id", "ord", "end", "tag", "attrs", (F.col("te") - F.col("t")).alias("times"), (F.col("pe") - F.col("p")).alias("links"))


def blocks(nodes: DataFrame, first_only: bool = False) -> DataFrame:
    """(page_id, time_ord, block): for every time (or the page's first) the innermost element around it
    that holds several times, or one and a profile link; null if none below the body does."""
    times = nodes.filter(is_time()).select("page_id", F.col("ord").alias("time_ord"))
    if first_only:
        times = times.groupBy("page_id").agg(F.min("time_ord").alias("time_ord"))
    around = ancestor_counts(nodes).filter("times > 1 or times = 1 and links >= 1").select("page_id", "ord", "end", F.struct("ord", "end", "tag", "attrs", "times", "links").alias("block"))
    best = innermost(around.select("page_id", "ord", "end"), times.select("page_id", F.col("time_ord").alias("at"), F.col("time_ord").alias("until")))
    return best.join(around.drop("end"), ["page_id", "ord"], "left").select("page_id", F.col("at").alias("time_ord"), "block")


def containers(nodes: DataFrame) -> DataFrame:
    """(page_id, block, container): the page's first block, and the innermost element around it with
    three times or more."""
    first = blocks(nodes, first_only=True).select("page_id", "block")
    many = ancestor_counts(nodes).filter("times >= 3").select("page_id", "ord", "end", F.struct("ord", "end", "tag", "attrs").alias("container"))
    best = innermost(many.select("page_id", "ord", "end"), first.filter("block is not null").select("page_id", F.col("block.ord").alias("at"), F.col("block.end").alias("until")))
    return first.join(best.join(many.drop("end"), ["page_id", "ord"]).select("page_id", "container"), "page_id", "left")


def container_attrs(found: DataFrame) -> DataFrame:
    """(page_id, tag, id, role, aria_label, style) of the containers of containers()."""
    shown = lambda name: F.coalesce(F.nullif(F.col(f"container.attrs.{name}"), F.lit("")), F.lit(NONE))
    return found.filter("container is not null").select(
        "page_id", F.col("container.tag").alias("tag"), shown("id").alias("id"), shown("role").alias("role"), shown("`aria-label`").alias("aria_label"), slice_n(shown("style"), STYLE).alias("style")
    )


def _in_root(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """The nodes inside each page's container, or of the whole page without one."""
    rows = nodes.join(found.select("page_id", "container"), "page_id", "left")
    return rows.filter(F.col("container").isNull() | ((F.col("ord") > F.col("container.ord")) & (F.col("ord") < F.col("container.end"))))


def _first(n: int, where: Column, value: Column) -> Column:
    picked = F.collect_list(F.when(where, F.struct("ord", value.alias("v"))))
    return F.transform(F.slice(F.sort_array(picked), 1, n), lambda x: x["v"])


def profile_links(nodes: DataFrame, found: DataFrame) -> DataFrame:
    rows = _in_root(nodes, found)
    return rows.groupBy("page_id").agg(F.count_if(is_profile_link()).alias("profile_links"), _first(LINKS, is_profile_link(), F.col("attrs.href")).alias("link_sample"))


def like_labels(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(page_id, labels): the first labels that speak of likes; without any, the first labels."""
    label = F.col("attrs.aria-label")
    rows = _in_root(nodes, found).groupBy("page_id").agg(_first(LIKES, F.coalesce(label.rlike("(?i)like"), F.lit(False)), label).alias("likes"), _first(LABELS, F.coalesce(label != "", F.lit(False)), label).alias("all"))
    return rows.select("page_id", F.when(F.size("likes") > 0, F.col("likes")).otherwise(F.col("all")).alias("labels"))


def with_content(nodes: DataFrame, where: Column) -> DataFrame:
    """(page_id, ord, end, tag, content) of the elements for which where holds: all text inside, trimmed."""
    return inner_text(nodes, where).withColumn("content", js_trim(F.col("content")))


def _is_button() -> Column:
    return (F.col("tag") == "button") | F.coalesce(F.col("attrs.role") == "button", F.lit(False))


def asking_for_more(nodes: DataFrame, tightest: bool = True) -> DataFrame:
    """(page_id, ord, end, tag) of the controls whose text asks for more. The first hit is often a
    wrapper around all; tightest takes those that hold no other hit."""
    rows = with_content(nodes, _is_button() | F.col("tag").isin("span", "div")).filter(F.col("content").rlike(LOAD_MORE))
    if tightest:
        following = F.lead("ord").over(Window.partitionBy("page_id").orderBy("ord"))
        rows = rows.withColumn("next", following).filter("next is null or next > end")
    return rows.select("page_id", "ord", "end", "tag")


def load_more(nodes: DataFrame, tightest: bool = True) -> DataFrame:
    """(page_id, load_more): the tag of the first control of asking_for_more."""
    return asking_for_more(nodes, tightest).groupBy("page_id").agg(F.min_by("tag", "ord").alias("load_more"))


def reply_buttons(nodes: DataFrame, found: DataFrame) -> DataFrame:
    rows = with_content(_in_root(nodes, found).drop("container"), _is_button()).filter(F.col("content").rlike(REPLY))
    return rows.groupBy("page_id").agg(_first(REPLIES, F.lit(True), F.left("content", F.lit(80))).alias("reply_buttons"))


def markup_samples(nodes: DataFrame) -> DataFrame:
    """(page_id, what, place, markup): how the page writes its block, container, trigger, and first links, likes and
    replies, without comments and scripts. What a page doesn't have gives no row. Give written nodes: they are read for every part."""
    found = containers(nodes)
    root = _in_root(nodes, found).drop("container")
    by_ord = Window.partitionBy("page_id").orderBy("ord")

    def first(what: str, rows: DataFrame, n: int) -> DataFrame:
        ranked = rows.select("page_id", "ord", "end", F.row_number().over(by_ord).alias("k")).filter(F.col("k") <= n)
        return ranked.select("page_id", F.lit(what).alias("what"), (F.col("k") - 1).alias("place"), "ord", "end", F.lit(MARKUP[what]).alias("most"))

    one = lambda what: first(what, found.filter(F.col(what).isNotNull()).select("page_id", f"{what}.ord", f"{what}.end"), 1)
    labelled = root.filter(F.coalesce(F.col("attrs.aria-label").rlike("(?i)like"), F.lit(False)))
    replies = with_content(root, _is_button()).filter(F.col("content").rlike(REPLY))
    wanted = one("block").unionAll(one("container")).unionAll(first("load_more", asking_for_more(nodes), 1)).unionAll(first("link", root.filter(is_profile_link()), LINKS))
    return outer_markup(nodes, wanted.unionAll(first("like", labelled, LIKES)).unionAll(first("reply", replies, REPLIES)))


def page_profile(nodes: DataFrame) -> DataFrame:
    """One row per page with nodes. Give written nodes: they are read for every part."""
    found = containers(nodes)
    out = time_count(nodes).join(found.select("page_id", F.col("block.tag").alias("block_tag"), F.col("container.tag").alias("container_tag")), "page_id", "left")
    for part in (profile_links(nodes, found), like_labels(nodes, found), reply_buttons(nodes, found), load_more(nodes)):
        out = out.join(part, "page_id", "left")
    return out
