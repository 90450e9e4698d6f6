"""Comment threads of pages, and the typed fields of each."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.text import KEY_TEXT_LENGTH, WS, compact_count, first_int, js_trim, normalize_ws, slice_n
from ..functions.urls import lc_param
from .shred import dealt_nodes

#: The elements and attributes that hold the fields.
THREAD, VIEW_MODEL, RENDERER = "ytd-comment-thread-renderer", "ytd-comment-view-model", "ytd-comment-renderer"
COMMENT_ID, TEXT_ID, TEXT_TAG, VOTE_ID = "comment", "content-text", "yt-attributed-string", "vote-count-middle"
REPLIES_ID, REPLIES_TAG, TIME_TAG = "more-replies", "ytd-button-renderer", "published-time-text"
LIKES_LABEL = rf"(?i)(\d[\d,.]*{WS}*[KkMmBb]?){WS}+likes?"
SNIPPET, LAYOUT_SNIPPET = 200, 300
Element = Callable[[Column], Column]


def is_id(value: str) -> Element:
    return lambda e: e["attrs"]["id"] == value


def is_tag(value: str) -> Element:
    return lambda e: e["tag"] == value


def has_class(value: str) -> Element:
    return lambda e: F.array_contains(F.split(e["attrs"]["class"], r"\s+"), value)


def inside(e: Column, outer: Column) -> Column:
    return (e["ord"] > outer["ord"]) & (e["ord"] < outer["end"])


def first(els: str, where: Element) -> Column:
    """The first element, in document order, for which where holds; null without one."""
    return F.get(F.filter(els, lambda e: F.coalesce(e["kind"].isin("open", "void") & where(e), F.lit(False))), 0)


def content(els: str, outer: Column) -> Column:
    """All text inside an element, as it stands; null for no element."""
    return F.when(outer.isNotNull(), F.array_join(F.transform(F.filter(els, lambda e: F.coalesce((e["kind"] == "text") & inside(e, outer), F.lit(False))), lambda e: e["text"]), ""))


def outer_html(els: str, outer: Column, n: int) -> Column:
    """The first n characters of an element's markup."""
    return slice_n(F.array_join(F.transform(F.filter(els, lambda e: F.coalesce((e["ord"] >= outer["ord"]) & (e["ord"] <= outer["end"]), F.lit(False))), lambda e: e["raw"]), ""), n)


def find_threads(pages: DataFrame, keys: Sequence[str] = ("page_id",), html: str = "html", outermost: bool = False) -> DataFrame:
    """(keys, thread_ord, thread, els): every thread with its elements and texts, in document order.

    One shuffle by page: windows carry the latest outermost thread to what follows, and its
    elements are gathered where they are. A thread inside another is a row of its own too, with
    its part of those elements; the outer one has them all. With ``outermost``, as for
    fragments that arrive, a thread that is the root of what arrived stands for all inside it,
    while those inside any other element each count, however they are nested."""
    of = ("page_hash", *keys)
    page = Window.partitionBy(*of).orderBy("ord")
    rows = dealt_nodes(pages, keys, html)
    is_open = F.col("kind") == "open"
    is_thread = (F.col("tag") == THREAD) & is_open
    until = lambda cond: F.max(F.when(cond, F.col("end"))).over(page.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({"around": until(is_thread), "holder": until(is_open)})
    top = is_thread & (F.col("around").isNull() | (F.col("around") < F.col("ord")))
    opened = F.when(top, F.struct("ord", "end", (F.col("holder") > F.col("ord")).alias("wrapped")))
    rows = rows.withColumn("top", F.last(opened, ignorenulls=True).over(page)).filter(F.col("ord").between(F.col("top.ord"), F.col("top.end")))
    els = F.sort_array(F.collect_list(F.struct("ord", "end", "kind", "tag", "raw", "attrs", "text")))
    found = rows.groupBy(*of, "top").agg(els.alias("all"))
    threads = F.filter("all", lambda e: (e["tag"] == THREAD) & (e["kind"] == "open"))
    if outermost:
        threads = F.when(F.coalesce(F.col("top.wrapped"), F.lit(False)), threads).otherwise(F.slice(threads, 1, 1))
    found = found.select(*keys, "all", threads.alias("threads")).select(*keys, "all", F.size("threads").alias("n"), F.explode("threads").alias("thread"))
    own = F.filter("all", lambda e: e["ord"].between(F.col("thread.ord"), F.col("thread.end")))
    return found.select(*keys, F.col("thread.ord").alias("thread_ord"), "thread", F.when(F.col("n") == 1, F.col("all")).otherwise(own).alias("els"))


def with_layout(threads: DataFrame) -> DataFrame:
    """threads with comment (the element that holds the comment) and layout: classic, view_model
    or unhydrated (neither element is there yet)."""
    rows = threads.withColumn("classic", first("els", lambda e: is_id(COMMENT_ID)(e) & inside(e, F.col("thread"))))
    rows = rows.withColumn("model", F.when(F.col("classic").isNull(), first("els", lambda e: is_tag(VIEW_MODEL)(e) & inside(e, F.col("thread")))))
    layout = F.when(F.col("classic").isNotNull(), "classic").when(F.col("model").isNotNull(), "view_model").otherwise("unhydrated")
    return rows.withColumn("layout", layout).withColumn("comment", F.coalesce("classic", "model")).drop("classic", "model")


def filter_hydrated(threads: DataFrame) -> DataFrame:
    return with_layout(threads).filter("layout <> 'unhydrated'")


def _field_elements(rows: DataFrame, compat: bool) -> DataFrame:
    """The elements of each field, found once for all."""
    comment, thread = F.col("comment"), F.col("thread")
    rows = rows.withColumn("text_el", F.coalesce(first("els", lambda e: is_id(TEXT_ID)(e) & inside(e, comment)), first("els", lambda e: is_tag(TEXT_TAG)(e) & inside(e, comment))))
    rows = rows.withColumn("vote_el", first("els", lambda e: is_id(VOTE_ID)(e) & inside(e, comment)))
    rows = rows.withColumn("label_el", first("els", lambda e: e["attrs"]["aria-label"].rlike(LIKES_LABEL) & inside(e, comment)))
    rows = rows.withColumn("more_el", first("els", lambda e: is_id(REPLIES_ID)(e) & inside(e, thread)))
    button = first("els", lambda e: (is_tag("button")(e) & inside(e, F.col("more_el"))) | (is_tag(REPLIES_TAG)(e) & is_id(REPLIES_ID)(e) & inside(e, thread)))
    rows = rows.withColumn("reply_el", button)
    holder = is_tag(TIME_TAG) if compat else lambda e: is_tag(TIME_TAG)(e) | F.coalesce(has_class(TIME_TAG)(e), F.lit(False))
    rows = rows.withColumn("time_el", first("els", lambda e: holder(e) & inside(e, thread)))
    rows = rows.withColumn("link_el", first("els", lambda e: is_tag("a")(e) & e["attrs"]["href"].isNotNull() & inside(e, F.col("time_el"))))
    return rows.withColumn("inner_el", first("els", lambda e: is_tag(RENDERER)(e) & e["attrs"]["id"].isNotNull() & inside(e, thread)))


def fingerprint(likes: Column, text: Column) -> Column:
    return F.concat(F.coalesce(likes.cast("string"), F.lit("NaN")), F.lit("::"), slice_n(text, KEY_TEXT_LENGTH))


def dedup_key(attr: Column, href: Column, inner_id: Column, likes: Column, text: Column, compat: bool = False) -> Column:
    """The first that is not empty of: the thread's comment id, the id in its time link, the id of
    its inner element, likes and the start of the text. compat also takes the inner id that all
    threads of the classic layout share."""
    inner = F.nullif(inner_id, F.lit(""))
    if not compat:
        inner = F.nullif(inner, F.lit(COMMENT_ID))
    return F.coalesce(F.nullif(attr, F.lit("")), lc_param(href, compat), inner, fingerprint(likes, text))


def examine_threads(threads: DataFrame, keys: Sequence[str] = ("page_id",), compat: bool = False) -> DataFrame:
    """(keys, thread_ord, layout, text, likes, replyCount, _key, likes_missed, issues) of every thread, all from one row's
    elements. issues(code, snippet): no comment yet, the other layout, or no element for likes."""
    rows = _field_elements(with_layout(threads), compat)
    rows = rows.withColumns({"vote_text": content("els", F.col("vote_el")), "reply_text": content("els", F.col("reply_el"))})  # read at many places below
    text = F.coalesce(normalize_ws(content("els", F.col("text_el"))), F.lit(""))
    label = F.regexp_extract(F.col("label_el.attrs.aria-label"), LIKES_LABEL, 1)
    likes = F.when(F.col("vote_el").isNotNull(), compact_count(F.col("vote_text"))).when(F.col("label_el").isNotNull(), compact_count(label)).otherwise(F.lit(0).cast("long"))
    replies = F.when(F.col("reply_el").isNull(), F.lit(0).cast("long")).otherwise(first_int(F.col("reply_text")))
    missed = F.col("vote_el").isNull() & F.col("label_el").isNull()
    rows = rows.withColumns({"c_text": text, "likes": likes, "replyCount": replies, "likes_missed": missed})
    key = dedup_key(F.col("thread.attrs.data-comment-id"), F.col("link_el.attrs.href"), F.col("inner_el.attrs.id"), F.col("likes"), F.col("c_text"), compat)
    late = F.col("layout") == "unhydrated"
    issue = lambda where, code, el, n: F.when(where, F.struct(F.lit(code).alias("code"), outer_html("els", F.col(el), n).alias("snippet")))
    issues = F.array_compact(
        F.array(
            issue(late, "unhydrated", "thread", LAYOUT_SNIPPET), issue(F.col("layout") == "view_model", "alternate_layout", "thread", LAYOUT_SNIPPET),
            issue(~late & F.col("likes_missed"), "likes_selector_miss", "comment", SNIPPET),
        )
    )
    return rows.select(*keys, "thread_ord", "layout", F.col("c_text").alias("text"), "likes", "replyCount", key.alias("_key"), "likes_missed", issues.alias("issues"))


def parse_threads(threads: DataFrame, keys: Sequence[str] = ("page_id",), compat: bool = False) -> DataFrame:
    """(keys, thread_ord, layout, text, likes, replyCount, _key, likes_missed) of every thread that holds a comment
    element."""
    return examine_threads(threads, keys, compat).filter("layout <> 'unhydrated'").drop("issues")


def extraction_issues(examined: DataFrame, keys: Sequence[str] = ("page_id",)) -> DataFrame:
    """(keys, thread_ord, code, snippet) of the issues of examine_threads()."""
    return examined.select(*keys, "thread_ord", F.inline("issues"))


#: The codes of issues.
CODES = ("unhydrated", "alternate_layout", "likes_selector_miss")


def with_issue_counts(examined: DataFrame, seen: Observation) -> DataFrame:
    """examined as it is; when an action has read it, seen.get has the number of threads and of each code of issue,
    without another pass over the pages."""
    has = lambda code: F.exists("issues", lambda i: i["code"] == code)
    return examined.observe(seen, F.count(F.lit(1)).alias("threads"), *[F.count_if(has(code)).alias(code) for code in CODES])


def page_titles(pages: DataFrame, default: str, keys: Sequence[str] = ("page_id",), html: str = "html") -> DataFrame:
    """(keys, title): the text of the first of four elements that exists, trimmed, even if empty; the
    default for a page without any. Elements are told by themselves and the one around them."""
    rows = dealt_nodes(pages, keys, html)
    of = ("page_hash", *keys)
    page = Window.partitionBy(*of).orderBy("ord")
    span = lambda cond: F.last(F.when(cond & (F.col("kind") == "open"), F.struct("ord", "end")), ignorenulls=True).over(page)
    within = lambda s: F.coalesce((F.col("ord") > F.col(s)["ord"]) & (F.col("ord") < F.col(s)["end"]), F.lit(False))
    of_class = F.coalesce(F.array_contains(F.split("attrs.class", r"\s+"), "ytd-watch-metadata"), F.lit(False))
    heading = F.col("tag") == "h1"
    rows = rows.withColumns({"meta": span(F.col("tag") == "ytd-watch-metadata"), "box": span(F.col("attrs.id") == "title")})
    rows = rows.withColumns({"own_h1": span(heading & of_class), "box_h1": span(heading & within("box")), "head": span(F.col("tag") == "title")})
    rows = rows.withColumn("string", span((F.col("tag") == "yt-formatted-string") & within("meta") & within("own_h1")))
    picks = [("string", "a"), ("own_h1", "b"), ("box_h1", "c"), ("head", "d")]
    firsts = [F.min(F.col(s)["ord"]).over(Window.partitionBy(*of)).alias(f"{n}_ord") for s, n in picks]
    rows = rows.select(*of, "ord", "kind", "text", *(s for s, _ in picks), *firsts)
    texts = [F.sort_array(F.collect_list(F.when((F.col("kind") == "text") & within(s) & (F.col(s)["ord"] == F.col(f"{n}_ord")), F.struct("ord", "text")))).alias(n) for s, n in picks]
    found = rows.groupBy(*of).agg(*texts, *(F.min(f"{n}_ord").alias(f"{n}_ord") for _, n in picks))
    shown = [F.when(F.col(f"{n}_ord").isNotNull(), js_trim(F.array_join(F.transform(n, lambda x: x["text"]), ""))) for _, n in picks]
    titles = found.select(*keys, F.coalesce(*shown).alias("title"))
    return pages.select(*keys).join(titles, list(keys), "left").select(*keys, F.coalesce("title", F.lit(default)).alias("title"))
