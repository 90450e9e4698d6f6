"""Pages as tables of tokens with intervals.

A page is cut into tags and texts by one regular expression; every element gets the place of
its end tag, so that "inside" is a comparison of numbers. Depth is counted for each tag name
by itself, which keeps intervals right when other elements are never closed. All windows are
over one page, after one shuffle by page; the page's text is dropped before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Possessive, so that no tag of any length makes the matcher recurse.
TOKEN = r"""<(?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^<]++"""
ATTRIBUTE = r"""[^\s=/>"'<]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"']++))?+"""
#: Parts whose content is no markup.
OPAQUE = r"(?is)<!--.*?-->|<(script|style)\b[^>]*+>.*?</\1\s*>|<![^>]*+>"
#: Elements without end tag.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
ATTRIBUTE_NAMES = ("id", "class", "href", "role", "style", "datetime", "aria-label", "data-comment-id", "is-no-comments", "data-no-comments")


def unescape(x: Column) -> Column:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    return x


def tokens(pages: DataFrame, keys: Sequence[str] = ("page_id",), html: str = "html") -> DataFrame:
    """(keys, ord, kind, tag, raw) for every tag and text; kind is open, close, void or text."""
    cut = F.regexp_extract_all(F.regexp_replace(html, OPAQUE, ""), F.lit(TOKEN), 0)
    rows = pages.select(*keys, F.posexplode(cut).alias("ord", "raw"))
    tag = F.lower(F.regexp_extract("raw", r"^</?\s*+([A-Za-z][A-Za-z0-9-]*+)", 1))
    kind = (
        F.when(~F.col("raw").startswith("<"), "text").when(F.col("raw").startswith("</"), "close")
        .when(F.col("raw").endswith("/>") | F.col("tag").isin(*VOID), "void").otherwise("open")
    )
    return rows.withColumn("tag", tag).filter((F.col("tag") != "") | ~F.col("raw").startswith("<")).select(*keys, "ord", kind.alias("kind"), "tag", "raw")


def attribute_parts(raw: str | Column) -> Column:
    """The attributes of a tag, as they stand."""
    return F.regexp_extract_all(F.regexp_replace(raw, r"^<\s*+[A-Za-z][A-Za-z0-9-]*+|/?>$", ""), F.lit(ATTRIBUTE), 0)


def attribute_names(parts: str) -> Column:
    return F.transform(parts, lambda a: F.lower(F.trim(F.regexp_extract(a, "^([^=]*)", 1))))


def attribute_values(parts: str) -> Column:
    """The value of each attribute, "" if it has none."""
    return F.transform(parts, lambda a: unescape(F.regexp_replace(F.regexp_replace(a, r"^[^=]*+=?\s*+", ""), r"""^["']|["']$""", "")))


def dealt_nodes(pages: DataFrame, keys: Sequence[str] = ("page_id",), html: str = "html", attributes: Sequence[str] = ATTRIBUTE_NAMES) -> DataFrame:
    """nodes() with page_hash, a hash of the keys, by which rows are dealt out: windows and groups over
    page_hash and the keys need no other shuffle. By the keys alone they would where one of them is a
    constant, which Spark leaves out of a group but not out of a shuffle. The number of partitions is set, as the
    work of a page is far larger than its bytes, by which Spark would join partitions."""
    page = ("page_hash", *keys)
    of = Window.partitionBy(*page, "tag").orderBy("ord")
    level = Window.partitionBy(*page, "tag", "level").orderBy("ord")
    step = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = tokens(pages, keys, html).withColumn("page_hash", F.xxhash64(*keys)).repartition(parts, "page_hash")
    rows = rows.withColumn("level", F.sum(step).over(of) + (F.col("kind") == "close").cast("int"))
    # on one level, open and close tags of a name follow each other
    pairs = F.when((F.col("kind") == "open") & (F.lead("kind").over(level) == "close"), F.lead("ord").over(level))
    rows = rows.withColumn("level", F.when(F.col("kind").isin("open", "close"), F.col("level"))).withColumn("end", F.coalesce(pairs, F.col("ord")))
    # a tag is cut into its attributes once for all names; the first of a name counts
    rows = rows.withColumn("parts", F.when(F.col("kind").isin("open", "void"), attribute_parts("raw")))
    rows = rows.withColumns({"names": attribute_names("parts"), "values": attribute_values("parts")})
    attrs = F.when(F.col("parts").isNotNull(), F.struct(*(F.get("values", (F.array_position("names", a) - 1).cast("int")).alias(a) for a in attributes)))
    text = F.when(F.col("kind") == "text", unescape(F.col("raw")))
    return rows.select(*page, F.col("ord").cast("long"), F.col("end").cast("long"), "kind", "tag", "raw", attrs.alias("attrs"), text.alias("text"))


def nodes(pages: DataFrame, keys: Sequence[str] = ("page_id",), html: str = "html", attributes: Sequence[str] = ATTRIBUTE_NAMES) -> DataFrame:
    """(keys, ord, end, kind, tag, raw, attrs, text) for tags and texts, in document order.

    ``end`` is the place of the end tag; an element that is never closed, a void one, an end tag
    and a text end where they begin. attrs is a struct of the named attributes. Null pages have no nodes."""
    return dealt_nodes(pages, keys, html, attributes).drop("page_hash")
