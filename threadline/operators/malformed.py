"""Nodes of pages whose elements are not closed, or closed in the wrong order.

``shred.nodes`` pairs the tags that a page has. Here a task reads its pages with the standard parser and a stack
of open elements, and writes the end tags that a page leaves out, so that intervals always nest. The schema is that of
``shred.nodes``, so every operator on nodes takes either. No shuffle: a page is one row, read by one task."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from html import escape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .intervals import emitted
from .shred import ATTRIBUTE_NAMES, VOID

#: Fixed values of the HTML standard: which elements end which.
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
ENDS_PARAGRAPH = (
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form",
    "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "ul", *HEADINGS,
)
SPECIAL = frozenset((
    *ENDS_PARAGRAPH, "body", "button", "caption", "col", "colgroup", "dd", "dt", "frame", "frameset", "head", "html", "iframe", "li", "link", "marquee", "meta",
    "noscript", "object", "script", "select", "source", "style", "tbody", "td", "template", "textarea", "tfoot", "th", "thead", "title", "tr",
))
FORMATTING = frozenset(("a", "b", "big", "code", "em", "font", "i", "nobr", "s", "small", "strike", "strong", "tt", "u"))
SCOPE = frozenset(("applet", "caption", "html", "marquee", "object", "table", "td", "template", "th"))
TABLE_SCOPE = frozenset(("html", "table", "template"))
#: A new element of the key ends open ones of the values, if no element of the scope lies between.
REPLACES = {
    "li": (("li",), SPECIAL - {"address", "div", "p"}), "dd": (("dd", "dt"), SPECIAL - {"address", "div", "p"}), "dt": (("dd", "dt"), SPECIAL - {"address", "div", "p"}),
    "button": (("button",), SCOPE), "a": (("a",), SPECIAL), "td": (("td", "th"), TABLE_SCOPE), "th": (("td", "th"), TABLE_SCOPE), "tr": (("tr",), TABLE_SCOPE),
    "tbody": (("tbody", "thead", "tfoot"), TABLE_SCOPE), "thead": (("tbody", "thead", "tfoot"), TABLE_SCOPE), "tfoot": (("tbody", "thead", "tfoot"), TABLE_SCOPE),
    "option": (("option",), SPECIAL | {"optgroup"}), "optgroup": (("optgroup",), SPECIAL),
}
#: How far an end tag reaches; any other block's reaches to SCOPE, anything else to the next block.
REACH = {"li": SCOPE | {"ol", "ul"}, "p": SCOPE | {"button"}} | dict.fromkeys(("caption", "table", "tbody", "td", "tfoot", "th", "thead", "tr"), TABLE_SCOPE)
#: Formatting elements open inside these end with them.
MARKERS = frozenset(("applet", "caption", "marquee", "object", "td", "template", "th"))
UNREAD = ("script", "style")


class _Page(HTMLParser):
    """rows: [end, kind, tag, raw, attributes, text] in document order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.stack: list[tuple[str, int]] = []
        self.places: defaultdict[str, list[int]] = defaultdict(list)
        self.again: dict[str, tuple[str, dict]] = {}
        self.unread = ""

    def _find(self, names: Sequence[str], stop: frozenset[str]) -> int:
        """The place in the stack of the innermost open element of some names, -1 if something of stop lies inside it."""
        if self.stack and self.stack[-1][0] in names:
            return len(self.stack) - 1
        place = self._innermost(names)
        return place if place >= 0 and self._innermost(stop) <= place else -1

    def _innermost(self, names: Iterable[str]) -> int:
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)

    def _close_to(self, place: int) -> None:
        """Ends the elements from a place of the stack on. Formatting elements inside the first go on after it, one of a name."""
        cut = self.stack[place + 1 :] if place >= 0 and self.stack[place][0] not in MARKERS else []
        for tag, at in cut:
            if tag in MARKERS:
                break
            if tag in FORMATTING:
                self.again.pop(tag, None)
                self.again[tag] = (self.rows[at][3], self.rows[at][4])
        while len(self.stack) > max(place, 0):
            tag, at = self.stack.pop()
            self.places[tag].pop()
            self.rows[at][0] = len(self.rows)
            self.rows.append([len(self.rows), "close", tag, f"</{tag}>", None, None])

    def _open(self, tag: str, raw: str, attrs: dict) -> None:
        self.places[tag].append(len(self.stack))
        self.stack.append((tag, len(self.rows)))
        self.rows.append([len(self.rows), "open", tag, raw, attrs, None])

    def _reopen(self) -> None:
        again, self.again = self.again, {}
        for tag, (raw, attrs) in again.items():
            self._open(tag, raw, attrs)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.unread or tag in UNREAD:
            self.unread = self.unread or tag
            return
        if tag in REPLACES and (place := self._find(*REPLACES[tag])) >= 0:
            self._close_to(place)
        if tag in HEADINGS and self.stack and self.stack[-1][0] in HEADINGS:
            self._close_to(len(self.stack) - 1)
        if (tag in ENDS_PARAGRAPH or tag in ("li", "dd", "dt")) and (place := self._find(("p",), REACH["p"])) >= 0:
            self._close_to(place)
        if tag not in SPECIAL:
            self._reopen()
        named: dict[str, str] = {}
        for name, value in attrs:
            named.setdefault(name, value or "")
        raw = self.get_starttag_text() or f"<{tag}>"
        if tag in VOID:
            self.rows.append([len(self.rows), "void", tag, raw, named, None])
        else:
            self._open(tag, raw, named)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        """As shred.nodes has it, a tag that ends in /> is void whatever its name."""
        if self.unread or tag in UNREAD:
            return
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.stack.pop()
            self.places[tag].pop()
            self.rows[-1][1] = "void"

    def handle_endtag(self, tag: str) -> None:
        if self.unread:
            self.unread = "" if tag == self.unread else self.unread
            return
        if self.again.pop(tag, None):
            return
        place = self._find((tag,), REACH.get(tag, SCOPE if tag in SPECIAL else SPECIAL))
        if tag in HEADINGS and place < 0:
            place = self._find(HEADINGS, SCOPE)
        if place >= 0:
            self._close_to(place)
        elif tag == "p":
            self._open("p", "<p>", {})
            self._close_to(len(self.stack) - 1)

    def handle_data(self, data: str) -> None:
        if self.unread or not data:
            return
        self._reopen()
        if self.rows and self.rows[-1][1] == "text":
            data = self.rows.pop()[5] + data
        self.rows.append([len(self.rows), "text", "", escape(data, quote=False), None, data])

    def finish(self) -> list[list]:
        self.close()
        self._close_to(-1)
        return self.rows


def parse_page(html: str) -> list[list]:
    """[end, kind, tag, raw, attributes by name, text] of a page's nodes; a node's place in the list is its ord."""
    page = _Page()
    page.feed(html)
    return page.finish()


def parsed_nodes(pages: DataFrame, keys: Sequence[str] = ("page_id",), html: str = "html", attributes: Sequence[str] = ATTRIBUTE_NAMES) -> DataFrame:
    """(keys, ord, end, kind, tag, raw, attrs, text), as shred.nodes gives them, of pages that need not be well formed.

    A start tag ends what can't hold it (``li``, ``p``, cells, options, ...), an end tag ends what is open inside its
    element, and the page's end everything. An end tag that fits nothing in reach is left out; ``</p>`` is then an empty
    paragraph. Formatting elements that another element's end cut off go on after it, one of a name, except out of a cell; they
    don't end across a block. Left-out
    end tags are rows too, so intervals nest strictly; no elements are added otherwise (``tbody``, ``body``).
    All character references are read. Comments, scripts and styles are left out; raw of a text is its escaped form.
    Null and empty pages have no nodes; repeated rows give repeated nodes, other columns are not read."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    rows = pages.select(*keys, F.col(html).cast("string").alias("html"))
    made = ", ".join(f"`{a}`: string" for a in attributes)
    out = StructType([*(rows.schema[i] for i in range(len(keys))), *StructType.fromDDL(f"ord long, end long, kind string, tag string, raw string, attrs struct<{made}>, text string")])
    schema, names = to_arrow_schema(out), tuple(attributes)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for *key, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for at, (end, kind, tag, raw, found, text) in enumerate(parse_page(page) if page else ()):
                    yield *key, at, end, kind, tag, raw, None if found is None else {a: found.get(a) for a in names}, text

    return rows.mapInArrow(lambda batches: emitted(parse(batches), schema), out)
