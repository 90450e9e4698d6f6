import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from threadline.operators import malformed as M
from threadline.operators.shred import nodes


def outline(html):
    """Elements as (tag, text inside), in document order."""
    rows = M.parse_page(html)
    return [(r[2], "".join(x[5] for x in rows[at : r[0]] if x[1] == "text")) for at, r in enumerate(rows) if r[1] == "open"]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<p>one<p>two", [("p", "one"), ("p", "two")]),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e", [("ul", "abcd"), ("li", "a"), ("li", "bc"), ("ul", "c"), ("li", "c"), ("li", "d")]),
        ("<div><p>a<div>b</div>c</div>", [("div", "abc"), ("p", "a"), ("div", "b")]),
        ("<table><tr><td>a<td>b<tr><td>c</table>d", [("table", "abc"), ("tr", "ab"), ("td", "a"), ("td", "b"), ("tr", "c"), ("td", "c")]),
        ("<p>a<b>b<i>c</b>d</i>e</p>", [("p", "abcde"), ("b", "bc"), ("i", "c"), ("i", "d")]),
        ("<p><b>a<p>b</b>c", [("p", "a"), ("b", "a"), ("p", "bc"), ("b", "b")]),
        ("<div>a</span>b</div>", [("div", "ab")]),
        ("a</p>b", [("p", "")]),
        ("<select><option>a<option>b</select>", [("select", "ab"), ("option", "a"), ("option", "b")]),
        ("<button>a<button>b", [("button", "a"), ("button", "b")]),
        ("<h1>a<h2>b</h3>c", [("h1", "a"), ("h2", "b")]),
        ("<dl><dt>a<dd>b<dt>c</dl>", [("dl", "abc"), ("dt", "a"), ("dd", "b"), ("dt", "c")]),
        ("<script>if (a<b) {}</script><style>p{}</style><!-- <p> -->x", []),
        ("<p>a &lt; b&eacute;", [("p", "a < bé")]),
        ("", []),
    ],
)
def test_left_out_end_tags(html, want):
    assert outline(html) == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<li>", "</li>", "<ul>", "</ul>", "<b>", "</b>", "<a href=x>", "</a>", "<td>", "</td>", "<tr>", "<table>", "</table>", "<br>", "<x/>", "t", " ", "<script>", "</script>", "<!--", "-->", "<", "&amp;"])))
def test_intervals_nest_strictly(parts):
    rows, open_ = M.parse_page("".join(parts)), []
    for at, (end, kind, tag, *_) in enumerate(rows):
        if kind == "open":
            assert at < end < len(rows) and rows[end][1:3] == ["close", tag]
            open_.append(end)
        elif kind == "close":
            assert open_.pop() == at
        else:
            assert end == at
    assert not open_


def test_deep_and_long_pages():
    n = 30_000
    rows = M.parse_page("<div>" * n + "x")
    assert [r[0] for r in rows[:n]] == list(range(2 * n, n, -1))
    assert len(outline("<p>x" * n)) == n and len(M.parse_page("y" * 2_000_000)) == 1


def test_same_nodes_as_the_cutter_where_all_is_closed(spark):
    html = '<div id="a" class="x &amp; y"><p>one <b>two</b></p><img src=q><ul><li>c</li><li>d</li></ul>e</div>'
    pages = spark.createDataFrame([(1, html, "clash"), (1, html, "clash"), (2, None, "clash"), (3, "", "clash")], "page_id long, html string, ord string")
    rows = lambda f: sorted(map(str, f(pages, attributes=("id", "class")).collect()))
    got = rows(M.parsed_nodes)
    assert {r.page_id for r in M.parsed_nodes(pages).collect()} == {1} and len(got) % 2 == 0
    assert sorted(set(got)) == sorted(map(str, nodes(pages.dropDuplicates(["page_id"]), attributes=("id", "class")).collect()))
    assert M.parsed_nodes(pages.limit(0)).count() == 0
    assert M.parsed_nodes(pages).schema.simpleString() == nodes(pages).schema.simpleString()
