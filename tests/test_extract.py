"""Shredding and extraction on small pages."""

import os

import pytest
from pyspark.sql import functions as F

from threadline.operators import extract as E
from threadline.operators.shred import nodes


def page(spark, *htmls):
    return spark.createDataFrame([(i, h) for i, h in enumerate(htmls)], "page_id long, html string")


def thread(body, attrs=""):
    return f"<ytd-comment-thread-renderer{attrs}>{body}</ytd-comment-thread-renderer>"


def parsed(spark, *bodies, compat=False, attrs=""):
    html = "<p>never closed<div>" + "".join(thread(b, attrs) for b in bodies) + "</div>"
    return E.parse_threads(E.find_threads(page(spark, html)), compat=compat).orderBy("thread_ord").collect()


def test_intervals(spark):
    rows = {r.tag + str(r.ord): r for r in nodes(page(spark, "<div><p>a<p>b<div>c</div><br></div>x")).collect()}
    assert rows["div0"].end > rows["div5"].end > rows["div5"].ord
    assert rows["p1"].end == rows["p1"].ord  # never closed


@pytest.mark.parametrize(
    "html",
    ["<div " + "x" * 20_000 + "></div>t", "<div " + " ".join(f'k{i}="v"' for i in range(5_000)) + "></div>t", "<div a='>' b=\">\"></div>t", "a < b <div></div>", '<div a="' + "y" * 50_000 + '"></div>t'],
)
def test_stress_inputs(spark, html):
    assert "div" in {r.tag for r in nodes(page(spark, html)).select("tag").collect()}


def test_opaque_parts_and_entities(spark):
    rows = nodes(page(spark, '<!-- <a> --><script>var t="</p><b>";</script><i title="x">a &amp;lt; &lt;b&gt;&nbsp;c</i>', None, "")).collect()
    assert {r.tag for r in rows} == {"i", ""}
    assert [r.text for r in rows if r.kind == "text"] == ["a &lt; <b> c"]


def test_field_precedence(spark):
    rows = parsed(
        spark,
        '<div id="comment"><span id="content-text"></span><yt-attributed-string>x</yt-attributed-string><i id="vote-count-middle"></i><b aria-label="5 likes"></b></div>',
        '<div id="comment"><yt-attributed-string> a <b>b</b>\nc </yt-attributed-string><b aria-label="1.2K likes"></b></div>',
        '<ytd-comment-view-model>no text element</ytd-comment-view-model><ytd-button-renderer id="more-replies"><button>View 1,234 replies</button></ytd-button-renderer>',
        "<div>not there yet</div>",
    )
    assert [(r.text, r.likes, r.replyCount, r.layout) for r in rows] == [("", 0, 0, "classic"), ("a b c", 1200, 0, "classic"), ("", 0, 1234, "view_model")]
    assert [r.likes_missed for r in rows] == [False, False, True]


KEY_BODY = '<ytd-comment-renderer id="{inner}"><div id="comment"><i id="content-text">hi</i><i id="vote-count-middle">7</i></div></ytd-comment-renderer>{link}'


@pytest.mark.parametrize(
    ("attrs", "link", "inner", "compat", "want"),
    [
        (' data-comment-id="A"', "/w?lc=B", "r9", False, "A"),
        (' data-comment-id=""', "/watch?v=x&amp;lc=UgA&amp;t=1", "r9", True, "UgA"),
        ("", "/watch?v=x&amp;lc=UgA#f", "r9", True, "UgA#f"),
        ("", "/watch?v=x&amp;lc=UgA#f", "r9", False, "UgA"),
        ("", "", "comment", True, "comment"),
        ("", "", "comment", False, "7::hi"),
        ("", "", "r9", False, "r9"),
        ("", "", "", False, "7::hi"),
    ],
)
def test_dedup_key(spark, attrs, link, inner, compat, want):
    tag = f'<published-time-text><a href="{link}">1 day</a></published-time-text>' if link else ""
    assert [r._key for r in parsed(spark, KEY_BODY.format(inner=inner, link=tag), attrs=attrs, compat=compat)] == [want]


def test_time_link_by_class(spark):
    body = KEY_BODY.format(inner="", link='<span class="published-time-text x"><a href="/w?lc=C">t</a></span>')
    assert parsed(spark, body)[0]._key == "C"
    assert parsed(spark, body, compat=True)[0]._key == "7::hi"


def test_issues(spark):
    rows = E.find_threads(page(spark, thread("<i></i>") + thread("<ytd-comment-view-model>x</ytd-comment-view-model>")))
    issues = E.extraction_issues(E.examine_threads(rows)).collect()
    assert sorted(r.code for r in issues) == ["alternate_layout", "likes_selector_miss", "unhydrated"]
    assert all(r.snippet.startswith("<ytd-comment") for r in issues)


def test_nested_threads(spark):
    inner = '<div id="comment"><i id="content-text">{}</i></div>'
    html = thread(thread(inner.format("in")) + inner.format("out")) + thread(inner.format("next"))
    texts = lambda **how: [r.text for r in E.parse_threads(E.find_threads(page(spark, html), **how)).orderBy("thread_ord").collect()]
    assert texts(outermost=True) == ["in", "next"]
    assert "in" in texts() and "next" in texts()


def test_content_after_an_inner_thread(spark):
    button = '<ytd-button-renderer id="more-replies"><button>View {} replies</button></ytd-button-renderer>'
    inner = thread('<div id="comment"><i id="content-text">in</i></div>')
    html = thread('<div id="comment"><i id="content-text">out</i></div>' + inner + button.format(7)) + thread('<div id="comment"><i id="content-text">next</i></div>' + button.format(2))
    rows = E.parse_threads(E.find_threads(page(spark, html))).orderBy("thread_ord").collect()
    assert [(r.text, r.replyCount) for r in rows] == [("out", 7), ("in", 0), ("next", 2)]


def test_nested_threads_of_a_wrapper(spark):
    inner = thread('<div id="comment"><i id="content-text">a</i></div>' + thread('<div id="comment"><i id="content-text">b</i></div>'))
    count = lambda html: E.find_threads(page(spark, html), outermost=True).count()
    assert [count(h) for h in (inner, f"<section>{inner}</section>", f"<section>{inner}</section>{inner}", "<br>" + inner + inner)] == [1, 2, 3, 2]


def test_titles(spark):
    first = '<ytd-watch-metadata><h1 class="x ytd-watch-metadata"><yt-formatted-string> A </yt-formatted-string></h1></ytd-watch-metadata>'
    pages = page(spark, f"<title>T</title>{first}", "<title> T </title><div id='title'><h1>C</h1></div>", "<title>T</title>", "<p>x", '<title>T</title><h1 class="ytd-watch-metadata"></h1>', None)
    assert [r.title for r in E.page_titles(pages, "none").orderBy("page_id").collect()] == ["A", "C", "T", "none", "", "none"]


def test_empty_tables(spark):
    none = page(spark, "x").filter(F.lit(False))
    assert E.parse_threads(E.find_threads(none)).count() == 0
    assert E.page_titles(none, "none").count() == 0


def test_quarantined_snippets_end_with_short_texts(spark, matches_sql, tmp_path):
    from threadline.plans.queries import ORACLE_SQL, QUERIES

    texts = ["Hi.", "", None, "a < b & c\nd", "x" * 500, "y" * 29, "é" * 30]
    rows = [(c, turn, "user", text) for c, text in enumerate(texts) for turn in range(3)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/written")
    os.rename(next(iter(tmp_path.glob("written/*.parquet"))), tmp_path / "conversations.parquet")
    assert matches_sql(QUERIES["sink_quarantine"], ORACLE_SQL["sink_quarantine"], str(tmp_path)) == 14
