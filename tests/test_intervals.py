"""Ordered folds against plain pairs: innermost intervals, inner texts, the throttle."""

import datetime as dt
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from threadline.operators import intervals as I
from threadline.operators import profile as P
from threadline.operators import runs as S
from threadline.operators.shred import nodes


def crossing(seed, pages=4, n=60):
    """Intervals of each page with ends of their own, and points between them."""
    draw = random.Random(seed)
    spans, points = [], []
    for page in range(pages):
        places = draw.sample(range(10 * n), 2 * n)
        spans += [(page, min(a, b), max(a, b)) for a, b in zip(places[::2], places[1::2], strict=True)]
        free = [p for p in range(10 * n) if p not in set(places)]
        points += [(page, at, at + draw.choice((0, 0, 50))) for at in draw.sample(free, n)]
    return spans, points


@pytest.mark.parametrize("seed", range(3))
def test_innermost_of_crossing_intervals(spark, seed):
    spans, points = crossing(seed)
    want = sorted((p, at, max((a for q, a, b in spans if q == p and a < at and until < b), default=-1)) for p, at, until in points)
    got = I.innermost(spark.createDataFrame(spans, "page_id long, ord long, end long"), spark.createDataFrame(points, "page_id long, at long, until long"))
    assert sorted((r.page_id, r.at, -1 if r.ord is None else r.ord) for r in got.collect()) == want


def test_inner_text_against_pairs(spark):
    draw = random.Random(5)
    rows = []
    for page in ("a", "b", "c"):
        spans, _ = crossing(draw.random(), 1, 30)
        rows += [(page, a, b, "open", draw.choice(("div", "p")), None) for _, a, b in spans] + [(page, a + 1000, a + 1000, "void", "div", None) for _, a, _ in spans[:2]]
        taken = {x for _, a, b in spans for x in (a, b)}
        rows += [(page, at, at, "text", None, draw.choice(("x", "é日", "", None))) for at in range(300) if at not in taken]
    frame = spark.createDataFrame(rows, "page_id string, ord long, end long, kind string, tag string, text string")
    want = sorted((p, a, b, t, "".join(x or "" for q, at, _, k, _, x in rows if k == "text" and q == p and a < at < b)) for p, a, b, kind, t, _ in rows if kind != "text" and t == "div")
    assert sorted(tuple(r) for r in I.inner_text(frame, frame["tag"] == "div").collect()) == want
    assert I.inner_text(frame.limit(0), frame["tag"] == "div").collect() == []


def test_deep_pages_take_linear_work(spark):
    """100,000 elements inside each other, times in the innermost; pairs of them would be 10^10."""
    n = 100_000
    spans = spark.range(n).selectExpr("1L as page_id", "id as ord", f"{3 * n}L - id as end")
    points = spark.range(n).selectExpr("1L as page_id", f"{n}L + id as at", f"{n}L + id as until")
    began = time.time()
    assert {(r.ord, r["count"]) for r in I.innermost(spans, points).groupBy("ord").count().collect()} == {(n - 1, n)}
    assert time.time() - began < 120


def test_no_join_by_interval_is_left(spark):
    page = nodes(spark.createDataFrame([(1, "<main><div><a href='/u/'>u</a><time datetime='1'>x</time></div><time datetime='2'>y</time><time datetime='3'>z</time><button>Load more comments</button></main>")], "page_id long, html string"))
    for frame in (P.blocks(page), P.containers(page), P.load_more(page)):
        joins = [x for x in frame._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x]
        assert not any(re.search(r"\b(ord|at|time_ord)#\d+L? *[<>]", x) for x in joins), joins
    assert [r.load_more for r in P.load_more(page).collect()] == ["button"]
    assert [(r.block.tag, r.container.tag) for r in P.containers(page).collect()] == [("div", "main")]


def plain_throttle(rows, width):
    out = []
    for run in {r[0] for r in rows}:
        armed, last = None, None
        for _, ms, _, n in sorted((r for r in rows if r[0] == run and r[1] is not None and r[3] is not None), key=lambda r: (r[1], r[2])):
            if armed is not None and ms >= armed + width:
                out.append((run, armed + width, last))
                armed = None
            armed, last = ms if armed is None else armed, n
        if armed is not None:
            out.append((run, armed + width, last))
    return sorted(out, key=str)


@pytest.mark.parametrize("batch", [3, 10_000])
def test_throttle_is_armed_by_the_first_change(spark, batch):
    draw = random.Random(batch)
    rows = [(draw.choice(("a", "b", "c", None)), draw.randrange(20_000), i, draw.randrange(1000)) for i in range(400)] + [("d", None, 0, 1), ("e", 5, 0, None), ("f", 7, 0, 9), ("g", 0, 0, 1), ("g", 500, 1, 2), ("g", 999, 2, 3)]
    frame = spark.createDataFrame([(r, None if ms is None else dt.datetime.fromtimestamp(ms / 1000, dt.timezone.utc), s, n) for r, ms, s, n in rows], "run_id string, ts timestamp, seq long, n long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = sorted((tuple(r) for r in S.throttle_progress(frame).collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == plain_throttle(rows, 500) and ("g", 500, 1) in got and ("g", 1000, 3) in got


def test_markup_of_elements(spark):
    html = '<body><div id="d"><p>a &amp; b<br>c</p><span>d</span></div><p>e</p></body>'
    pages = spark.createDataFrame([(1, html), (2, "<p>" + "x" * 5000 + "</p>"), (3, None)], "page_id long, html string")
    rows = nodes(pages)
    what = F.when(F.col("tag") == "br", "br").otherwise("other")
    wanted = rows.filter("kind in ('open', 'void')").select("page_id", what.alias("what"), F.col("ord").alias("place"), "ord", "end", F.lit(20).alias("most"))
    got = {(r.page_id, r.place): r.markup for r in I.outer_markup(rows, wanted.unionAll(wanted)).collect()}
    assert I.outer_markup(rows, wanted.unionAll(wanted)).count() == 2 * wanted.count() == 2 * len(got)
    assert sorted(got.values()) == sorted([html[:20], '<div id="d"><p>a &am', "<p>a &amp; b<br>c</p", "<br>", "<span>d</span>", "<p>e</p>", "<p>" + "x" * 17])
    assert I.outer_markup(rows, wanted.limit(0)).count() == 0


def test_markup_samples_of_a_page(spark):
    post = '<div class="c"><a href="/u/">u</a><time datetime="x">1d</time><button aria-label="Like it">o</button><button>View 2 replies</button></div>'
    html = f'<main><div id="list">{post * 4}</div></main>'
    rows = nodes(spark.createDataFrame([(1, html, "z"), (2, "<p>nothing</p>", "z")], "page_id long, html string, what string"))
    got = {(r.page_id, r.what, r.place): r.markup for r in P.markup_samples(rows).collect()}
    want = {(1, "block", 0): post, (1, "container", 0): f'<div id="list">{post * 4}</div>'[:1000], (1, "load_more", 0): "<button>View 2 replies</button>"}
    want |= {(1, "link", i): '<a href="/u/">u</a>' for i in range(3)} | {(1, "like", i): '<button aria-label="Like it">o</button>' for i in range(4)} | {(1, "reply", i): "<button>View 2 replies</button>" for i in range(3)}
    assert got == want


def test_pages_are_dealt_anew_over_parts_that_lie_by_page(spark):
    """Parts that lie by page_id may be coalesced or joined in other ways at run time, so the fold's own shuffle has to stay."""
    rows = spark.range(50).select((F.col("id") % 5).alias("page_id"), F.col("id").alias("ord"), (F.col("id") + 40).alias("end"))
    spans = rows.groupBy("page_id", "ord").agg(F.max("end").alias("end")).groupBy("page_id").agg(F.collect_list(F.struct("ord", "end")).alias("x")).select("page_id", F.inline("x"))
    points = rows.groupBy("page_id").agg(F.max("ord").alias("at")).withColumn("until", F.col("at"))
    found = I.innermost(spans, points)
    assert "REPARTITION_BY_COL" in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.page_id, r.at, r.ord) for r in found.collect()) == [(p, 45 + p, 40 + p) for p in range(5)]
