"""Golden rows of the column functions."""

import pytest
from pyspark.sql import functions as F

from threadline.functions import text as X
from threadline.functions import urls as U


def applied(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in rows.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


COUNTS = {
    None: 0, "": 0, "  ": 0, "No": 0, "7": 7, "1,234": 1234, "1.2K": 1200, "1.2k": 1200, " 1.2 K ": 1200, "4.5M": 4_500_000, "2B": 2_000_000_000, "0.5": 1, "2.5": 3,
    "1,2K": 12_000, "12 more": 12_000_000, "5 best": 5_000_000_000, "1.2.3K": 1200, ".": None, ".5K": 500, "1.": 1, "Like": 0, "-5": 0,
}


def test_compact_count(spark):
    assert applied(spark, list(COUNTS), X.compact_count) == list(COUNTS.values())


def test_first_int(spark):
    cases = {"View 3 replies": 3, "1 reply": 1, "View 1,234 replies": 1234, "1.2K replies": 1, "Replies": 0, "": 0, None: 0, "9" * 30: None}
    assert applied(spark, list(cases), X.first_int) == list(cases.values())


def test_white_space(spark):
    assert applied(spark, ["\xa0 a  \tb﻿", "", None], X.normalize_ws) == ["a b", "", None]
    assert applied(spark, ["\x0b a  b　"], X.js_trim) == ["a  b"]


def test_file_names(spark):
    cases = {"a/b:c": "abc", "My  Video - Title": "My-Video-Title", " x ": "-x-", "a\tb": "ab", "???": "youtube-comments", "a" * 150: "a" * 100, None: "youtube-comments"}
    assert applied(spark, list(cases), X.sanitize_filename) == list(cases.values())
    assert applied(spark, ["", "A b"], lambda c: X.export_name(c, "txt")) == ["youtube-comments-comments.txt", "A-b-comments.txt"]


def test_percent_and_labels(spark):
    rows = spark.createDataFrame([(0, 0, 0), (1, 50, 500), (2, 501, 500), (3, 1, 200)], "i int, a long, b long")
    assert [r.p for r in rows.select("i", X.percent(F.col("a"), F.col("b")).alias("p")).orderBy("i").collect()] == [0, 10, 100, 1]
    assert applied(spark, [None, 0.0, 59.2, 60.0, 61.0], X.eta_label, "double") == ["", "", "~60s left", "~1m left", "~2m left"]
    assert applied(spark, [0, 1, 1234], X.result_text, "long") == ["Collected 0 comments successfully.", "Collected 1 comment successfully.", "Collected 1,234 comments successfully."]
    assert applied(spark, [1], X.complete_text, "long") == ["Export complete — 1 comments"]


@pytest.mark.parametrize(
    ("href", "want"),
    [("/alice", True), ("/alice/", True), ("alice", True), ("/alice?hl=en", True), ("/explore/", True), ("https://other.com/x", True), ("/p/XYZ/", False), ("#", False), ("", False), ("mailto:a", False), ("javascript:void(0)", False), ("http://[", False), (None, False)],
)
def test_profile_links(spark, href, want):
    assert applied(spark, [href], U.is_profile) == [want]


def test_comment_id_in_links(spark):
    links = ["/watch?v=x&lc=UgA&t=1", "/watch?v=x&lc=UgA#f", "/watch?v=x", "/watch?xlc=1", None]
    assert applied(spark, links, U.lc_param) == ["UgA", "UgA", None, None, None]
    assert applied(spark, links, lambda c: U.lc_param(c, compat=True)) == ["UgA", "UgA#f", None, "1", None]


def test_page_families(spark):
    urls = ["https://www.youtube.com/watch?v=1", "http://m.youtube.com/watch?v=1", "https://www.instagram.com/reel/1", "x/instagram.com/p/1", "https://example.com/", None]
    assert applied(spark, urls, U.page_family) == ["watch", None, "post", None, None, None]
    assert applied(spark, urls, lambda c: U.page_family(c, strict=False)) == ["watch", "watch", "post", "post", None, None]


def test_long_runs_of_white_space(spark):
    import time

    from pyspark.sql import functions as F
    from threadline.functions import text as X

    rows = spark.createDataFrame([("a" + " \t" * 500_000 + "b",)], "x string")
    began = time.monotonic()
    assert tuple(rows.select(F.length(X.js_trim(F.col("x"))), X.normalize_ws(F.col("x"))).first()) == (1_000_002, "a b")
    assert time.monotonic() - began < 30
