import gzip
import hashlib
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from threadline.llm import warc as A
from threadline.llm.common import table


def plain(rows):
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) by a dict of payloads."""
    texts = [(i, (h or "").encode()) for i, _, h in rows]
    first = {}
    for i, p in texts:
        if i is not None:
            first[p] = min(i, first.get(p, i))
    again = lambda i, p: len(p) >= 100 and p in first and first[p] != i
    return sorted(((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again(i, p) else "response", first[p] if again(i, p) else None) for i, p in texts), key=str)


@pytest.fixture(scope="module")
def odd(spark):
    long, text = "lang 日本 é " * 50_000, "x" * 100
    rows = [
        (5, "http://a/é?%20 b\r\nX: y", text), (3, "http://b/", text), (9, None, text), (9, None, text), (3, "http://b/", text), (None, "u", text), (None, "u", None), (7, "", None), (8, "e", ""), (6, "s", "x" * 99), (4, "s", "x" * 99),
        (11, "l", long), (10, "l", long), (12, "crlf", "a\r\n\r\nWARC/1.1\r\n" * 20), (None, "n", "z" * 200), (None, "n", "z" * 200),
    ]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("salt", "size", "first", "payload", "path", "run", "at")})


def shown(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_round_trip_of_odd_pages(spark, odd):
    rows, pages = odd
    found = A.round_trip(spark, pages, payloads=True)
    assert shown(found) == plain(rows)
    texts = {(i, h or "", u) for i, u, h in rows}
    got = [(r.page_id, r.payload.decode(), r.url) for r in found.filter("record_type = 'response'").collect()]
    assert set(got) <= texts and len(got) == sum(x[3] == "response" for x in plain(rows))


def test_query_against_plain(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    copies = pages.union(pages.filter("page_id % 3 = 0").withColumn("page_id", F.col("page_id") + 100_000))
    assert shown(A.round_trip(spark, copies)) == plain([tuple(r) for r in copies.select("page_id", "url", "html").collect()])


def test_nothing_and_text_ids(spark, odd):
    assert A.round_trip(spark, odd[1].limit(0)).collect() == []
    named = A.round_trip(spark, spark.createDataFrame([("b x", None, "y" * 200), ("a%20", None, "y" * 200)], "page_id string, url string, html string"))
    assert [(r.page_id, r.refers_to) for r in named.orderBy("page_id").collect()] == [("a%20", None), ("b x", "a%20")]


def test_packages_roll_over_and_are_zip_files(spark, odd, tmp_path):
    rows, pages = odd
    packages = A.write_packages(pages.coalesce(1), f"file://{tmp_path}", most=2_000).collect()
    assert len(packages) > 1 and sum(p.records for p in packages) == len(rows)
    for p in packages:
        with zipfile.ZipFile(p.path.removeprefix("file://")) as z:
            assert z.testzip() is None and z.namelist() == [A.ARCHIVE, A.INDEX]
            assert gzip.decompress(z.read(A.ARCHIVE)).count(b"WARC-Record-ID: ") == p.records


def test_directories(tmp_path):
    data = io.BytesIO(b"")
    with zipfile.ZipFile(data, "w") as z:
        z.writestr(zipfile.ZipInfo("a.txt"), b"first")
        z.writestr(zipfile.ZipInfo("ü/b.txt"), b"second" * 9, zipfile.ZIP_DEFLATED)
        z.comment = b"a comment with PK\x05\x06 in it"
    for before in (b"", b"#!/bin/sh\n"):
        raw = before + data.getvalue()
        file = io.BytesIO(raw)
        found = A.members(file, len(raw))
        assert [(m.name, m.method, m.full_size) for m in found] == [("a.txt", 0, 5), ("ü/b.txt", 8, 54)]
        assert [A.unpacked(file, m) for m in found] == [b"first", b"second" * 9]
    for bad in (b"", b"no zip file", data.getvalue()[:-40], data.getvalue()[30:]):
        with pytest.raises(ValueError):
            A.members(io.BytesIO(bad), len(bad))


@pytest.mark.parametrize("before", [b"", b"some bytes"])
def test_zip64_directories(before, monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 2)
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name in ("one", "two", "three", "four"):
            z.writestr(zipfile.ZipInfo(name), name.encode() * 7)
    raw = before + data.getvalue()
    assert A.END64 in raw and A.LOCATOR64 in raw
    file = io.BytesIO(raw)
    assert [(m.name, A.unpacked(file, m)) for m in A.members(file, len(raw))] == [(n, n.encode() * 7) for n in ("one", "two", "three", "four")]


def test_wide_fields_beyond_32_bits():
    extra = b"\x55\x54\x01\x00z" + b"\x01\x00\x10\x00" + (1 << 40).to_bytes(8, "little") + (1 << 41).to_bytes(8, "little")
    assert A._wide(extra, [7, 0xFFFFFFFF, 0xFFFFFFFF, 0], [0xFFFFFFFF] * 3 + [0xFFFF]) == [7, 1 << 40, 1 << 41, 0]


def test_changed_payload_is_found():
    data = A.record("1", "u", b"abc" * 50, hashlib.sha256(b"abc" * 50).hexdigest(), None)
    assert A._batch([data], True).num_rows == 1
    with pytest.raises(ValueError):
        A._batch([data.replace(b"abcabc", b"abcabd")], True)
    with pytest.raises(ValueError):
        A.parsed(data[:-30])
