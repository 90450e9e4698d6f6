import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadline.llm import decontaminate as D


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=80), st.lists(st.integers(1, 5), min_size=1, max_size=4))
def test_fm_index(seq, phrase):
    index = D.FmIndex(np.array(seq), 6, sample=3)
    sp, ep = index.search(np.array([phrase]))
    want = [i for i in range(len(seq)) if seq[i : i + len(phrase)] == phrase]
    assert sorted(index.locate(np.arange(sp[0], ep[0])).tolist()) == want


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=60))
def test_suffix_array(seq):
    t = np.array([*seq, 0])
    assert D.suffix_array(t).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


def plain(text, items, window=10):
    """Words, flags of hit words, items with a hit."""
    words = D.words_of(text.encode() if text else None)
    hit, found = [False] * len(words), set()
    for item, content in items:
        own = D.words_of(content.encode())
        n = min(window, len(own))
        for i in range(len(own) - n + 1 if own else 0):
            for j in range(len(words) - n + 1):
                if words[j : j + n] == own[i : i + n]:
                    hit[j : j + n] = [True] * n
                    found.add(item)
    return len(words), sum(hit), sorted(found)


def awkward_benchmark(spark):
    rows = [(1, "quick BROWN fox, jumps over the lazy dog while twelve pale moons rise"), (2, "Tëxt line"), (3, None), (None, "no id"), (4, ""), (5, "!!"), (2, "Tëxt line"), (10, "lorem ipsum dolor sit amet lorem ipsum dolor sit amet lorem")]
    return spark.createDataFrame(rows, "item_id long, text string").withColumn("doc_id", F.lit(1))


def test_awkward_rows(spark, awkward, nothing):
    benchmark = awkward_benchmark(spark)
    items = [(str(r.item_id), r.text) for r in benchmark.collect() if r.item_id is not None and r.text is not None]
    texts = {r.doc_id: r.text for r in awkward.select("doc_id", "text").collect() if r.doc_id != 5}
    for block_bytes in (32 << 20, 60):
        rows = D.contamination(awkward, benchmark, block_bytes=block_bytes, shard_words=30).collect()
        assert len(rows) == awkward.count()
        for r in rows:
            got = (r.n_words, sum(s.end - s.start for s in r.spans), r["items"])
            assert got == (plain(texts[r.doc_id], items) if r.doc_id != 5 else (100_000, 100_000, ["10"]))
    assert D.contamination(nothing, benchmark).count() == 0
    assert D.contamination(awkward, benchmark.filter(F.lit(False))).filter(F.size("spans") > 0).count() == 0


def test_clean_rows_stay(spark, awkward, nothing):
    for block_bytes in (32 << 20, 60):
        kept = D.drop_contaminated(awkward, awkward_benchmark(spark), block_bytes=block_bytes)
        assert kept.columns == awkward.columns
        assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 3, 4, 6, 8]
    assert D.drop_contaminated(nothing, awkward_benchmark(spark)).count() == 0


def test_cut_spans():
    assert D.cut_spans("A b, c! D é f.", [(1, 3), (4, 5)]) == "A ! D  f."
