import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from threadline.llm import sentencepiece_wfst as W
from threadline.llm.queries import tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    return W.load_transducer(PATH), W.reference_processor(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aethinosr  .,²'▁\n0129ABé日"), st.characters(codec="utf-8", exclude_categories=["Cs", "Cc"]))))
def test_same_as_library(both, text):
    transducer, library = both
    ids = transducer.encode(text)
    assert ids == library.encode(text)
    assert transducer.decode(ids) == text.replace(W.MARK, " ")


def plain_paths(t, part):
    """Every sequence of labels over a part that the pieces and byte fallback allow, with its weight:
    1 for a piece, the bytes of a bare character, infinity for neighbours that encode otherwise."""
    out = []

    def go(at, path, weight):
        if at == len(part):
            out.append((weight, [t.ids[p] for p in path] if all(p in t.ids for p in path) else path))
        for end in range(at + 1, len(part) + 1):
            piece = part[at:end]
            bare = end == at + 1 and piece not in t.ids
            if piece in t.ids or bare:
                both = [*path[-1:], piece]
                stable = t.merged("".join(both)) == both
                go(end, [*path, piece], weight + (len(piece.encode()) if bare else 1) + (0 if stable else float("inf")))

    go(0, [], 0.0)
    return sorted(out)


@pytest.mark.parametrize("part", ["▁thing", "▁aaaaaaa", "▁▁▁▁▁", "▁tionen", "érent", "▁internal", "eeeee", "a\U0001f600b", "\x07\x07", "▁q\u0378z"])
def test_shortest_path_of_the_composition(both, part):
    paths = plain_paths(both[0], part)
    weight, ends, labels = both[0].shortest_paths([part])
    assert [w for w, _ in paths].count(float("inf")) == len(paths) - 1  # one path alone is finite
    assert weight.tolist() == [paths[0][0]] and ends.tolist() == [len(labels)]
    top = len(both[0].names)
    if labels.max() < top:
        assert labels.tolist() == paths[0][1]
    else:
        assert [both[0].names[x] if x < top else chr(x - top) for x in labels.tolist()] == paths[0][1]


def test_parts_side_by_side(both, monkeypatch):
    parts = ["▁thing", "a\U0001f600b", "x" * 700, "e", "▁" * 40, "inter" * 30]
    alone = [both[0].encode_parts([p])[0] for p in parts]
    monkeypatch.setattr(W, "_CELLS", 1000)
    assert both[0].encode_parts(parts) == alone


def test_long_run_without_cuts(both):
    text = "abcdefghij" * 3_000
    assert both[0].encode(text) == both[1].encode(text)


def test_documents(spark, sf_dir, both):
    transducer, library = both
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    encoded = W.encode_docs(docs, transducer)
    assert all(r.pieces == library.encode(texts[r.doc_id]) for r in encoded.collect())
    assert {r.doc_id: r.text for r in W.decode_docs(encoded, transducer).collect()} == texts
    assert W.round_trip(docs, transducer).filter("not exact").count() == 0


def test_awkward_rows(spark, awkward, nothing, both):
    rows = {r.doc_id: r for r in W.round_trip(awkward, both[0]).collect()}
    assert rows[3].n_pieces == rows[4].n_pieces == 0 and all(r.exact for r in rows.values())
    assert W.encode_checked(awkward, both[0]).count() == awkward.count()
    assert W.round_trip(nothing, both[0]).count() == W.encode_checked(nothing, both[0]).count() == 0


def test_bounded_memory():
    small = W.Transducer(open(PATH, "rb").read(), max_bytes=600)
    want = W.load_transducer(PATH)
    for text in ("one two three four", "five six seven eight nine", "one two ten"):
        assert small.encode(text) == want.encode(text)


@pytest.mark.parametrize("text", ["a" * 3001, "-" * 5001, " " * 5003 + "x", "ha" * 1501, "\U0001f600" * 900, "".join(chr(0x4E00 + i * 7919 % 20000) for i in range(6000)), "xqzkj" * 700, "日本語のテキスト。" * 300])
def test_long_runs_of_any_kind(both, text):
    assert both[0].encode(text) == both[1].encode(text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aethinosr▁é-日\U0001f600", min_size=30, max_size=400))
def test_windows_join_to_the_one_path(both, text):
    step = W._STEP
    try:
        W._STEP = 8
        ids = np.frombuffer(b"".join(both[0].encode_parts([text])), "<i4").tolist()
    finally:
        W._STEP = step
    assert ids == np.frombuffer(both[0].encode_parts([text])[0], "<i4").tolist()


def test_parts_are_cut_where_no_piece_reaches_across(both):
    part = "日本é-a▁" * 5
    (cut,) = both[0]._cut([part])
    assert "".join(cut) == part
    inside = {p[i : i + 2] for p in both[0].ids for i in range(len(p) - 1)}
    assert all(a[-1] + b[0] not in inside for a, b in zip(cut, cut[1:]))
