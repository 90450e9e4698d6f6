import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from threadline.llm import token_output as T
from threadline.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def tokenizer_json():
    with open(tokenizer_path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 6), min_size=1, max_size=40), min_size=1, max_size=12))
def test_grammar_round_trip(docs):
    row = T.make_shard(0, 0, 0, list(range(len(docs))), np.concatenate(docs).astype("<u4"), np.array([len(d) for d in docs]), base=7)
    assert [d.tolist() for d in T.decode_shard(row)] == docs
    assert [T.decode_document(row, k).tolist() for k in range(len(docs))] == docs
    lengths = np.frombuffer(row["lengths"], "<u4")
    left, right = T._numbers(row["left"]), T._numbers(row["right"])
    assert [len(T.expand(np.array([7 + k]), 7, left, right)) for k in range(len(lengths))] == lengths.tolist()


def test_grammar_compresses():
    ids = np.tile(np.arange(50), 200)
    ends = np.zeros(len(ids), bool)
    ends[-1] = True
    assert max(len(T.repair(ids, ends, base)[3]) for base in (100, 1 << 20)) < len(ids) / 8


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=200), min_size=1, max_size=6), st.sampled_from([1, 2, 4096]))
def test_no_frequent_pair_is_left(docs, per_round):
    ends = np.zeros(sum(map(len, docs)), bool)
    ends[np.cumsum([len(d) for d in docs]) - 1] = True
    for base in (4, 1 << 20):
        left, right, lengths, symbols = T.repair(np.concatenate(docs), ends, base, per_round=per_round)
        stop = np.isin(np.cumsum(np.where(symbols < base, 1, lengths[np.maximum(symbols - base, 0)] if len(lengths) else 1)) - 1, np.flatnonzero(ends))
        found = Counter((a, b) for a, b, s in zip(symbols[:-1].tolist(), symbols[1:].tolist(), stop[:-1].tolist(), strict=True) if not s)
        assert max(found.values(), default=0) < 6
        assert T.expand(symbols, base, left, right).tolist() == np.concatenate(docs).tolist()


def test_long_copies_become_one_symbol_each():
    copy = np.random.default_rng(1).integers(0, 50_000, 1000)
    ids, ends = np.tile(copy, 64), np.tile(np.arange(1000) == 999, 64)
    left, right, lengths, symbols = T.repair(ids, ends, 50_000, per_round=100)
    assert len(symbols) <= 64 * 8 and lengths.max() > 64


UNITS = ["", " ", "  ", "a  b", "a b ", "\n \n a", "foo\n bar", "foo\n  bar", " lead", "x\u00a0y", "a\u2003 b", "a<|endoftext|> b <|endoftext|> c", "tab\t x", "I'm  we've 's 'll", "é 😀 ﷽ x", "a\u3000 b", " a\n", "a\n \nb", "a\r\nb \r\n c", "\x85 a \x1c b", "x.\ny,\n\nz!!\t\tq 9%. $5.00, ². a². …. é…. 'tis.' (x).) a*b**. a\r\nb.\r\n c", "a.\n\tb a.\n\t\tb", "a\nb\nc\nd.\n", "nul\x00 in. it", "dog's. ×. é. <|endoftext|>. ."]


def test_looked_up_units_are_exact(tokenizer_json):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_str(tokenizer_json)
    encoder = T.CachedEncoder(tokenizer_json, max_bytes=6000)
    for _ in range(2):
        ids, sizes = encoder.encode(pa.array([*UNITS, None]), T._u4(np.array([2])))
        for text, got in zip([*UNITS, ""], np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
            assert got.tolist() == [*plain.encode(text, add_special_tokens=False).ids, 2], repr(text)


def plain_index(docs, tokenizer_json):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_str(tokenizer_json)
    out, start = [], 0
    for r in sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, np.uint64(xxhash.xxh64_intdigest(r.text or "", 42)).astype(np.int64))):
        ids = [*plain.encode(r.text or "", add_special_tokens=False).ids, 2]
        out.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_index(spark, sf_dir, awkward, nothing, tokenizer_json, tmp_path):
    for docs in (awkward, spark.read.parquet(f"{sf_dir}/documents.parquet")):
        got = T.token_index(T.shared_shards(docs, tokenizer_json, shard_tokens=5_000)).collect()
        assert sorted(map(tuple, got), key=lambda r: r[1]) == plain_index(docs, tokenizer_json)
    many = spark.createDataFrame([(None if i % 3 else 7, f"text {i}") for i in range(300)], "doc_id long, text string")
    got = T.token_index(T.shared_shards(many, tokenizer_json, shard_tokens=50)).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == plain_index(many, tokenizer_json)
    assert T.token_index(T.shared_shards(nothing, tokenizer_json)).count() == 0
    written = T.write_tokens(awkward, str(tmp_path / "ids"), tokenizer_json, end_id=None)
    assert written.count() >= 1


def test_many_distinct_units(tokenizer_json):
    """Units that are all new, in many rows of them, give the library's ids."""
    encoder = T.CachedEncoder(tokenizer_json)
    texts = pa.array([" ".join(f"w{i}x{k}é" for k in range(50)) for i in range(400)])
    for _ in range(2):
        values, _ = encoder.encode(texts)
        assert values.tolist() == [i for e in encoder.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False) for i in e.ids]


def test_overlapping_places_are_taken_every_other():
    """Runs of one id of even and odd lengths, beside places that don't overlap."""
    docs = [[5] * n for n in (2, 3, 7, 8, 64, 65)] + [[1, 2, 3]] * 12 + [[5, 5, 1, 2, 5, 5, 5]] * 7
    ids = np.concatenate(docs)
    ends = np.zeros(len(ids), bool)
    ends[np.cumsum([len(d) for d in docs]) - 1] = True
    for per_round in (1, 4096):
        left, right, lengths, symbols = T.repair(ids, ends, 6, per_round=per_round)
        assert T.expand(symbols, 6, left, right).tolist() == ids.tolist()
        assert len(symbols) < len(ids) / 2


def test_units_stay_known(tokenizer_json, monkeypatch):
    """A table of so many bytes keeps all of 8,000 units: a second pass hands none of them to the library."""
    encoder = T.CachedEncoder(tokenizer_json, max_bytes=1_600_000)
    batches = [pa.array([" ".join(f"w{i}" for i in range(k, k + 1000))]) for k in range(0, 8000, 1000)]
    first = [encoder.encode(b)[0].tolist() for b in batches]
    asked, whole = [], T.CachedEncoder._whole
    monkeypatch.setattr(T.CachedEncoder, "_whole", lambda self, texts: (asked.extend("".join(texts).split()), whole(self, texts))[1])
    assert [encoder.encode(b)[0].tolist() for b in batches] == first
    assert len(asked) <= len(batches)


def test_keys_tell_units_apart():
    """Short units have one key each, also those that end in NUL or lie in a sliced array."""
    units = pa.array(["", "a", "a\x00", "\x00a", "é" * 11, "b" * 23, "b" * 22, "b" * 24, "c" * 1000, "c"])
    for at in (0, 1, 3):
        key, short = T.unit_keys(units[at:])
        assert short.tolist() == [len(u.encode()) < 24 for u in units[at:].to_pylist()]
        assert len({tuple(k) for k in key[short].tolist()}) == short.sum()
    assert (T.unit_keys(units[1:])[0][-1] == T.unit_keys(pa.array(["c"]))[0][0]).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 60), max_size=40), max_size=12), st.sampled_from([1, 72 * 2 * 20, 1 << 20]))
def test_recent_ids_are_those_made(batches, max_bytes):
    """What is found is what was made for the key, whatever has been dropped, moved or met on the way."""
    table = T.RecentIds(max_bytes)
    for batch in map(sorted, batches):
        made = [np.arange(k % 5, dtype=np.uint32) + k for k in batch]
        key, _ = T.unit_keys(pa.array([str(k) for k in batch], pa.string()))

        def make(at, made=made):
            some = [made[i] for i in at]
            return np.concatenate([np.zeros(0, np.uint32), *some]), np.array([len(a) for a in some], np.int32)

        ids, size = table.get(key, make)
        assert ids.tolist() == [i for a in made for i in a] and size.tolist() == [len(a) for a in made]


@settings(max_examples=200, deadline=None)
@given(texts=st.lists(st.one_of(st.none(), st.lists(st.sampled_from([" ", " ", "\n", *"ab9.,!?)(*'\"-", "é", "×", "ɏ", "ɐ", "\x85", "\xa0", " ", "　", "​", "中", "。", "😀", "\x00", "\t", "the"]), max_size=30).map("".join)), max_size=8))
def test_cuts_are_exact(tokenizer_json, texts):
    """Cuts at spaces, newlines and signs, next to characters of one to four bytes and ends of texts."""
    encoder = T.built_once(T.CachedEncoder, tokenizer_json, 20_000)
    for at in (0, 2):
        ids, sizes = encoder.encode(pa.array(texts, pa.string())[at:], T._u4(np.array([2])))
        want = [[*encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for t in texts[at:]]
        assert ids.tolist() == [i for w in want for i in w] and sizes.tolist() == [len(w) for w in want]
