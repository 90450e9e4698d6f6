"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of whole documents of one task, up to ``shard_words`` words. Its words
become symbols: one for each word of the test phrases, one shared separator for every other
word and for document ends. A stretch of phrase words shorter than the shortest phrase can't
hold one and is left out, and so is all but one separator between stretches; nothing else is.
Over the rest the task builds a suffix array, its Burrows-Wheeler transform in a wavelet
matrix, and sampled suffix positions. All phrases are searched backward at once; each step
is two wavelet ranks. Occurrences are located by walking to a sampled suffix, and their
spans are merged per document.

Documents are never shuffled. The phrases of one pass are broadcast, ``block_bytes`` of
benchmark text at most; a larger benchmark is searched in several passes by hash of item.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, utf8, written

#: Words of the contract, on bytes with A-Z lower-cased: digits, a-z and everything past ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: bytes | None) -> list[bytes]:
    return WORD.findall((text or b"").lower())


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Positions of the suffixes of t in order; the last symbol must be unique and smallest.
    Prefix doubling that sorts only the suffixes still tied."""
    n = len(t)
    sa = np.argsort(t, kind="stable")
    head = np.r_[True, t[sa][1:] != t[sa][:-1]]
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    step = 1
    while True:
        tied = np.flatnonzero(~(head & np.r_[head[1:], True]))
        if not len(tied):
            return sa
        at = sa[tied]
        key = rank[at] * (n + 1) + np.where(at + step < n, rank[np.minimum(at + step, n - 1)] + 1, 0)
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        sa[tied] = at
        head[tied] = np.r_[True, key[1:] != key[:-1]]
        rank[at] = np.maximum.accumulate(np.where(head[tied], tied, 0))
        step *= 2


class WaveletMatrix:
    """Ranks of symbols in prefixes of a sequence, a bit level at a time, for arrays of queries."""

    def __init__(self, seq: np.ndarray, n_symbols: int):
        self.levels = []
        for shift in reversed(range(max(1, int(n_symbols - 1).bit_length()))):
            bit = (seq >> shift) & 1
            ones = np.r_[0, np.cumsum(bit)].astype(np.int32)
            self.levels.append((shift, ones, len(seq) - int(ones[-1])))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each end."""
        low = np.zeros(len(end), np.int64)
        for shift, ones, zeros in self.levels:
            bit = ((symbol >> shift) & 1).astype(bool)
            low = np.where(bit, zeros + ones[low], low - ones[low])
            end = np.where(bit, zeros + ones[end], end - ones[end])
        return end - low

    def access_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it stands before it."""
        low, symbol = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for _, ones, zeros in self.levels:
            bit = (ones[at + 1] - ones[at]).astype(bool)
            low = np.where(bit, zeros + ones[low], low - ones[low])
            at = np.where(bit, zeros + ones[at], at - ones[at])
            symbol = symbol * 2 + bit
        return symbol, at - low


class FmIndex:
    """Backward search and location over symbols >= 1; symbol 0 is the end mark added here."""

    def __init__(self, seq: np.ndarray, n_symbols: int, sample: int = 8):
        t = np.r_[seq, 0].astype(np.int64)
        sa = suffix_array(t)
        self.below = np.r_[0, np.cumsum(np.bincount(t, minlength=n_symbols))]
        self.wavelet = WaveletMatrix(t[sa - 1], n_symbols)
        marked = sa % sample == 0
        self.marked, self.mark_rank, self.samples = marked, np.cumsum(marked) - 1, sa[marked]
        self.n = len(t)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of phrases (a row each, of one length)."""
        sp, ep = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for symbol in phrases.T[::-1]:
            c = symbol[live]
            sp[live] = self.below[c] + self.wavelet.rank(c, sp[live])
            ep[live] = self.below[c] + self.wavelet.rank(c, ep[live])
            live = live[sp[live] < ep[live]]
            if not len(live):
                break
        return sp, np.maximum(sp, ep)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows, by walking back to sampled ones."""
        rows, steps, live = rows.copy(), np.zeros(len(rows), np.int64), np.arange(len(rows))
        while len(live := live[~self.marked[rows[live]]]):
            symbol, rank = self.wavelet.access_rank(rows[live])
            rows[live] = self.below[symbol] + rank
            steps[live] += 1
        return self.samples[self.mark_rank[rows]] + steps


class Phrases:
    """The windows of a block of items, as symbols: 2 and up are words, 1 is any other."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.symbol: dict[bytes, int] = {}
        owners: dict[int, dict[tuple, set[str]]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            ids = [self.symbol.setdefault(w, len(self.symbol) + 2) for w in words_of(text)]
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1 if ids else 0):
                owners[size][tuple(ids[i : i + size])].add(item)
        self.by_size = {n: (np.array(list(w), np.int64), [sorted(x) for x in w.values()]) for n, w in owners.items()}
        self.shortest = min(self.by_size, default=0)


def shard_hits(symbols: list[list[int]], phrases: Phrases) -> tuple[np.ndarray, list[set[str]]]:
    """Of the documents of a shard: a flag for each word, with one more after each document,
    and the items that occur in each."""
    sizes = np.array([len(s) for s in symbols]) + 1
    flat = np.fromiter(chain.from_iterable(s + [1] for s in symbols), np.int64, sizes.sum())
    hit, items = np.zeros(len(flat), bool), [set() for _ in symbols]
    inside = np.r_[0, flat > 1, 0].astype(np.int8)
    start, end = np.flatnonzero(np.diff(inside) == 1), np.flatnonzero(np.diff(inside) == -1)
    fits = end - start >= phrases.shortest
    edges = np.zeros(len(flat) + 2, np.int32)
    np.add.at(edges, start[fits], 1)
    np.add.at(edges, end[fits] + 1, -1)  # with the separator that ends the stretch
    origin = np.flatnonzero(np.cumsum(edges)[: len(flat)] > 0)
    if not len(origin):
        return hit, items
    index = FmIndex(flat[origin], len(phrases.symbol) + 2)
    doc_end = np.cumsum(sizes)
    for size, (windows, owners) in phrases.by_size.items():
        sp, ep = index.search(windows)
        n = ep - sp
        if not n.sum():
            continue
        rows = np.repeat(sp, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = origin[index.locate(rows)]
        edges = np.zeros(len(flat) + 1, np.int32)
        np.add.at(edges, at, 1)
        np.add.at(edges, at + size, -1)
        hit |= np.cumsum(edges)[: len(flat)] > 0
        pairs = np.unique(np.stack([np.searchsorted(doc_end, at, "right"), np.repeat(np.arange(len(n)), n)], axis=1), axis=0)
        for doc, window in pairs.tolist():
            items[doc].update(owners[window])
    return hit, items


def _runs(flags: np.ndarray) -> list[dict]:
    edge = np.diff(np.r_[0, flags.astype(np.int8), 0])
    return [{"start": s, "end": e} for s, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)]


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, shard_words: int = 2_000_000, block_bytes: int = 2 << 20) -> DataFrame:
    """One row per row of docs: doc_id, n_words, items (ids as strings, sorted), spans (merged
    word ranges inside any phrase, end exclusive).

    A phrase is ``window`` consecutive words of an item, or all words of a shorter one. Null
    and empty texts have no words; items without id or words are skipped; items that repeat
    count once. Empty tables give no rows, or rows without hits; other columns are ignored."""
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.lit(0).cast("long").alias("n_words"), F.array().cast("array<string>").alias("items"), none.alias("spans"))
    n_blocks, blocks = phrase_blocks(benchmark, item_col, item_text_col, window, block_bytes)
    for k, phrases in enumerate(blocks):
        out = _pass(out, phrases, shard_words, keep_text=k < n_blocks - 1)
        if n_blocks > 1:
            out = written(out, "contamination")
    return out


def phrase_blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_bytes: int) -> tuple[int, Iterator[Phrases]]:
    """How many blocks the benchmark makes, and their phrases, one block at a time."""
    listed = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).dropna()
    size = listed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    own = lambda k: listed.filter(F.pmod(F.xxhash64("item"), F.lit(n)) == k).toLocalIterator()
    return n, (Phrases([(r.item, r.text.encode()) for r in own(k)], window) for k in range(n))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, shard_words: int = 2_000_000, block_bytes: int = 2 << 20) -> DataFrame:
    """The rows of docs, with all their columns, whose text holds no phrase of the benchmark; one
    narrow pass for each block of phrases."""
    n_blocks, blocks = phrase_blocks(benchmark, item_col, item_text_col, window, block_bytes)
    for phrases in blocks:
        docs = docs.mapInArrow(_clean_rows(docs.sparkSession.sparkContext.broadcast(phrases), text_col, shard_words), docs.schema)
        if n_blocks > 1:
            docs = written(docs, "decontaminated")
    return docs


def _clean_rows(shared, text_col: str, shard_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = shared.value
        for batch in batches:
            keep: list[bool] = []
            for shard in shards(utf8(batch.column(batch.schema.get_field_index(text_col))), phrases, shard_words):
                keep += [not items for items in shard_hits(shard, phrases)[1]]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def shards(texts: list[bytes | None], phrases: Phrases, shard_words: int) -> Iterator[list[list[int]]]:
    """The texts as symbols, in runs of whole documents of about shard_words words."""
    get, shard, held = phrases.symbol.get, [], 0
    for text in texts:
        shard.append([get(w, 1) for w in words_of(text)])
        held += len(shard[-1])
        if held >= shard_words:
            yield shard
            shard, held = [], 0
    if shard:
        yield shard


def _pass(docs: DataFrame, phrases: Phrases, shard_words: int, keep_text: bool) -> DataFrame:
    """The hits of one block of phrases, merged with those found before."""
    shared = docs.sparkSession.sparkContext.broadcast(phrases)
    fields = [("doc_id", pa.int64()), *[("text", pa.string())] * keep_text, ("n_words", pa.int64()), ("items", pa.list_(pa.string())), ("spans", _SPANS)]

    def make(batch: pa.RecordBatch) -> dict:
        phrases = shared.value
        old_items, old_spans = batch.column("items").to_pylist(), batch.column("spans").to_pylist()
        out: dict = {"doc_id": batch.column("doc_id"), "text": batch.column("text"), "n_words": [], "items": [], "spans": []}
        for shard in shards(utf8(batch.column("text")), phrases, shard_words):
            first = len(out["items"])
            hit, items = shard_hits(shard, phrases)
            base = np.cumsum([0, *(len(s) + 1 for s in shard)])
            out["n_words"] += [len(s) for s in shard]
            out["items"] += [sorted(found.union(old_items[first + i])) for i, found in enumerate(items)]
            for i in range(len(shard)):
                flags = hit[base[i] : base[i + 1] - 1]
                if items[i] and old_spans[first + i]:
                    flags = flags.copy()
                    for span in old_spans[first + i]:
                        flags[span["start"] : span["end"]] = True
                out["spans"].append(_runs(flags) if items[i] else old_spans[first + i])
        return out

    return docs.mapInArrow(by_batch(make, pa.schema(fields), 64 << 20), ", ".join(f"{n} {t}" for n, t in (("doc_id", "long"), *[("text", "string")] * keep_text, ("n_words", "long"), ("items", "array<string>"), ("spans", "array<struct<start:bigint,end:bigint>>"))))


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of the spans and what stands between those of one span."""
    at = [m.span() for m in WORD.finditer(text.encode().lower())]
    raw = text.encode()
    out, last = [], 0
    for start, end in spans:
        out.append(raw[last : at[start][0]])
        last = at[end - 1][1]
    return b"".join([*out, raw[last:]]).decode()
