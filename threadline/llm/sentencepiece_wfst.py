"""SentencePiece encoding and decoding by weighted finite-state transducer.

Three machines are compiled from the model into one table of arcs:

- the normaliser, whose arcs give characters the columns of the table: a space goes where the
  space mark goes, any other character where it goes itself, or where those of no piece go, by the
  length of their bytes; the first arc reads nothing and gives a space mark;
- the pieces: the states are the beginnings of pieces, an arc reads a column, and where a
  piece ends its id is given and the way leads back, with weight 1;
- byte fallback: arcs from the first state for any character that is no piece; its bytes are given,
  with their number as weight.

A BPE model accepts a sequence of pieces exactly when any two neighbours are stable: encoding
their joint text gives those two again. So an acceptor of pairs is intersected with the
output: its weight is 0 between stable neighbours, else infinity. Composed with an input (arc
by arc, as far as places are reached) this gives a lattice of states (place, last piece), and
its shortest path in the tropical semiring (min, +) is the encoding that the model defines. At
any place one state at most has a finite weight, the last piece of the encoding of what stands
before it, so a lattice keeps one weight for each place. The lattices of many inputs are built
and relaxed side by side, a place and a length of arc at a time.

Texts are cut where no piece can reach across: before space marks, and between signs and
other characters, as far as these stand together in no piece. Parts that come again are looked up,
also in later tasks of the same Python worker, in a table of ``max_bytes``; others are cut once more,
between any two characters that no piece has side by side. Shortest paths over the parts join to
the one over the whole. Where no cut comes for long, windows that overlap are relaxed side by side, and
the path passes from one to the next at a piece that both have: then all neighbours are stable, so
it is the one path. Encoding is one narrow pass; the model's file travels with the tasks.

Rows: null and empty texts give no ids; repeated rows each give a row; an empty table gives
no rows; other columns, also with names used here, are ignored. A very long text takes memory and
time in proportion to its length, also without any cut (windows that share no piece are made longer,
at worst up to the part).
"""

from __future__ import annotations

import re
import string
import zlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from .common import Recent, built_once, by_batch

MARK = "▁"
START = (1 << 21) - 1  # the label before the first
_NORMAL, _USER, _BYTE = 1, 4, 6
_SLICE = 1000  # texts encoded at once

_CELLS = 1 << 18  # places of lattices relaxed side by side
_STEP = 240  # characters between the windows over a long part, a multiple of many short periods
_BARE = -2  # what the end of a byte fallback arc gives


class Transducer:
    """The compiled model. Labels of arcs are piece ids; those of byte fallback follow after them."""

    def __init__(self, model: bytes, max_bytes: int = 80 << 20):
        proto = sentencepiece_model_pb2.ModelProto.FromString(model)
        if proto.trainer_spec.model_type != proto.trainer_spec.BPE or proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only BPE models with the identity normaliser are compiled")
        self.model, self.max_bytes = model, max_bytes
        pieces = {p.piece: (i, p.score) for i, p in enumerate(proto.pieces) if p.type in (_NORMAL, _USER)}
        self.prefix = MARK if proto.normalizer_spec.add_dummy_prefix else ""
        self.ids = {p: i for p, (i, _) in pieces.items()}
        self.scores = {p: s for p, (_, s) in pieces.items()}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == _BYTE}
        self.texts = [bytes([int(p.piece[3:5], 16)]) if p.type == _BYTE else p.piece.replace(MARK, " ").encode() if p.type in (_NORMAL, _USER) else b"" for p in proto.pieces]
        self.names = [p.piece for p in proto.pieces]
        # states are beginnings of pieces, 0 the empty one, and one for each length of the bytes of a
        # character in no piece; arcs by state and column are sorted for a binary search, and ends has
        # the id of a piece that ends there
        beginnings = sorted({p[:i] for p in pieces for i in range(len(p) + 1)})
        number = {b: i for i, b in enumerate(beginnings)}
        chars = sorted({c for p in pieces for c in p})
        column, self.columns = {c: i for i, c in enumerate(chars)}, len(chars) + 4
        read = sorted(column.items() | {(" ", column[MARK])})
        self.alphabet, self.column = np.array([ord(c) for c, _ in read], np.uint32), np.array([k for _, k in read])
        arcs = [(number[b[:-1]] * self.columns + column[b[-1]], number[b]) for b in beginnings[1:]] + [(len(chars) + k, len(beginnings) + k) for k in range(4)]
        self.arc_keys, self.arc_to = np.array(sorted(arcs), np.int64).T.copy()
        self.ends = np.array([self.ids.get(b, _BARE if len(b) == 1 else -1) for b in beginnings] + [_BARE] * 4, np.int64)
        self.cost = np.array([1 if b in self.ids else len(b.encode()) for b in beginnings] + [1, 2, 3, 4], float)
        self.lengths = np.array([len(p) for p in self.names])
        self.pairs: dict[int, float] = {}
        self.old_pairs: dict[int, float] = {}
        self.parts = Recent(max_bytes)
        # a space mark begins a part, and so does a change between signs and other characters,
        # as far as no piece has the two side by side
        together = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        self.joined = np.array(sorted(column[x] * self.columns + column[y] for x, y in together))
        whole = any(x != MARK and y == MARK for x, y in together)
        signs = set(string.punctuation + "\n\t")
        odd = {c for pair in together if len(signs.intersection(pair)) == 1 and MARK not in pair for c in pair if c not in signs}
        listed = "".join(map(re.escape, sorted(signs)))
        self.coarse = re.compile("(?s:.+)" if whole else f"[{MARK} ]*[^{MARK} ]+|[{MARK} ]+")
        self.fine = self.coarse if whole else re.compile(f"[{MARK} ]*(?:[^{MARK} {listed}]+|[{listed}]+)|[{MARK} ]+")
        self.odd = re.compile(f"[{''.join(map(re.escape, sorted(odd)))}]") if odd else re.compile("(?!)")

    def __reduce__(self):
        return built_once, (type(self), self.model, self.max_bytes)

    def columns_of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The code points of a text and their columns in the table of arcs."""
        chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        at = np.minimum(np.searchsorted(self.alphabet, chars), len(self.alphabet) - 1)
        other = self.columns - 4 + (chars >= 0x80).astype(np.int64) + (chars >= 0x800) + (chars >= 0x10000)
        return chars, np.where(self.alphabet[at] == chars, self.column[at], other)

    def merged(self, text: str) -> list[str]:
        """Characters merged pair by pair, best score and then leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            best = max(((self.scores[parts[i] + parts[i + 1]], -i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in self.scores), default=None)
            if best is None:
                break
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def between(self, pairs: np.ndarray) -> np.ndarray:
        """The acceptor of pairs (left << 21 | right): 0 for stable neighbours, else infinity. Labels
        from the number of pieces on are characters of byte fallback; START comes before the first."""
        distinct, at = np.unique(pairs, return_inverse=True)
        known = list(map(self.pairs.get, distinct.tolist()))
        for i, pair in enumerate(distinct.tolist()):
            if known[i] is None:
                known[i] = self.old_pairs.get(pair)
                if known[i] is None:
                    both = [self.names[x] if x < len(self.names) else chr(x - len(self.names)) for x in (pair >> 21, pair & START) if x != START]
                    known[i] = 0.0 if self.merged("".join(both)) == both else np.inf
                self.pairs[pair] = known[i]
        if len(self.pairs) > 150_000:
            self.old_pairs, self.pairs = self.pairs, {}
        return np.array(known)[at]

    def shortest_paths(self, parts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each part, which isn't empty, the weight of its shortest path and where its labels end
        among all labels, which come last."""
        n, size = len(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        width, rows = int(size.max()), np.repeat(np.arange(n), size)
        chars, code = np.zeros((n, width), np.int64), np.zeros((n, width), np.int64)
        places = rows, np.arange(len(rows)) - np.repeat(np.cumsum(size) - size, size)
        chars[places], code[places] = self.columns_of("".join(parts))
        weight, last, back = np.full((n, width + 1), np.inf), np.full((n, width + 1), START), np.zeros((n, width + 1), np.int64)
        weight[:, 0] = 0

        def relax(of: np.ndarray, start: int, end: int, label: np.ndarray, own: np.ndarray | float) -> None:
            total = weight[of, start] + own + self.between(last[of, start] << 21 | label)
            less = total < weight[of, end]
            weight[of[less], end], last[of[less], end], back[of[less], end] = total[less], label[less], start

        for start in range(width):
            of = np.flatnonzero((size > start) & (weight[:, start] < np.inf))
            state = np.zeros(len(of), np.int64)
            for end in range(start + 1, width + 1):
                key = state * self.columns + code[of, end - 1]
                arc = np.minimum(np.searchsorted(self.arc_keys, key), len(self.arc_keys) - 1)
                on = (self.arc_keys[arc] == key) & (size[of] >= end)
                of, state = of[on], self.arc_to[arc[on]]
                if not len(of):
                    break
                given = self.ends[state]
                full = given != -1
                if full.any():
                    label = np.where(given == _BARE, len(self.names) + chars[of, end - 1], given)
                    relax(of[full], start, end, label[full], self.cost[state[full]])
        at, steps = size.copy(), []
        of = np.flatnonzero(weight[np.arange(n), size] < np.inf)
        total = weight[np.arange(n), size]
        while len(of):  # back along the paths, all at once
            steps.append((of, last[of, at[of]]))
            at[of] = back[of, at[of]]
            of = of[at[of] > 0]
        owner, label = (np.concatenate(x[::-1]) for x in zip(*steps, strict=True)) if steps else (np.zeros(0, np.int64),) * 2
        order = np.argsort(owner, kind="stable")
        return total, np.cumsum(np.bincount(owner, minlength=n)), label[order]

    def _paths(self, parts: Sequence[str]) -> list[np.ndarray]:
        """The labels of the shortest path over each part; parts of like length go side by side."""
        out: list = [None] * len(parts)
        order = sorted(range(len(parts)), key=lambda i: len(parts[i]))
        while order:
            n = max(1, min(len(order), _CELLS // len(parts[order[-1]])))
            group, order = order[-n:], order[:-n]
            weight, ends, labels = self.shortest_paths([parts[i] for i in group])
            if np.isinf(weight).any():
                raise ValueError(f"no path over {parts[group[int(np.isinf(weight).argmax())]][:50]!r}")
            begin = 0
            for i, end in zip(group, ends.tolist(), strict=True):
                out[i], begin = labels[begin:end], end
        return out

    def _path(self, part: str) -> np.ndarray:
        """The labels over a long part: those of windows, each up to the first piece that the next one has too.
        Where two share none, as in a run of one character out of step, windows are laid anew from
        a piece of the path on; if that doesn't help, longer ones are."""
        step, nothing = _STEP, np.zeros(0, np.int64)
        out, held, keys, begin, again = [], nothing, nothing, 0, 0
        while True:
            starts = range(begin, max(begin + 1, len(part) - step), step)
            for i, labels in enumerate(self._paths([part[a : a + 2 * step] for a in starts])):
                sizes = np.where(labels < len(self.names), self.lengths[np.minimum(labels, len(self.names) - 1)], 1)
                own = (starts[i] + np.cumsum(sizes) - sizes) << 21 | labels
                if len(keys):
                    shared = np.intersect1d(keys, own, assume_unique=True)
                    if not len(shared):
                        break
                    out.append(held[: np.searchsorted(keys, shared[0])])
                    first = int(np.searchsorted(own, shared[0]))
                    labels, own = labels[first:], own[first:]
                held, keys = labels, own
            else:
                return np.concatenate([*out, held])
            again += 1
            if i and again <= 8:
                begin = int(keys[max(0, np.searchsorted(keys, (starts[i] + 1) << 21) - 1)] >> 21)
            else:
                step *= 4
                out, held, keys, begin, again = [], nothing, nothing, 0, 0

    def _cut(self, parts: Sequence[str]) -> list[list[str]]:
        """Each part, which isn't empty, cut between any two characters that no piece has side by side."""
        whole = "".join(parts)
        code = self.columns_of(whole)[1]
        pair = code[:-1] * self.columns + code[1:]
        apart = np.ones(len(code), bool)
        apart[:-1] = self.joined[np.minimum(np.searchsorted(self.joined, pair), len(self.joined) - 1)] != pair
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        apart[ends - 1] = True
        at = np.flatnonzero(apart) + 1
        places, out, i = at.tolist(), [], 0
        begin = 0
        for n in np.searchsorted(at, ends, "right").tolist():
            out.append([whole[a:b] for a, b in zip([begin, *places[i : n - 1]], places[i:n], strict=True)])
            begin, i = places[n - 1], n
        return out

    def encode_parts(self, parts: Sequence[str]) -> list[bytes]:
        """The piece ids of the shortest path over each part, as little-endian 32-bit integers."""
        if not parts:
            return []
        cut = self._cut(parts)
        distinct = list(set().union(*cut))
        short = [p for p in distinct if len(p) <= 2 * _STEP]
        paths = dict(zip(short, self._paths(short), strict=True)) | {p: self._path(p) for p in distinct if len(p) > 2 * _STEP}
        ids = {p: self._ids(labels) for p, labels in paths.items()}
        return [b"".join(map(ids.__getitem__, c)) for c in cut]

    def _ids(self, labels: np.ndarray) -> bytes:
        top = len(self.names)
        if labels.max() >= top:
            labels = np.array([y for x in labels.tolist() for y in ([x] if x < top else map(self.bytes.__getitem__, chr(x - top).encode()))])
        return labels.astype("<i4").tobytes()

    def encode_batch(self, texts: Sequence[str]) -> Iterator[np.ndarray]:
        """The piece ids of each text; what comes again among all of them is looked up once."""
        for at in range(0, len(texts), _SLICE):
            cut = [(self.coarse if self.odd.search(t) else self.fine).findall(self.prefix + t) if t else [] for t in texts[at : at + _SLICE]]
            parts = list(set().union(*cut))
            known = dict(zip(parts, self.parts.get(parts, self.encode_parts), strict=True))
            yield from (np.frombuffer(b"".join(map(known.__getitem__, c)), "<i4") for c in cut)

    def encode(self, text: str) -> list[int]:
        return next(self.encode_batch([text])).tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """The text of piece ids: bytes joined, the leading space mark taken off."""
        raw = b"".join([self.texts[i] for i in ids])
        return (raw[1:] if self.prefix and raw[:1] == b" " else raw).decode("utf-8", "replace")


def load_transducer(path: str) -> Transducer:
    with open(path, "rb") as f:
        return built_once(Transducer, f.read(), 80 << 20)


def encode_docs(docs: DataFrame, transducer: Transducer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pieces): the piece ids of every row. Null and empty texts give no ids; repeated
    rows each give a row; an empty table gives no rows; other columns are ignored."""
    schema = pa.schema([("doc_id", pa.int64()), ("pieces", pa.list_(pa.int32()))])
    make = lambda b: {"doc_id": b.column(0), "pieces": list(transducer.encode_batch([t or "" for t in b.column(1).to_pylist()]))}
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(by_batch(make, schema), "doc_id long, pieces array<int>")


def decode_docs(encoded: DataFrame, transducer: Transducer) -> DataFrame:
    """(doc_id, text) of (doc_id, pieces)."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
    make = lambda b: {"doc_id": b.column("doc_id"), "text": [transducer.decode(p or ()) for p in b.column("pieces").to_pylist()]}
    return encoded.mapInArrow(by_batch(make, schema), "doc_id long, text string")


def round_trip(docs: DataFrame, transducer: Transducer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_pieces, pieces_crc32, text_crc32, exact) of every row, in one narrow pass: counts and
    checksums (of the ids as little-endian unsigned 32-bit integers, and of the decoded text in
    UTF-8), and whether decoding gave the text again."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("pieces_crc32", pa.int64()), ("text_crc32", pa.int64()), ("exact", pa.bool_())])

    def make(batch: pa.RecordBatch) -> dict:
        out: dict = {"doc_id": batch.column(0), "n_pieces": [], "pieces_crc32": [], "text_crc32": [], "exact": []}
        texts = [t or "" for t in batch.column(1).to_pylist()]
        for text, ids in zip(texts, transducer.encode_batch(texts), strict=True):
            again = transducer.decode(ids.tolist())
            out["n_pieces"].append(len(ids))
            out["pieces_crc32"].append(zlib.crc32(ids.tobytes()))
            out["text_crc32"].append(zlib.crc32(again.encode()))
            out["exact"].append(again == text)
        return out

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(by_batch(make, schema), "doc_id long, n_pieces long, pieces_crc32 long, text_crc32 long, exact boolean")


def encode_checked(docs: DataFrame, transducer: Transducer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_pieces, pieces, exact) of every row: the ids, and whether they decode to the text."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("pieces", pa.list_(pa.int32())), ("exact", pa.bool_())])

    def make(batch: pa.RecordBatch) -> dict:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        out: dict = {"doc_id": batch.column(0), "n_pieces": [], "pieces": [], "exact": []}
        for text, ids in zip(texts, transducer.encode_batch(texts), strict=True):
            out["n_pieces"].append(len(ids))
            out["pieces"].append(ids)
            out["exact"].append(transducer.decode(ids.tolist()) == text)
        return out

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(by_batch(make, schema), "doc_id long, n_pieces long, pieces array<int>, exact boolean")


def reference_processor(path: str) -> sentencepiece.SentencePieceProcessor:
    """The library's own encoder, for tests."""
    return sentencepiece.SentencePieceProcessor(model_file=path)
