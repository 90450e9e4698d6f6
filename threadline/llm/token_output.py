"""Token-id output compressed by Re-Pair grammars.

Texts are encoded in ascending id order (a range shuffle) and cut into shards of about
``shard_tokens`` ids, whole documents each. A shard is compressed on its own: frequent pairs
of neighbouring symbols become nonterminals, round after round, never across documents. The
file format is a Parquet table with one row per shard:

  part, shard     place in the order (range partition, number in it)
  before          ids of the part's earlier shards
  doc_ids, sizes  the documents and their numbers of ids
  offsets         each document's first symbol in ``symbols`` (random access)
  left, right     the rules: nonterminal ``base + k`` stands for left[k] right[k]
  lengths         number of ids each rule expands to
  symbols         the compressed sequence

Number columns of a shard are little-endian unsigned 32-bit binaries. Spark writes the files,
so a lost executor's part is written again and committed once.

Encoding looks up what stands between single spaces: the pre-tokeniser always begins a new
token at a space that another character precedes and a non-space follows, so those units
encode alone, with their space, as they do in place. So do signs between a letter and the end of a unit or line,
and a single newline between two lines. A text where a space follows white space and has no
such character after it is encoded as a whole.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Recent, built_once, slices, written

#: White space in all its forms, and a space that no unit may be cut at.
_WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_UNSAFE = f"{_WS} {_WS}|{_WS} $| $"
#: The same white space in UTF-8, as numbers of one, two and three bytes.
_WS_UTF8 = [[*range(9, 14), *range(28, 33)], [0xC285, 0xC2A0], [0xE19A80, *range(0xE28080, 0xE2808B), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080]]
#: A space in the vocabulary of byte-level models.
_SPACE = "\u0120"
_SIGNS = bytes(c in b".,!?;:)]}%&$#*" for c in range(256))  # for translate()
_SLICE = 8 << 20  # bytes of text encoded at once
SHARD = pa.schema([
    ("part", pa.int32()), ("shard", pa.int32()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.binary()), ("offsets", pa.binary()),
    ("base", pa.int64()), ("left", pa.binary()), ("right", pa.binary()), ("lengths", pa.binary()), ("symbols", pa.binary()),
])
_SHARD_DDL = "part int, shard int, before long, n_tokens long, doc_ids array<long>, sizes binary, offsets binary, base long, left binary, right binary, lengths binary, symbols binary"


def _white(before: np.ndarray, last: bool) -> np.ndarray:
    """Whether three bytes, as one number, end (or begin) with white space."""
    if last:
        return np.isin(before & 0xFF, _WS_UTF8[0]) | np.isin(before & 0xFFFF, _WS_UTF8[1]) | np.isin(before, _WS_UTF8[2])
    return np.isin(before >> 16, _WS_UTF8[0]) | np.isin(before >> 8, _WS_UTF8[1]) | np.isin(before, _WS_UTF8[2])


def cut_units(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The units of texts in which spaces are safe cuts, one after the other, each with the space before it;
    and where those of each text begin, with the end of the last. What begins a text, a run of
    signs, a newline or a line has no space before it."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets, n = offsets - offsets[0], len(data)
    edge = np.zeros(n + 1, bool)  # texts begin or end here
    edge[offsets] = True
    cut = edge.copy()
    cut[:-1] |= data == 32
    padded = np.concatenate([np.zeros(3, np.uint8), data, np.zeros(4, np.uint8)])
    three = lambda at: (padded[at + 3].astype(np.int32) << 16) | (padded[at + 4].astype(np.int32) << 8) | padded[at + 5]
    # a single newline between two lines
    line = np.flatnonzero(data == 10)
    line = line[~edge[line] & ~edge[line + 1]]
    line = line[~_white(three(line - 3), True) & ~_white(three(line + 1), False)]
    cut[line] = cut[line + 1] = True
    # signs between a letter and the end of a unit or line
    sign = np.flatnonzero(np.frombuffer(data.tobytes().translate(_SIGNS), bool))
    if len(sign):
        first = np.r_[True, (np.diff(sign) > 1) | edge[sign[1:]]]
        begin, end = sign[first], sign[np.r_[first[1:], True]] + 1
        ends = edge[end] | np.isin(padded[end + 3], (10, 32))
        begin = begin[ends & ~edge[begin]]
        a, b = padded[begin + 1].astype(np.int32), padded[begin + 2].astype(np.int32)
        two = np.where((b & 0xC0) == 0x80, (a << 6 | b & 0x3F) - (0xC0 << 6), 0)  # the code point of a character of two bytes
        cut[begin[((b | 32) >= 97) & ((b | 32) <= 122) | (two >= 0xC0) & (two <= 0x24F) & (two != 0xD7) & (two != 0xF7)]] = True
    at = np.flatnonzero(cut[:-1])
    units = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.append(at, n).astype(np.int32)), pa.py_buffer(data))
    return units, np.searchsorted(at, offsets)


#: Bytes of a key; the last one holds the unit's length.
_KEY = 24
_KEPT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places first, first + 1, ... of n each, one after the other."""
    wide = np.int32 if n.sum(dtype=np.int64) < 1 << 31 and first.max(initial=0) < 1 << 31 else np.int64
    at = np.repeat(first.astype(wide) - (np.cumsum(n, dtype=wide) - n.astype(wide)), n)
    at += np.arange(len(at), dtype=wide)
    return at


def unit_keys(units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of each unit, filled up with zeros, and its length, as three numbers: equal for equal
    units alone. And which units are short enough for that; the others' keys mean nothing."""
    offsets = np.frombuffer(units.buffers()[1], np.int32)[units.offset : units.offset + len(units) + 1]
    data = np.frombuffer(units.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    data = np.concatenate([data, np.zeros(_KEY + 8, np.uint8)])
    words = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))  # at every byte
    begin, n = offsets[:-1] - offsets[0], np.diff(offsets)
    key = np.empty((len(units), 3), np.uint64)
    for k in range(3):
        key[:, k] = words[np.minimum(begin + 8 * k, len(words) - 1)] & _KEPT[np.clip(n - 8 * k, 0, 8)]
    key[:, 2] |= n.astype(np.uint64) << np.uint64(56)
    return key, n < _KEY


class _Half:
    """The ids of up to ``most`` keys, found by hash."""

    def __init__(self, most: int):
        self.bits = max(4, (2 * most - 1).bit_length())
        self.slot = np.zeros(1 << self.bits, np.int32)  # 1 + place, 0: free
        self.key = np.empty((most, 3), np.uint64)
        self.first, self.size = np.empty(most, np.int32), np.empty(most, np.int32)
        self.ids = np.empty(6 * most, np.uint32)
        self.n = self.n_ids = 0

    def _at(self, key: np.ndarray) -> np.ndarray:
        h = key[:, 0] * np.uint64(0x9E3779B97F4A7C15)
        for k in (1, 2):
            h ^= h >> np.uint64(31)
            h += key[:, k]
            h *= np.uint64(0xBF58476D1CE4E5B9)
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, key: np.ndarray) -> np.ndarray:
        """The place of each key; -1 where it isn't known."""
        out, todo, at = np.full(len(key), -1, np.int32), np.arange(len(key)), self._at(key)
        while len(todo):
            place = self.slot.take(at) - 1
            used = np.flatnonzero(place >= 0)
            todo, at, place = todo.take(used), at.take(used), place.take(used)
            same = (self.key.take(place, axis=0) == key.take(todo, axis=0)).all(axis=1)
            out[todo[same]] = place[same]
            todo, at = todo[~same], (at[~same] + 1) & ((1 << self.bits) - 1)
        return out

    def room(self, size: np.ndarray) -> int:
        """How many of the next keys, with that many ids each, still fit."""
        return min(len(self.key) - self.n, int(np.searchsorted(np.cumsum(size), len(self.ids) - self.n_ids, "right")))

    def add(self, key: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        """Distinct keys that aren't known, for which there is room."""
        place, end = self.n + np.arange(len(key), dtype=np.int32), self.n + len(key)
        self.key[self.n : end], self.size[self.n : end] = key, size
        self.first[self.n : end] = self.n_ids + np.cumsum(size) - size
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.n, self.n_ids = end, self.n_ids + len(ids)
        at = self._at(key)
        while len(place):
            free = np.flatnonzero(self.slot.take(at) == 0)
            self.slot[at.take(free)] = place.take(free) + 1  # of several at a free one, the last stays
            rest = np.flatnonzero(self.slot.take(at) != place + 1)
            place, at = place.take(rest), (at.take(rest) + 1) & ((1 << self.bits) - 1)


class RecentIds:
    """As Recent, for unit_keys(): what was looked up lately, in about ``max_bytes`` of arrays, a batch at a time."""

    def __init__(self, max_bytes: int):
        self.most = max(16, max_bytes // 2 // 72)
        self.young, self.old = _Half(self.most), _Half(16)

    def get(self, key: np.ndarray, make: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of distinct keys, and the number of each; ``make`` gives those at the places of
        ``key`` that aren't known."""
        young = self.young.find(key)
        missing = np.flatnonzero(young < 0)
        old = self.old.find(key.take(missing, axis=0))
        new_ids, new_size = make(missing[old < 0])
        hit, again = np.flatnonzero(young >= 0), np.flatnonzero(old >= 0)
        young, old = young.take(hit), old.take(again)
        size = np.empty(len(key), np.int32)
        size[hit], size[missing[again]] = self.young.size.take(young), self.old.size.take(old)
        size[np.delete(missing, again)] = new_size
        first = np.cumsum(size, dtype=np.int64) - size
        ids = np.empty(int(size.sum(dtype=np.int64)), np.uint32)
        for at, half, place in ((hit, self.young, young), (missing[again], self.old, old)):
            ids[_ranges(first.take(at), size.take(at))] = half.ids.take(_ranges(half.first.take(place), size.take(at)))
        ids[_ranges(first.take(np.delete(missing, again)), new_size)] = new_ids
        while len(missing):
            some = missing[: self.young.room(size.take(missing))]
            self.young.add(key.take(some, axis=0), ids.take(_ranges(first.take(some), size.take(some))), size.take(some))
            missing = missing[len(some) :]
            if len(missing):  # full; a key has fewer ids than an empty half has room for
                self.old, self.young = self.young, _Half(self.most)
        return ids, size


class CachedEncoder:
    """The ids of texts by the tokenizers library; units that come again are looked up, also in later
    tasks of the same Python worker, in tables of about ``max_bytes``: short ones in arrays, the others
    in a dict of a fifth of that.

    A batch is split at spaces and its units numbered by Arrow; only distinct ones that aren't known
    meet Python."""

    def __init__(self, tokenizer_json: str, max_bytes: int = 140 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        from tokenizers import Tokenizer

        self.tokenizer_json, self.max_bytes = tokenizer_json, max_bytes
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.units, self.long_units = RecentIds(max_bytes // 5 * 4), Recent(max_bytes // 5)
        self.spaced = np.zeros(self.tokenizer.get_vocab_size(), bool)  # ids that begin with a space
        self.spaced[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith(_SPACE)]] = True

    def __reduce__(self):
        return built_once, (type(self), self.tokenizer_json, self.max_bytes)

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and the number of each."""
        ids, size = array("I"), []
        for k in range(0, len(texts), 10_000):
            for e in self.tokenizer.encode_batch_fast(texts[k : k + 10_000], add_special_tokens=False):
                size.append(len(e))
                ids.extend(e.ids)
        return np.array(ids, np.uint32), np.array(size, np.int32)

    def _units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of units, and the number of each. Those that begin with a space are encoded in rows of
        many; a row is taken apart at the ids that begin with a space, and unit by unit where their
        number isn't that of its units."""
        joined = [i for i, u in enumerate(units) if u[:1] != " "]
        rest = np.delete(np.arange(len(units)), joined)
        spaced = [u for u in units if u[:1] == " "] if joined else units
        rows = [spaced[k : k + 100] for k in range(0, len(spaced), 100)]
        ids, n = self._whole(["".join(row) for row in rows])
        parts, sizes = [], []
        for row, some in zip(rows, np.split(ids, np.cumsum(n)[:-1]), strict=False):
            begin = np.flatnonzero(self.spaced[some])
            if len(begin) == len(row) and begin[0] == 0:
                parts.append(some)
                sizes.append(np.diff(begin, append=len(some)))
            else:
                one = self._whole(row)
                parts.append(one[0])
                sizes.append(one[1])
        own_ids, own_size = self._whole([units[i] for i in joined])
        size = np.empty(len(units), np.int32)
        size[joined] = own_size
        size[rest] = np.concatenate([np.zeros(0, np.int32), *sizes])
        first = np.cumsum(size, dtype=np.int64) - size
        out = np.empty(int(size.sum(dtype=np.int64)), np.uint32)
        out[_ranges(first[joined], own_size)] = own_ids
        out[_ranges(first[rest], size[rest])] = np.concatenate([np.zeros(0, np.uint32), *parts])
        return out, size

    def _long(self, units: list[str]) -> list[bytes]:
        ids, size = self._units(units)
        return [a.tobytes() for a in np.split(ids, np.cumsum(size)[:-1])] if units else []

    def encode(self, texts: pa.Array, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (null: empty), each text's followed by end; and the number of each."""
        texts = pc.fill_null(texts, "")
        unsafe = pc.match_substring_regex(texts, _UNSAFE)
        uncut = unsafe.to_numpy(zero_copy_only=False)
        whole_ids, whole_size = self._whole(texts.filter(unsafe).to_pylist())
        units, begin = cut_units(pc.if_else(unsafe, "", texts) if uncut.any() else texts)
        units = units.dictionary_encode()
        code = units.indices.to_numpy(zero_copy_only=False)
        key, short = unit_keys(units.dictionary)
        take = lambda at: units.dictionary.take(pa.array(at)).to_numpy(zero_copy_only=False).tolist()  # noqa: E731  # quicker than to_pylist()
        short, long = np.flatnonzero(short), np.flatnonzero(~short)
        ids, size = self.units.get(key.take(short, axis=0), lambda at: self._units(take(short[at])))
        long_ids = self.long_units.get(take(long), self._long)
        end_ids = np.frombuffer(end, "<u4")
        # short and long units, texts that can't be cut, and the end
        values = np.concatenate([ids, np.frombuffer(b"".join(long_ids), np.uint32), whole_ids, end_ids])
        sizes = np.concatenate([size, [len(a) // 4 for a in long_ids], whole_size, [len(end_ids)]]).astype(np.int32)
        first = np.cumsum(sizes, dtype=np.int64) - sizes
        place = np.empty(len(short) + len(long), np.int32)
        place[np.concatenate([short, long])] = np.arange(len(place))
        # after a text's units stand the text that can't be cut, if it is one, and the end
        more = 1 + uncut
        after = np.full(more.sum(), len(sizes) - 1, np.int32)
        after[(np.cumsum(more) - more)[uncut]] = len(place) + np.arange(len(whole_size))
        code = np.insert(place.take(code), np.repeat(begin[1:], more), after)
        n = sizes.take(code)
        at = _ranges(first.take(code), n)
        begin = begin[:-1] + np.cumsum(more) - more
        return values.take(at).astype("<u4", copy=False), np.add.reduceat(n, begin, dtype=np.int64) if len(begin) else n[:0].astype(np.int64)


_HASH_BITS = 18
#: Of a place in the sequence: the pair that begins there may be frequent; a document ends there.
_LIVE, _END, _SYMBOL = np.uint32(1 << 31), np.uint32(1 << 30), np.uint32((1 << 30) - 1)


def _hash(key: np.ndarray) -> np.ndarray:
    """The leading bits of a product that wraps around."""
    if key.dtype == np.uint32:
        return (key * np.uint32(0x9E3779B1)) >> np.uint32(32 - _HASH_BITS)
    return (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _HASH_BITS)


def repair(ids: np.ndarray, ends: np.ndarray, base: int, per_round: int = 4096, least: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """left, right and lengths of the rules, and the compressed symbols. ends flags the last id of
    each document. In each round the most frequent pairs, found ``least`` times or more, get
    nonterminals; where pairs overlap, every other one is taken, from the left. It ends when no
    pair is found ``least`` times.

    ``_LIVE`` flags the places whose pair may be found that often: a pair found less often never
    becomes more frequent, so after a round only those and the neighbours of new nonterminals
    are counted. Flags stand in the symbols' leading bits, so that places move but once."""
    seq = ids.astype(np.uint32)
    seq |= np.where(ends, _END, _LIVE)
    left, right, lengths = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = lambda s: np.where(s < base, 1, lengths[np.maximum(s - base, 0)]) if len(lengths) else np.ones(len(s), np.int64)
    while True:
        seq[-1:] &= ~_LIVE
        at = np.flatnonzero(seq >= _LIVE)
        n = base + len(left)
        kind, bits = (np.uint32, 16) if n <= 1 << 16 else (np.uint64, 32)  # a pair in 32 bits while it fits
        key = (seq.take(at) & _SYMBOL).astype(kind)
        key <<= kind(bits)
        key |= seq[1:].take(at) & _SYMBOL
        ordered = np.sort(key)
        first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, np.int64)
        count = np.diff(np.r_[first, len(ordered)])
        often = count >= least
        pairs, count = ordered[first][often], count[often]
        if not len(pairs):
            return left, right, lengths, (seq & _SYMBOL).astype(np.int64)
        slots = _hash(key)
        frequent = np.zeros(1 << _HASH_BITS, bool)
        frequent[_hash(pairs)] = True
        stay = np.flatnonzero(frequent.take(slots))  # places are found once, as masks are slow to take by
        at, key, slots = at.take(stay), key.take(stay), slots.take(stay)
        pairs = pairs[np.argsort(-count, kind="stable")[:per_round]]
        # a table by hash; of pairs that share a place in it, the others wait for the next round
        slot, first = np.unique(_hash(pairs), return_index=True)
        pairs = pairs[first]
        owner = np.full(1 << _HASH_BITS, -1, np.int32)
        owner[slot] = np.arange(len(pairs))
        rule = owner.take(slots)
        own = np.flatnonzero((rule >= 0) & (pairs.take(rule, mode="wrap") == key))
        place, rule = at.take(own), rule.take(own)
        over = np.flatnonzero(np.diff(place) == 1) + 1  # of overlapping places, every other one
        if len(over):
            nth = np.arange(len(over))
            nth -= np.maximum.accumulate(np.where(np.r_[True, np.diff(over) > 1], nth, 0))
            taken = np.ones(len(place), bool)
            taken[over[nth % 2 == 0]] = False
            taken = np.flatnonzero(taken)
            place, rule = place.take(taken), rule.take(taken)
        # half the places or more are taken, so one pair at least keeps half of its own; the others wait
        good = 2 * np.bincount(rule, minlength=len(pairs)) >= least
        if not good.all():
            place, rule, pairs = place[good[rule]], (np.cumsum(good) - 1)[rule[good[rule]]], pairs[good]
        new_left, new_right = (pairs >> kind(bits)).astype(np.int64), (pairs & kind((1 << bits) - 1)).astype(np.int64)
        lengths = np.concatenate([lengths, size(new_left) + size(new_right)])
        left, right = np.concatenate([left, new_left]), np.concatenate([right, new_right])
        seq &= ~_LIVE
        seq[at] |= _LIVE
        seq[place] = (n + rule).astype(np.uint32) | _LIVE | seq.take(place + 1) & _END
        seq[np.maximum(place - 1, 0)] |= _LIVE
        keep = np.ones(len(seq), bool)
        keep[place + 1] = False
        seq = seq.take(np.flatnonzero(keep))
        seq &= ~((seq & _END) << np.uint32(1))


def expand(symbols: np.ndarray, base: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The ids that a symbol sequence stands for, a level of rules at a time."""
    seq = symbols.astype(np.int64)
    while (rule := seq >= base).any():
        start = np.cumsum(1 + rule) - (1 + rule)
        out = np.empty(len(seq) + int(rule.sum()), np.int64)
        out[start] = np.where(rule, left[np.where(rule, seq - base, 0)], seq)
        out[start[rule] + 1] = right[seq[rule] - base]
        seq = out
    return seq


def expand_all(symbols: np.ndarray, base: int, left: np.ndarray, right: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """As expand(), for long sequences: the rules are expanded once and copied by their lengths."""
    rules = expand(base + np.arange(len(left)), base, left, right)
    values = np.r_[np.arange(base), rules].astype("<u4")
    size = np.r_[np.ones(base, np.int32), lengths.astype(np.int32)]
    first = np.cumsum(size) - size
    n = size[symbols]
    at = np.repeat(first[symbols] - (np.cumsum(n) - n), n)
    at += np.arange(len(at))
    return values[at]


def _u4(a: np.ndarray) -> bytes:
    return np.asarray(a).astype("<u4").tobytes()


def _numbers(b: bytes) -> np.ndarray:
    return np.frombuffer(b, "<u4").astype(np.int64)


def make_shard(part: int, shard: int, before: int, doc_ids: list, ids: np.ndarray, sizes: np.ndarray, base: int) -> dict:
    """A shard of documents whose ids follow each other, sizes of them each."""
    ends = np.zeros(len(ids), bool)
    ends[np.cumsum(sizes)[sizes > 0] - 1] = True
    left, right, lengths, symbols = repair(ids, ends, base)
    first_id = np.cumsum(np.r_[0, np.where(symbols < base, 1, lengths[np.maximum(symbols - base, 0)] if len(lengths) else 1)])
    offsets = np.searchsorted(first_id, np.cumsum(sizes) - sizes)
    return {"part": part, "shard": shard, "before": before, "n_tokens": len(ids), "doc_ids": doc_ids, "sizes": _u4(sizes), "offsets": _u4(offsets), "base": base, "left": _u4(left), "right": _u4(right), "lengths": _u4(lengths), "symbols": _u4(symbols)}


def decode_shard(row: dict) -> list[np.ndarray]:
    """The ids of every document of a shard."""
    ids = expand_all(_numbers(row["symbols"]), row["base"], _numbers(row["left"]), _numbers(row["right"]), _numbers(row["lengths"]))
    return np.split(ids, np.cumsum(_numbers(row["sizes"]))[:-1])


def decode_document(row: dict, k: int) -> np.ndarray:
    """The ids of the k-th document alone: only its own symbols are expanded."""
    offsets = np.r_[_numbers(row["offsets"]), len(row["symbols"]) // 4]
    return expand(_numbers(row["symbols"])[offsets[k] : offsets[k + 1]], row["base"], _numbers(row["left"]), _numbers(row["right"]))


def token_shards(docs: DataFrame, tokenizer_json: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = 1_000_000) -> DataFrame:
    """Shards of docs in ascending id order. Null texts count as empty; equal ids stand in the
    order of a hash of their texts, null ids first, so that ranges can also part the rows of one
    id; an empty table gives no shards; other columns are ignored; long texts are encoded whole,
    and a document is never split between shards."""
    encoder = built_once(CachedEncoder, tokenizer_json, 140 << 20)
    base = max(encoder.tokenizer.get_vocab_size(), (end_id or 0) + 1)
    end = b"" if end_id is None else _u4(np.array([end_id]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, before = TaskContext.get().partitionId(), 0, 0
        doc_ids: list = []
        held: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        n = 0
        for batch in batches:
            for some in slices(batch, 1, _SLICE):
                ids, size = encoder.encode(some.column(1), end)
                doc_ids += some.column(0).to_pylist()
                held.append(ids)
                sizes.append(size)
                n += len(ids)
                pa.default_memory_pool().release_unused()  # the copies that the cut made
                if n >= shard_tokens:
                    yield pa.RecordBatch.from_pylist([make_shard(part, shard, before, doc_ids, np.concatenate(held), np.concatenate(sizes), base)], SHARD)
                    doc_ids, held, sizes, shard, before, n = [], [], [], shard + 1, before + n, 0
        if doc_ids:
            yield pa.RecordBatch.from_pylist([make_shard(part, shard, before, doc_ids, np.concatenate(held), np.concatenate(sizes), base)], SHARD)

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    order = ["doc_id", F.xxhash64(F.coalesce("text", F.lit("")))]
    return picked.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, _SHARD_DDL)


def write_tokens(docs: DataFrame, path: str, tokenizer_json: str, **how) -> DataFrame:
    """Writes token_shards() to path and returns them as read back."""
    token_shards(docs, tokenizer_json, **how).write.option("compression", "zstd").parquet(path)
    return read_tokens(docs.sparkSession, path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_SHARD_DDL).parquet(path)


def token_index(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the shards. Only a sum
    for each range partition reaches the driver."""
    sums = {r.part: r.n for r in shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).toLocalIterator()}
    first, total = {}, 0
    for part in sorted(sums):
        first[part] = total
        total += sums[part]
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                docs = decode_shard(row)
                sizes = np.array([len(d) for d in docs], np.int64)
                start = first[row["part"]] + row["before"] + np.cumsum(sizes) - sizes
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(start), pa.array(sizes), pa.array([zlib.crc32(_u4(d)) for d in docs], pa.int64())], schema=schema)

    return shards.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def shared_shards(docs: DataFrame, tokenizer_json: str, **how) -> DataFrame:
    """token_shards() written to the shared folder, as read back."""
    return written(token_shards(docs, tokenizer_json, **how), "token-shards")
