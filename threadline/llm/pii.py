"""PII spans: fixed rules, and candidates judged by gradient boosting.

High-recall generators propose overlapping spans of four kinds. Boosted trees score each one
from its format (digits, separators, groups, checksum) and its context (neighbouring
characters and words). The threshold of a kind is the lowest that keeps the precision on a
calibration half at ``precision`` or more. Spans of the rules always stay; a candidate is
added where it scores over its threshold and touches no other span, best score first. All
of it is linear in the length of a text, also for long runs without a space.

Labels come from the text itself: what a rule accepts is positive, also written in other
usual ways (dots or no separators, another country code or none, "(at)", names without numbers, shorter domains); what the rules reject, and
accepted numbers with a digit changed so that the check fails, is negative, and so is what
reaches from one number into another beside it. They come from all documents: trees only test
features against some edges (quantiles over all rows), so rows that lie between the same edges are
counted by Spark, and the fit on those counts is the fit on all rows.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, deleted, slices, written

KINDS = ("email", "ip", "card", "phone")
# The rules of the four kinds.
LOCAL = string.ascii_letters + string.digits + "._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")  # a match always begins where its digits do
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_LOOSE_EMAIL = re.compile(r"(?<![\w.%+-])[\w.%+-]++\s?(?:@|\(at\)|\[at\])\s?[\w-]+(?:\s?(?:\.|\(dot\)|\[dot\])\s?[\w-]+)*")
_LOOSE_NUMBER = re.compile(r"\+?\(?[0-9](?:[\x20()./-]{0,2}[0-9])+")
_GROUP = re.compile(r"[0-9]+")
_COUNTRY = re.compile(r"\+[0-9]{1,3}[\x20(.-]{0,2}$")  # a country code just before
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_HINT = {"email": ("mail", "contact"), "ip": ("ip", "host", "server", "addr"), "card": ("card", "visa", "credit", "karte", "tarjeta", "carte"), "phone": ("tel", "phone", "call", "mobile", "fax")}

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def rule_accepts(kind: str, found: str) -> bool:
    """Whether a match of a kind's pattern also passes its check."""
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in found.split("."))
    digits = _NOT_DIGIT.sub("", found)
    return 14 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 10 <= len(digits) <= 15


def emails(text: str) -> Iterator[Span]:
    """Leftmost, non-overlapping addresses: what stands before an @ as far as it may, then a domain
    with a dot. In one sweep over the @ signs, so that long runs of letters stay linear."""
    last, begin = 0, 0
    while (at := text.find("@", begin)) >= 0:
        before = text[max(begin, last) : at]
        start = at - len(before) + len(before.rstrip(LOCAL))
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end(), "email"
            last = domain.end()
        begin = at + 1


def base_spans(text: str) -> list[Span]:
    """What the rules find, by start and then kind; leftmost and non-overlapping for each kind."""
    patterns = [("ip", IP), ("card", CARD), ("phone", PHONE)] * bool(_DIGIT.search(text))
    out = list(emails(text)) + [(*m.span(), kind) for kind, p in patterns for m in p.finditer(text) if rule_accepts(kind, m[0])]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str) -> Iterator[Span]:
    """Spans that might be personal data; one place may give several, of several kinds."""
    if "@" in text or "(at)" in text or "[at]" in text:
        yield from ((*m.span(), "email") for m in _LOOSE_EMAIL.finditer(text))
    if _DIGIT.search(text):
        for m in _LOOSE_NUMBER.finditer(text):
            yield from _number_spans(text, *m.span())


def _number_spans(text: str, start: int, end: int) -> Iterator[Span]:
    """A run of numbers as a whole, then every stretch of its groups that is long enough for a
    kind, as several numbers may stand side by side. Linear: a stretch has 19 digits at most."""
    groups = [m.span() for m in _GROUP.finditer(text, start, end)]
    n = sum(b - a for a, b in groups)
    if n >= 4 and text.count(".", start, end) == 3:
        yield start, end, "ip"
    if 12 <= n <= 19:
        yield start, end, "card"
    if 7 <= n <= 17:
        yield start, end, "phone"
    for i, (a, b) in enumerate(groups):
        first = a
        for sign in "(+":
            first -= first > start and text[first - 1] == sign
        n = 0
        for k in range(i, len(groups)):
            n += groups[k][1] - groups[k][0]
            last = groups[k][1]
            if n > 19 and k > i + 3:
                break
            if (first, last) == (start, end):
                continue
            if k == i + 3 and all(text[groups[j][1] : groups[j + 1][0]] == "." for j in range(i, k)):
                yield a, last, "ip"
            if 12 <= n <= 19:
                yield first, last, "card"
            if 7 <= n <= 17:
                yield first, last, "phone"


def covered(text: str, spans: list[Span]) -> bytearray:
    """One byte per character of text: whether a span covers it."""
    out = bytearray(len(text))
    for a, b, _ in spans:
        out[a:b] = b"\1" * (b - a)
    return out


def features(text: str, span: Span) -> list[float]:
    start, end, kind = span
    found = text[start:end]
    digits = _NOT_DIGIT.sub("", found)
    groups = [g for g in re.split(r"[^0-9]+", found) if g]
    before, after = text[max(0, start - 24) : start].lower(), text[end : end + 24].lower()
    left, right = before[-1:], after[:1]
    parts = [min(int(g[:9]), 999) for g in groups]
    return [
        KINDS.index(kind), len(found), len(digits), len(groups), luhn(digits) if 12 <= len(digits) <= 19 else 0, found[:1] == "+", "(" in found, found.count("-"), found.count("."), found.count(" "), found.count("/"),
        max(map(len, groups), default=0), min(map(len, groups), default=0), max(parts, default=0), len(set(digits)) / max(len(digits), 1), "@" in found, "(at)" in found or "[at]" in found, found.rpartition(".")[2].isalpha(),
        sum(c.isalpha() for c in found) / max(len(found), 1), left.isalnum(), right.isalnum(), left in "\"'=:/", right in "\"'=:/", left == "." or right in ".%", any(h in before for h in _HINT[kind]), any(h in before + after for k in KINDS if k != kind for h in _HINT[k]),
        len(groups[0]) if groups else 0, len(groups[-1]) if groups else 0, len(set(re.findall(r"[0-9]([^0-9]{1,2})(?=[0-9])", found))), left in ("-", "+"), bool(_COUNTRY.search(before)),
    ]


N_FEATURES = 31


@dataclass
class BoostedTrees:
    """Logistic gradient boosting of oblivious trees: one test per level, 2^depth leaves."""

    rounds: int = 80
    depth: int = 4
    rate: float = 0.2
    n_bins: int = 24
    start: float = 0.0
    trees: list[tuple[list[tuple[int, float]], np.ndarray]] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, edges: list[np.ndarray] | None = None) -> BoostedTrees:
        """weight says how many rows each row stands for; edges are the values that tests compare a feature with."""
        weight = np.ones(len(y)) if weight is None else weight
        edges = edges or [np.unique(np.quantile(c, self.cuts())) for c in x.T]
        codes = [np.searchsorted(e, c) for e, c in zip(edges, x.T, strict=True)]  # x > edges[j] where the code is over j
        mean = float(weight @ y / weight.sum())
        self.start = float(np.log((mean + 1e-6) / (1 - mean + 1e-6)))
        margin = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = weight * (y - p), weight * np.maximum(p * (1 - p), 1e-6)
            leaf, tests = np.zeros(len(y), np.int64), []
            for level in range(self.depth):
                gains = [(float(g), f, float(t)) for f, e in enumerate(edges) for g, t in zip(self._gains(leaf, codes[f], grad, hess, 1 << level, len(e)), e, strict=True)]
                tests.append(max(gains, default=(0, 0, np.inf))[1:])
                leaf = leaf * 2 + (x[:, tests[-1][0]] > tests[-1][1])
            n = 1 << self.depth
            value = self.rate * np.bincount(leaf, grad, n) / (np.bincount(leaf, hess, n) + 1)
            self.trees.append((tests, value))
            margin += value[leaf]
        return self

    def cuts(self) -> list[float]:
        """The quantiles of a feature that are its edges."""
        return np.linspace(0, 1, self.n_bins + 1)[1:-1].tolist()

    @staticmethod
    def _gains(leaf: np.ndarray, code: np.ndarray, grad: np.ndarray, hess: np.ndarray, leaves: int, edges: int) -> np.ndarray:
        """What every edge of a feature would gain, from sums by leaf and code."""
        at, shape = leaf * (edges + 1) + code, (leaves, edges + 1)
        g, h = (np.cumsum(np.bincount(at, v, leaves * (edges + 1)).reshape(shape), axis=1) for v in (grad, hess))
        right = (g[:, -1:] - g[:, :-1]) ** 2 / (h[:, -1:] - h[:, :-1] + 1)
        return (g[:, :-1] ** 2 / (h[:, :-1] + 1) + right).sum(axis=0)

    def predict(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.start)
        for tests, value in self.trees:
            leaf = np.zeros(len(x), np.int64)
            for f, t in tests:
                leaf = leaf * 2 + (x[:, f] > t)
            margin += value[leaf]
        return 1 / (1 + np.exp(-margin))


def lowest_precise_threshold(score: np.ndarray, y: np.ndarray, precision: float, weight: np.ndarray | None = None) -> float:
    """The lowest score from which on the share of positives is at least precision; over 1 if none is."""
    order = np.argsort(-score, kind="stable")
    weight = np.ones(len(y)) if weight is None else weight
    right = np.cumsum((weight * y)[order]) / np.cumsum(weight[order])
    last = np.r_[score[order][1:] != score[order][:-1], True] if len(y) else np.zeros(0, bool)  # ties stand together
    fits = np.flatnonzero((right >= precision) & last)
    return float(score[order][fits[-1]]) if len(fits) else 2.0


@dataclass
class PiiModel:
    trees: BoostedTrees
    thresholds: dict[str, float]

    def added(self, text: str, base: list[Span]) -> list[Span]:
        taken = covered(text, base)
        found = [s for s in candidates(text) if taken.find(1, s[0], s[1]) < 0]
        if not found:
            return []
        score = self.trees.predict(np.array([features(text, s) for s in found], float))
        out: list[Span] = []
        for i in np.argsort(-score, kind="stable"):
            s = found[i]
            if score[i] >= self.thresholds[s[2]] and taken.find(1, s[0], s[1]) < 0:
                out.append(s)
                taken[s[0] : s[1]] = b"\1" * (s[1] - s[0])
        return out

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """Spans of the rules, and all spans, both by start and then kind."""
        base = base_spans(text)
        return base, sorted([*base, *self.added(text, base)], key=lambda s: (s[0], KINDS.index(s[2])))


def _rewritten(kind: str, found: str) -> list[tuple[str, bool]]:
    """Other ways to write what a rule accepts, and wrong ones."""
    digits = _NOT_DIGIT.sub("", found)
    if kind == "email":
        local, _, domain = found.partition("@")
        plain = re.sub("[0-9]+", "", local).strip("._%+-") or "jo"
        out = [(domain, False), (local + "@", False)]
        for name in (local, re.split("[._%+-]", plain)[0]):
            for host in (domain, ".".join(domain.split(".")[-2:])):
                out += [(f"{name} (at) {host}", True), (f"{name}[at]{host}".replace(".", "[dot]"), True), (f"{name} (at) {host.split('.')[0]}", False), (f"{name}@{host.split('.')[0]}", False)]
        return out
    if kind == "card":
        wrong = digits[:-1] + str((int(digits[-1]) + 1 + len(found) % 8) % 10)
        return [*((sign.join(digits[i : i + 4] for i in range(0, len(digits), 4)), True) for sign in ". -"), (wrong, luhn(wrong)), (digits[:9], False)]
    if kind == "phone":
        return [(f"({digits[-10:-7]}) {digits[-7:-4]}-{digits[-4:]}", True), (f"{digits[-10:-7]}-{digits[-7:-4]}-{digits[-4:]}", True), (f"+{digits[:-10]}/{digits[-10:-7]}/{digits[-7:]}", True), (f"+{10 + int(digits[-2:]) % 90}/{digits[-10:-7]}/{digits[-7:]}", True), (digits[-10:], False), (digits[-8:], False)]
    return [(found + ".7", False), (found.replace(".", ".9", 1) + "99", False), (found.rpartition(".")[0], False)]


def _is_card(found: str) -> bool:
    """Whether the rule accepts a stretch that is grouped as cards are: a stretch of other numbers
    also passes the check, one time in ten."""
    sizes = [len(g) for g in _GROUP.findall(found)]
    return rule_accepts("card", found) and (len(sizes) == 1 or sizes == [4, 6, 5] or set(sizes[:-1]) == {4} and sizes[-1] <= 4)


def _beside(kind: str, found: str) -> Iterator[tuple[str, Span, bool]]:
    """What a rule accepts, in its right forms, beside a date or itself, with every stretch of the
    two: only whole numbers are right."""
    digits = _NOT_DIGIT.sub("", found)
    day = f"20{digits[-2:]}-{int(digits[-3]) + 1:02}-{int(digits[-4]) + 10}"
    for k, form in enumerate([found, *(other for other, right in _rewritten(kind, found) if right)]):
        first = form if (k + len(digits) + int(digits[-1])) % 2 else day
        both = f"{first} {form}"
        whole = {(len(first) + 1, len(both), kind)} | ({(0, len(first), kind)} if first == form else set())
        for s in sorted({*candidates(both), *whole}):
            yield both, s, s in whole


def labelled(text: str) -> list[tuple[list[float], float]]:
    """Features and labels of a text's candidates, and of its rule spans written otherwise."""
    base = base_spans(text)
    known, taken = set(base), covered(text, base)
    out = []
    for s in candidates(text):
        if s in known or taken.find(1, s[0], s[1]) < 0:
            out.append((features(text, s), float(s in known or s[2] == "card" and _is_card(text[s[0] : s[1]]))))
    for a, b, kind in base:
        for other, right in _rewritten(kind, text[a:b]):
            changed = text[max(0, a - 30) : a] + other + text[b : b + 30]
            at = min(a, 30)
            out.append((features(changed, (at, at + len(other), kind)), float(right)))
        for both, (i, j, k), right in _beside(kind, text[a:b]) if kind in ("card", "phone") else ():
            alone = ord(both[-2]) % 2  # as in a column of numbers
            lead = "" if alone else text[max(0, a - 30) : a]
            out.append((features(lead + both + ("" if alone else text[b : b + 30]), (len(lead) + i, len(lead) + j, k)), float(right)))
    return out


def labelled_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(x, y, fit, n): how often each row of features and label occurs in the labelled candidates of all documents, for the
    documents that trees are fitted on (a half, by hash of the id) and the others."""
    schema = pa.schema([("x", pa.list_(pa.float64())), ("y", pa.float64()), ("fit", pa.bool_())])

    def rows(batches):
        for batch in batches:
            for b in slices(batch, 1, 1 << 20):
                found = [(x, y, h) for h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for x, y in labelled(t)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True) if found else ([], [], []), schema, strict=True)], schema=schema)

    fit = F.pmod(F.shiftright(F.xxhash64(F.col(id_col), F.lit(5)), 7), F.lit(2)) == 0
    texts = docs.select(fit.alias("fit"), F.col(text_col).cast("string").alias("text")).dropna()
    return texts.mapInArrow(rows, "x array<double>, y double, fit boolean").groupBy("x", "y", "fit").agg(F.count("*").alias("n"))


def rounded_up(counts: DataFrame, edges: list[np.ndarray]) -> DataFrame:
    """(kind, x, y, fit, n): counts with every feature raised to its next edge, infinity above the last. Trees that test
    against edges alone can't tell such rows apart, so these few are as good as all."""
    schema = pa.schema([("kind", pa.int64()), ("x", pa.list_(pa.float64())), ("y", pa.float64()), ("fit", pa.bool_()), ("n", pa.int64())])

    def rows(batches):
        for b in batches:
            x = b.column(0).flatten().to_numpy().reshape(b.num_rows, len(edges))
            up = np.stack([np.r_[e, np.inf][np.searchsorted(e, c)] for e, c in zip(edges, x.T, strict=True)], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0].astype(np.int64)), pa.array(list(up), schema.field("x").type), *(b.column(k) for k in (1, 2, 3))], schema=schema)

    raised = counts.mapInArrow(rows, "kind long, x array<double>, y double, fit boolean, n long")
    return raised.groupBy("kind", "x", "y", "fit").agg(F.sum("n").alias("n"))


def fit_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = 0.99) -> PiiModel:
    """Trees from one half of the labelled candidates of all documents, thresholds from the other. What reaches the driver:
    edges, and the distinct rows of features between edges with their counts. Null and empty texts give none, repeated
    rows theirs each; other columns are ignored. Without any candidate, as for an empty table, nothing is ever added."""
    never, trees = PiiModel(BoostedTrees(), dict.fromkeys(KINDS, 2.0)), BoostedTrees()
    counts = written(labelled_counts(docs, id_col, text_col), "pii-counts")
    values = counts.filter("fit").select(F.posexplode("x").alias("feature", "v"), "n")
    cuts = F.percentile("v", F.array(*map(F.lit, trees.cuts())), F.col("n"))
    edges = {r.feature: np.unique(r.edges) for r in values.groupBy("feature").agg(cuts.alias("edges")).collect()}
    if not edges:
        deleted(counts)
        return never
    edges = [edges[k] for k in range(N_FEATURES)]
    table = rounded_up(counts, edges).toPandas()
    deleted(counts)
    x, fit = np.array(table["x"].tolist(), float), table["fit"].to_numpy(bool)
    kind, y, n = (table[c].to_numpy(float) for c in ("kind", "y", "n"))
    order = np.lexsort((fit, y, kind, *x.T))  # sums in one order
    x, y, n, kind, fit = x[order], y[order], n[order], kind[order], fit[order]
    if not 0 < n[fit] @ y[fit] < n[fit].sum():
        return never
    trees.fit(x[fit], y[fit], n[fit], edges)
    score = trees.predict(x[~fit])
    return PiiModel(trees, {k: max(0.5, lowest_precise_threshold(score[own], y[~fit][own], precision, n[~fit][own])) for i, k in enumerate(KINDS) for own in [kind[~fit] == i]})


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
_SPANS_DDL = "array<struct<start:bigint,end:bigint,kind:string>>"


def pii_spans(docs: DataFrame, model: PiiModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, base (spans of the rules), spans (all spans), in code
    points, end exclusive. Null and empty texts have none; repeated rows each give a row; an
    empty table gives no rows; other columns are ignored; long texts are read whole. An id is
    cast to long."""
    schema = pa.schema([("doc_id", pa.int64()), ("base", _SPANS), ("spans", _SPANS)])
    pack = lambda spans: [{"start": a, "end": b, "kind": k} for a, b, k in spans]

    def make(batch: pa.RecordBatch) -> dict:
        found = [model.spans(t or "") for t in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "base": [pack(b) for b, _ in found], "spans": [pack(s) for _, s in found]}

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(by_batch(make, schema), f"doc_id long, base {_SPANS_DDL}, spans {_SPANS_DDL}")


def redact(text: str, spans: list[Span]) -> str:
    """text with every span replaced by its kind; overlapping spans give one, of the first kind."""
    out, last = [], 0
    for start, end, kind in spans:
        if start >= last:
            out += [text[last:start], f"[{kind.upper()}]"]
        last = max(last, end)
    return "".join([*out, text[last:]])


def redact_docs(docs: DataFrame, model: PiiModel, text_col: str = "text") -> DataFrame:
    """docs with redacted texts, all other columns as they are, whatever their names. Null texts stay
    null, empty ones empty; repeated rows stay; long texts are read whole; an empty table gives no rows."""

    def run(batches):
        for batch in batches:
            i = batch.schema.get_field_index(text_col)
            for b in slices(batch, i, 8 << 20):
                texts = [t and redact(t, model.spans(t)[1]) for t in b.column(i).to_pylist()]
                yield b.set_column(i, b.schema.field(i), pa.array(texts, b.schema.field(i).type))

    return docs.mapInArrow(run, docs.schema)
