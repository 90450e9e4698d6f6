"""Quality classifier: random Fourier features over document statistics, ridge scores from
partition-summed normal equations, isotonic calibration.

Statistics come from the whole text only. The model has a fixed size, so it travels with the
tasks. The fit uses ``max_labels`` labelled rows at most, by hash of their id (a documented
bound on the sample); means and deviations of the statistics cover all documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, slices, utf8, written

_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[]_{|}~"
STATISTICS = ("words", "word_len", "word_len_dev", "distinct", "distinct_pairs", "dup_lines", "line_len", "upper", "lower", "digit", "space", "newline", "beyond_ascii", "entropy", *(f"mark_{c}" for c in _MARKS))


def statistics(text: bytes | None) -> list[float]:
    """The statistics of one text; all are finite, also for an empty one."""
    text = text or b""
    words, lines = text.split(), text.split(b"\n")
    n, size = max(len(words), 1), max(len(text), 1)
    lens = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    share = np.bincount(np.frombuffer(text, np.uint8), minlength=256) / size
    some = share[share > 0]
    return [
        np.log1p(len(words)), lens.mean(), lens.std(), len(set(words)) / n, len(set(zip(words, words[1:], strict=False))) / n,
        1 - len(set(lines)) / len(lines), np.log1p(size / len(lines)), share[65:91].sum(), share[97:123].sum(), share[48:58].sum(), share[32], share[10], share[128:].sum(),
        float(-(some * np.log2(some)).sum()), *(np.sqrt(share[c]) for c in _MARKS),
    ]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x): the statistics of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float64()))])
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(by_batch(lambda b: {"doc_id": b.column(0), "x": [statistics(t) for t in utf8(b.column(1))]}, schema), "doc_id long, x array<double>")


def in_held_out(id_col: str = "doc_id") -> F.Column:
    """Whether a row is held out: crc32 of its id as text, modulo 5, is 0. Never for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass
class Kernel:
    """phi(x): cosines of random projections of the standardised statistics, and 1."""

    mean: np.ndarray
    dev: np.ndarray
    n_features: int = 240
    seed: int = 11

    def phi(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(self.seed)
        d = len(self.mean)
        w = rng.normal(0, 1 / np.sqrt(d), (d, self.n_features))
        shift = rng.uniform(0, 2 * np.pi, self.n_features)
        z = np.clip((x - self.mean) / self.dev, -8, 8)
        return np.hstack([np.sqrt(2 / self.n_features) * np.cos(z @ w + shift), np.ones((len(z), 1))])


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: centres and values of the blocks of the best rising fit."""
    blocks: list[list[float]] = []
    for i in np.argsort(x, kind="stable"):
        blocks.append([x[i] * weight[i], y[i] * weight[i], weight[i]])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    b = np.array(blocks)
    return b[:, 0] / b[:, 2], b[:, 1] / b[:, 2]


@dataclass
class QualityModel:
    kernel: Kernel
    weights: np.ndarray
    at: np.ndarray
    value: np.ndarray
    threshold: float = 0.3

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated scores, between the block centres by straight lines, so that order is kept."""
        return np.clip(np.interp(self.kernel.phi(x) @ self.weights, self.at, self.value), 0, 1)


def fit_quality(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", ridge: float = 1e-3, max_labels: int = 200_000, n_sums: int = 16, n_bins: int = 2048, threshold: float = 0.3) -> QualityModel:
    """Ridge weights from the rows of folds 1 to 3, calibration from those of fold 4; fold 0 is
    held out. A fold is crc32 of the id as text, modulo 5.

    Labels that are null or of unknown ids are skipped; where an id repeats in them, the mean
    decides, and where it has several texts, the one with the least statistics stands for it.
    Without any label every score is 0.5; with one class only, that class."""
    d = len(STATISTICS)
    moment = stats.select(*(F.col("x")[i].alias(f"x{i}") for i in range(d))).agg(*(f(f"x{i}") for i in range(d) for f in (F.avg, F.stddev_pop))).first()
    known = np.array([v or 0.0 for v in moment]).reshape(d, 2)
    kernel = Kernel(known[:, 0], np.where(known[:, 1] > 1e-9, known[:, 1], 1.0))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    marked = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y")).dropna().groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("double").alias("y"))
    marked = written(marked.withColumn("fold", fold).filter("fold <> 0"), "labels")
    n = marked.count()
    if n > max_labels:
        marked = marked.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * max_labels / n))
    known_rows = stats.join(marked, "doc_id").groupBy("doc_id", "fold", "y").agg(F.min("x").alias("x"))
    rows = written(known_rows.select("fold", "x", "y"), "training")
    size = kernel.n_features + 1

    def sums(batches):
        gram, moment = np.zeros((size, size)), np.zeros(size)
        for b in batches:
            if b.num_rows:
                p = kernel.phi(np.array(b.column(0).to_pylist()))
                gram += p.T @ p
                moment += p.T @ b.column(1).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array([np.r_[gram.ravel(), moment]], pa.list_(pa.float64()))], names=["s"])

    total = np.zeros(size * size + size)
    for r in rows.filter("fold < 4").select("x", "y").repartition(n_sums).mapInArrow(sums, "s array<double>").toLocalIterator():
        total += np.array(r.s)
    gram, moment = total[: size * size].reshape(size, size), total[size * size :]
    count = max(gram[-1, -1], 1.0)
    weights = np.linalg.solve(gram + ridge * count / size * np.eye(size) + 1e-9 * np.eye(size), moment)

    schema = pa.schema([("bin", pa.int64()), ("y", pa.float64())])
    binned = rows.filter("fold = 4").select("x", "y").mapInArrow(
        by_batch(lambda b: {"bin": np.clip(np.round(kernel.phi(np.array(b.column(0).to_pylist())) @ weights * n_bins), -n_bins, 2 * n_bins).astype(np.int64), "y": b.column(1)}, schema), "bin long, y double"
    )
    got = np.array(binned.groupBy("bin").agg(F.avg("y"), F.count("*").cast("double")).collect(), float).reshape(-1, 3)  # n_bins * 3 rows at most
    if not len(got):
        got = np.array([[0.0, 0.5 if not n else moment[-1] / count, 1.0]])
    return QualityModel(kernel, weights, *isotonic(got[:, 0] / n_bins, got[:, 1], got[:, 2]), threshold)


def score_quality(stats: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of document_statistics()."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
    scored = stats.mapInArrow(by_batch(lambda b: {"doc_id": b.column("doc_id"), "score": model.score(np.array(b.column("x").to_pylist()))}, schema), "doc_id long, score double")
    return scored.select("doc_id", in_held_out().alias("held_out"), "score", (F.col("score") >= model.threshold).cast("int").alias("predicted"))


def classify_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of every row of docs by a model fitted to its labelled rows. Null texts count as
    empty; repeated rows each get their score; an empty table gives no rows; other columns
    (also label, lang or source) are never read."""
    stats = written(document_statistics(docs, id_col, text_col), "statistics")
    return score_quality(stats, fit_quality(stats, labels))


def keep_good(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """The rows of docs that the model accepts, in one narrow pass with all their columns, whatever
    their names. Null and empty texts are judged as empty ones; repeated rows all stay or all go;
    long texts are read whole; an empty table gives no rows."""

    def run(batches):
        for batch in batches:
            i = batch.schema.get_field_index(text_col)
            for b in slices(batch, i, 8 << 20):
                x = np.array([statistics(t) for t in utf8(b.column(i))])
                yield b.filter(pa.array(model.score(x) >= model.threshold))

    return docs.mapInArrow(run, docs.schema)
