"""Whitening of embeddings by an incremental eigendecomposition.

Every partition keeps (n, mean, eigenvectors, eigenvalues) of the scatter of its rows and applies a centred
rank-one update a row: the secular equation gives the new eigenvalues, deflation leaves out what
doesn't move. Spectra of partitions are combined in groups, as successive rank-one updates, in
rounds, until one is left. The basis found is then refined by Rayleigh-Ritz: the covariance is
projected on it in one more pass over all rows, and its small eigenproblem turns the basis."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_batch, deleted, written

#: The scale and offset of whole numbers; entries beyond the bound count as the bound.
SCALE, OFFSET, BOUND = 1024.0, 100_000, 2.0**40
FAN = 16  # spectra that are combined at once
SPECTRUM = "part long, n long, mean array<double>, vectors array<double>, values array<double>, sums array<string>"
_EPS = np.finfo(float).eps


# ---- rank-one updates


def secular_roots(d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The roots x of 1 + sum(z^2 / (d - x)) = 0 for increasing d and no z of zero, as (index of the nearer pole, distance
    from it): one in each gap, the last within |z|^2 past the last pole. All are found side by side by
    rational steps between two poles, with a bracket that every step narrows."""
    k, w = len(d), z * z
    norm = float(w.sum())
    if k == 1:
        return np.zeros(1, np.int64), w.copy()
    gap = np.append(np.diff(d), norm)
    left = np.arange(k)
    middle = 1 + (w[:, None] / (d[:, None] - (d + gap / 2)[None, :])).sum(0)
    origin = np.where((middle < 0) & (left < k - 1), left + 1, left)
    delta = d[:, None] - d[origin][None, :]
    low = np.where(origin > left, -gap / 2, np.where(middle < 0, gap / 2, 0.0))
    high = np.where(origin > left, 0.0, np.where(middle < 0, gap, gap / 2))
    x = (low + high) / 2
    p, q = np.minimum(left, k - 2), np.minimum(left, k - 2) + 1
    below = left[:, None] <= p[None, :]
    for _ in range(80):
        away = delta - x
        away[away == 0] = _EPS * _EPS
        part = w[:, None] / away
        f = 1 + part.sum(0)
        size = 1 + np.abs(part).sum(0)
        low, high = np.where(f < 0, x, low), np.where(f < 0, high, x)
        open_ = (np.abs(f) > 4 * _EPS * size) & (high - low > 2 * _EPS * np.maximum(np.abs(low), np.abs(high)))
        if not open_.any():
            break
        slope = part / away
        one, two = (slope * below).sum(0), (slope * ~below).sum(0)
        a1, a2 = away[p, left], away[q, left]
        c = f - a1 * one - a2 * two
        a, b = (a1 + a2) * f - a1 * a2 * (one + two), a1 * a2 * f
        root = np.sqrt(np.abs(a * a - 4 * b * c))
        with np.errstate(all="ignore"):
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        step = np.where(np.isfinite(step) & (step * f < 0), step, -f / (one + two))
        new = x + step
        x = np.where(open_, np.where((new > low) & (new < high), new, (low + high) / 2), x)
    return origin, x


def rank_one(values: np.ndarray, vectors: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (increasing) and eigenvectors (columns) of vectors diag(values) vectors^T + v v^T.

    Deflation: directions in which v is negligible stay; of (nearly) equal eigenvalues a reflection leaves
    one direction to be moved."""
    z = vectors.T @ v
    norm = float(z @ z)
    if norm == 0:
        return values, vectors
    scale = max(float(values[-1]), norm)
    close = np.diff(values) <= 8 * _EPS * scale
    if close.any():
        vectors, z = vectors.copy(), z.copy()
        edges = np.flatnonzero(np.diff(np.concatenate(([0], close.view(np.int8), [0]))))
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            part = z[a : b + 1]
            length = float(np.linalg.norm(part))
            if length <= _EPS * np.sqrt(norm):
                continue
            u = part.copy()
            u[-1] += np.copysign(length, u[-1])
            block = vectors[:, a : b + 1]
            vectors[:, a : b + 1] = block - np.outer(block @ u, 2 * u / float(u @ u))
            last = -np.copysign(length, part[-1])
            z[a : b + 1] = 0
            z[b] = last
    moving = np.flatnonzero(np.abs(z) * np.sqrt(norm) > 8 * _EPS * scale)
    if not len(moving):
        return values, vectors
    d, w = values[moving], z[moving]
    origin, x = secular_roots(d, w)
    away = (d[:, None] - d[origin][None, :]) - x[None, :]  # pole minus root, each from its own origin
    k = len(d)
    gaps = np.ones((k, k))
    i, j = np.indices((k, k))
    diff = lambda a: a[None, :] - d[:, None]
    gaps = np.where(j < i, diff(d), np.where(j < k - 1, diff(np.append(d[1:], 0.0)), 1.0))
    near = np.sqrt(np.abs(np.prod(-away / gaps, axis=1))) * np.sign(w)  # the z that these roots solve exactly
    away[away == 0] = _EPS * _EPS
    turn = near[:, None] / away
    turn /= np.sqrt((turn * turn).sum(0))
    new_values, new_vectors = values.copy(), vectors.copy()
    new_values[moving] = d[origin] + x
    new_vectors[:, moving] = vectors[:, moving] @ turn
    order = np.argsort(new_values, kind="stable")
    return new_values[order], new_vectors[:, order]


class Spectrum:
    """n, mean, and eigenpairs of the scatter of some rows (whole numbers less OFFSET); sums are exact."""

    def __init__(self, dim: int):
        self.n, self.mean, self.vectors, self.values, self.sums = 0, np.zeros(dim), np.eye(dim), np.zeros(dim), [0] * dim

    def add(self, rows: np.ndarray) -> None:
        """rows: int64 below 2^51 in magnitude."""
        for at in range(0, len(rows), 2048):
            self.sums = [s + int(x) for s, x in zip(self.sums, rows[at : at + 2048].sum(0), strict=True)]
        for y in rows.astype(float):
            off = y - self.mean
            self.values, self.vectors = rank_one(self.values, self.vectors, off * np.sqrt(self.n / (self.n + 1)))
            self.n += 1
            self.mean = self.mean + off / self.n

    def join(self, other: Spectrum) -> None:
        """The rows of other too: a rank-one update for each of its eigenpairs and one for the means."""
        if other.n and self.n:
            for value, vector in zip(other.values, other.vectors.T, strict=True):
                if value > 0:
                    self.values, self.vectors = rank_one(self.values, self.vectors, vector * np.sqrt(value))
            off = other.mean - self.mean
            self.values, self.vectors = rank_one(self.values, self.vectors, off * np.sqrt(self.n / (self.n + other.n) * other.n))
            self.mean = self.mean + off * (other.n / (self.n + other.n))
        elif other.n:
            self.mean, self.vectors, self.values = other.mean, other.vectors, other.values
        self.n += other.n
        self.sums = [a + b for a, b in zip(self.sums, other.sums, strict=True)]

    def row(self, part: int) -> dict:
        return {"part": part, "n": self.n, "mean": self.mean.tolist(), "vectors": self.vectors.ravel().tolist(), "values": self.values.tolist(), "sums": [str(x) for x in self.sums]}

    @classmethod
    def of(cls, row: dict) -> Spectrum:
        out = cls(len(row["mean"]))
        out.n, out.mean, out.values = int(row["n"]), np.array(row["mean"], float), np.array(row["values"], float)
        out.vectors, out.sums = np.array(row["vectors"], float).reshape(len(out.mean), -1), [int(x) for x in row["sums"]]
        return out


# ---- the fit


def whole_vectors(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, x) of the rows whose vector is neither null nor holds null, infinite or NaN entries; x has the whole
    numbers floor(1024 c), OFFSET less than the contract's."""
    c = F.col(vector)
    finite = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))
    kept = rows.select("vec_id", c.cast("array<double>").alias("c")).filter(F.col("c").isNotNull() & F.forall("c", finite))
    return kept.select("vec_id", F.transform("c", lambda e: F.floor(F.greatest(F.least(e, F.lit(BOUND)), F.lit(-BOUND)) * SCALE).cast("long")).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.int64, copy=False)


def spectra(vectors: DataFrame, dim: int) -> DataFrame:
    """A row of SPECTRUM for each partition of vectors(x) that has rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = Spectrum(dim)
        for batch in batches:
            own.add(_matrix(batch.column(0)))
        if own.n:
            row = own.row(TaskContext.get().partitionId())
            yield pa.RecordBatch.from_pandas(pd.DataFrame([row]), preserve_index=False)

    return vectors.select("x").mapInArrow(run, SPECTRUM)


def combined(rows: DataFrame) -> Spectrum | None:
    """The spectrum of all rows of SPECTRUM, FAN of them at a time in a task; each round is a written table. None
    without rows."""

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("part")
        first = Spectrum.of(frame.iloc[0])
        for k in range(1, len(frame)):
            first.join(Spectrum.of(frame.iloc[k]))
        return pd.DataFrame([first.row(int(frame["part"].iloc[0]) // FAN)])

    table = written(rows, "spectra")
    highest = table.agg(F.max("part")).first()[0]
    if highest is None:
        deleted(table)
        return None
    while highest > 0:
        following = written(table.groupBy(F.floor(F.col("part") / FAN).alias("group")).applyInPandas(join, SPECTRUM), "spectra")
        deleted(table)
        table, highest = following, highest // FAN
    out = Spectrum.of(table.first().asDict())
    deleted(table)
    return out


def _added(vectors: DataFrame, of_rows: object, size: int) -> np.ndarray:
    """The sum over all rows of of_rows(matrix): added up within each task, then by Spark, place by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            m = _matrix(batch.column(0))
            for at in range(0, len(m), 4096):
                total += of_rows(m[at : at + 4096]).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["total"])

    parts = vectors.select("x").mapInArrow(run, "total array<double>").select(F.posexplode("total").alias("place", "v"))
    return np.array([r.v for r in parts.groupBy("place").agg(F.sum("v").alias("v")).orderBy("place").collect()], float)


class Whitening:
    """n, sums (less OFFSET a row), the mean, and up to ``most`` components (rows, by falling eigenvalue) with their
    eigenvalues, the trace, and identity_error. Eigenvalues under 1e-12 of the trace count as zero."""

    def __init__(self, vectors: DataFrame, dim: int, most: int = 8):
        found = combined(spectra(vectors, dim))
        self.n, self.dim, self.sums = found.n, dim, found.sums
        self.mean = mean = np.array([s / found.n for s in found.sums])
        basis = np.linalg.qr(found.vectors)[0]

        def projected(m: np.ndarray) -> np.ndarray:
            p = (m - mean) @ basis
            return p.T @ p

        ritz = _added(vectors, projected, dim * dim).reshape(dim, dim) / found.n
        values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
        order = np.argsort(-values, kind="stable")[:most]
        self.trace, self.values = float(np.trace(ritz)), np.maximum(values[order], 0.0)
        self.components = (basis @ turn[:, order]).T
        self.real = self.values > 1e-12 * self.trace
        scaled = self.scaled()

        def moments(m: np.ndarray) -> np.ndarray:
            p = (m - mean) @ scaled.T
            return np.concatenate([p.sum(0)[None, :], p.T @ p])

        k = len(order)
        sums = _added(vectors, moments, (k + 1) * k).reshape(k + 1, k) / found.n
        off = np.abs(sums[1:] - np.outer(sums[0], sums[0]) - np.eye(k))[np.ix_(self.real, self.real)]
        self.identity_error = float(off.max()) if off.size else 0.0

    def scaled(self) -> np.ndarray:
        return np.where(self.real[:, None], self.components, 0.0) / np.sqrt(np.where(self.real, self.values, 1.0))[:, None]


def _deviations(m: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """The exact sums over dimensions of (n x - S)^2, in 64 bits where they surely fit."""
    most = max([n * int(np.abs(m).max(initial=0)), *(abs(s) for s in sums)])
    if most < 2**61 and 4 * most * most * len(sums) < 2**63:
        return (((n * m - np.array(sums, np.int64)) ** 2).sum(1)).tolist()
    return [sum((n * x - s) ** 2 for x, s in zip(row, sums, strict=True)) for row in m.tolist()]


def whiten(rows: DataFrame, vector: str = "embedding", most: int = 8) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for every row of rows(vec_id, vector) that
    has a whole vector, and each of up to ``most`` components.

    Rows whose vector is null or holds null, infinite or NaN entries are left out. The length of most vectors
    (the longer one on a tie) is the dimension; vectors of another length are left out, as they have no
    covariance with the others; vectors without entries give no rows. Entries beyond 2^40 count as 2^40.
    Ids may be null or repeated: rows are never joined. A component without variance has a null whitened
    value and 0 explained; a deviation that passes 64 bits is null, and stands as text in deviation_digits.
    Equal eigenvalues leave their components free to turn, but all rows see the same ones. An empty table
    gives no rows. A task holds one batch and a few matrices of the dimension's square."""
    vectors = whole_vectors(rows, vector)
    lengths = vectors.groupBy(F.size("x").alias("dim")).count().orderBy(F.col("count").desc(), F.col("dim").desc()).first()
    kind = rows.schema["vec_id"].dataType
    schema = f"vec_id {kind.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_digits string"
    if lengths is None or lengths["dim"] == 0:
        return rows.sparkSession.createDataFrame([], schema)
    dim = int(lengths["dim"])
    vectors = vectors.filter(F.size("x") == dim)
    fit = Whitening(vectors, dim, most)
    n, sums, mean, scaled, real, k = fit.n, fit.sums, fit.mean, fit.scaled(), fit.real, len(fit.values)

    def run(part: pa.RecordBatch) -> dict:
        m = _matrix(part.column(1))
        values = pa.array(((m - mean) @ scaled.T).ravel(), mask=np.tile(~real, len(m)))
        return {"vec_id": part.column(0), "digits": [str(x) for x in _deviations(m, n, sums)], "values": pa.ListArray.from_arrays(np.arange(0, k * len(m) + 1, k, np.int32), values)}

    of_rows = by_batch(run, pa.schema([("vec_id", _arrow(kind)), ("digits", pa.string()), ("values", pa.list_(pa.float64()))]))
    out = vectors.select("vec_id", "x").mapInArrow(of_rows, f"vec_id {kind.simpleString()}, digits string, values array<double>")
    out = out.select("vec_id", "digits", F.posexplode("values").alias("place", "whitened"))
    shares: Column = F.array(*[F.lit(float(v / fit.trace) if fit.trace else 0.0) for v in np.where(real, fit.values, 0.0)])
    return out.select(
        "vec_id", (F.col("place") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), F.expr("try_cast(digits as long)").alias("deviation"), "whitened",
        F.element_at(shares, F.col("place") + 1).alias("explained"), F.lit(fit.identity_error).alias("identity_error"), F.col("digits").alias("deviation_digits"),
    )


def _arrow(kind: object) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
