import numpy as np
import pytest
from pyspark.sql import functions as F

from threadline.llm import whitening as W
from threadline.llm.common import table


def scatter(m):
    c = m - m.mean(0)
    return c.T @ c


@pytest.mark.parametrize(("dim", "n"), [(1, 5), (2, 7), (5, 3), (8, 200), (24, 300)])
def test_updates_and_joins_against_the_scatter(dim, n):
    rng = np.random.default_rng(dim)
    m = (rng.normal(size=(n, dim)) * rng.uniform(1, 300, dim)).astype(np.int64)
    if dim == 8:  # copies and equal columns: zero and equal eigenvalues
        m[50:150], m[:, 2], m[:, 4] = m[3], m[:, 1], 0
    parts = [W.Spectrum(dim) for _ in range(3)]
    for part, rows in zip(parts, (m[: n // 3], m[n // 3 : n // 2], m[n // 2 :]), strict=True):
        part.add(rows)
    whole = W.Spectrum(dim)
    for part in parts:
        whole.join(part)
    s = scatter(m)
    assert whole.n == n and whole.sums == m.sum(0).tolist()
    np.testing.assert_allclose(whole.vectors @ np.diag(whole.values) @ whole.vectors.T, s, atol=1e-11 * np.abs(s).max())
    np.testing.assert_allclose(whole.vectors.T @ whole.vectors, np.eye(dim), atol=1e-12)
    back = W.Spectrum.of(whole.row(0))
    assert back.sums == whole.sums and (back.vectors == whole.vectors).all()


def test_secular_roots_stay_between_poles():
    rng = np.random.default_rng(1)
    for k in (1, 2, 3, 40):
        d, z = np.cumsum(10.0 ** rng.uniform(-6, 3, k)), 10.0 ** rng.uniform(-4, 2, k)
        origin, x = W.secular_roots(d, z)
        roots = d[origin] + x
        assert (roots >= d).all() and (roots[:-1] <= d[1:]).all()
        np.testing.assert_allclose(roots, np.linalg.eigvalsh(np.diag(d) + np.outer(z, z)), rtol=1e-9, atol=1e-12 * roots[-1])


def plain(rows):
    kept = [(i, v) for i, v in rows if v is not None and all(e is not None and np.isfinite(e) for e in v)]
    x = np.floor(1024 * np.array([v for _, v in kept], float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    c = x - x.mean(0)
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1][:8], vectors[:, ::-1][:, :8]
    return kept, ((n * x - s) ** 2).sum(1), c @ vectors / np.sqrt(values), values / np.trace(c.T @ c / n)


def test_query_against_plain_eigenvectors(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    kept, deviation, white, explained = plain([(r.vec_id, r.embedding) for r in rows.orderBy("vec_id").collect()])
    found = W.whiten(rows.repartition(37)).orderBy("vec_id", "component").toPandas()
    k = white.shape[1]
    assert found["vec_id"].tolist() == [i for i, _ in kept for _ in range(k)] and found["component"].tolist() == list(range(1, k + 1)) * len(kept)
    assert found["deviation"].tolist()[::k] == deviation.tolist()
    got = found["whitened"].to_numpy().reshape(-1, k)
    np.testing.assert_allclose(got * np.sign((got * white).sum(0)), white, atol=1e-8)
    np.testing.assert_allclose(found["explained"][:k], explained, rtol=1e-9)
    assert found["identity_error"].max() < 1e-9


def test_awkward_vectors(spark):
    rows = [(1, [1.0, 2.0]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, []), (7, [1.0, 2.0, 3.0]), (None, [0.5, -1.0]), (8, [1.0, 2.0]), (8, [1.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("clash") for c in ("x", "n", "place", "values", "part")})
    out = W.whiten(frame).orderBy(F.col("vec_id").asc_nulls_first(), "component").collect()
    assert [(r.vec_id, r.component) for r in out] == [(i, c) for i, k in ((None, 1), (1, 1), (8, 2)) for c in (1, 2) for _ in range(k)]
    assert all(r.whitened is None and r.explained == 0 for r in out if r.component == 2)  # four vectors on one line
    assert {r.n for r in out} == {4} and out[0].identity_error < 1e-9
    assert W.whiten(frame.filter("vec_id = 99")).collect() == [] and W.whiten(frame.filter("vec_id = 6")).collect() == []
    one = W.whiten(frame.filter("vec_id = 1")).collect()
    assert [(r.deviation, r.whitened) for r in one] == [(0, None)] * 2


def test_large_deviations_are_exact(spark):
    frame = spark.createDataFrame([("a", [1e12]), ("b", [-3e11]), ("c", [1e300])], "vec_id string, embedding array<double>")
    y = [int(1e12 * 1024), int(-3e11 * 1024), 2**50]
    out = W.whiten(frame).orderBy("vec_id").collect()
    assert [r.deviation_digits for r in out] == [str((3 * v - sum(y)) ** 2) for v in y] and [r.deviation for r in out] == [None] * 3
