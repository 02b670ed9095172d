"""Eigenvector refinement on clustered spectra, and whitening against plain numpy with exact integers."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumora.llm import queries, whiten

EDGE = "vec_id long, embedding array<float>"


def spectrum(values, seed=3):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))[0].astype(np.longdouble)
    m = (q * np.array(values, np.longdouble)) @ q.T
    return (m + m.T) / 2


@pytest.mark.parametrize(
    "values",
    [
        np.linspace(1, 9, 64),
        np.r_[np.ones(10), 1 + 1e-9 * np.arange(10), 1 + 1e-13 * np.arange(10), np.linspace(2, 3, 34)],
        np.r_[np.full(20, 2.0), np.full(20, 1.0)],
        np.r_[1e12, 1e6, 1.0, np.zeros(5)],
        [4.0],
    ],
)
def test_refined(values):
    a = spectrum(values)
    got, x = whiten.refined(a)
    wide = x.astype(np.longdouble)
    assert np.abs(wide.T @ wide - np.eye(len(a))).max() < 1e-15
    assert np.abs(a @ wide - wide * got).max() < 1e-15 * np.abs(a).max() * 4
    assert (np.diff(got) <= 0).all() and np.allclose(got, sorted(values, reverse=True), rtol=0, atol=1e-14 * max(values))


def test_vectors_of_close_eigenvalues_are_right():
    """Gaps of 1e-10: the true vectors are known, float64 alone misses them by 1e-6."""
    q = np.linalg.qr(np.random.default_rng(8).standard_normal((12, 12)))[0].astype(np.longdouble)
    for _ in range(3):
        q = q + q @ ((np.eye(12) - q.T @ q) / 2)
    values = 1 + np.arange(12, dtype=np.longdouble) * np.longdouble(1e-10)
    a = (q * values) @ q.T
    _, x = whiten.refined((a + a.T) / 2)
    match = np.abs(x.T @ q[:, ::-1].astype(float))
    assert np.abs(match - np.eye(12)).max() < 1e-7


def plain(rows, most=16):
    good = [(k, v) for k, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    xs = [tuple(int(np.floor(np.float64(np.float32(c)) * 64)) + 1_000_000 for c in v) for _, v in good]
    fit = sorted(set(xs))
    n, width = len(fit), len(fit[0])
    sums = [sum(x[i] for x in fit) for i in range(width)]
    d = np.array([[float(Fraction(n * x[i] - sums[i], n)) for i in range(width)] for x in fit])
    v = d.T @ d / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(most, int((values > 1e-12 * values[0]).sum()))
    out = []
    for (key, _), x in zip(good, xs):
        c = np.array([float(Fraction(n * x[i] - sums[i], n)) for i in range(width)])
        w = c @ (vectors[:, :k] / np.sqrt(values[:k]))
        out.append((key, sum((n * x[i] - sums[i]) ** 2 for i in range(width)), w))
    return n, out, values[:k] / v.trace()


def held(got, rows):
    n, want, share = plain(rows)
    k = len(share)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    by = {}
    for r in got:
        assert r["n"] == n and abs(r["explained"] - share[r["component"] - 1]) < 1e-10 and r["identity_error"] < 1e-10
        by.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], []).append(r["whitened"])
    assert len(got) == k * len(want) and set(by) == {(a, b) for a, b, _ in want}
    sign = np.ones(k)
    first = max(want, key=lambda r: np.abs(r[2]).min())
    sign = np.sign([by[first[:2]][j + 1][0] * first[2][j] for j in range(k)])
    for a, b, w in sorted(want, key=key):
        assert np.allclose([by[a, b][j + 1][0] for j in range(k)], w * sign, rtol=1e-7, atol=1e-7)


def test_equals_plain_numpy(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    held(queries.op13_whitening(spark, sf).collect(), rows)


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(k, [float(np.float32(c)) for c in rng.standard_normal(5)]) for k in range(60)]
    rows += [rows[3]] * 30 + [(None, rows[4][1]), (None, rows[4][1]), (70, None), (71, [1.0, None, 2.0, 3.0, 4.0]), (72, [float("nan")] * 5), (73, [float("inf"), 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, EDGE).repartition(4)
    out = whiten.whitened(df).withColumnRenamed("id", "vec_id").collect()
    held(out, rows)
    other = df.unionByName(spark.createDataFrame([(80, [1.0]), (81, [])], EDGE)).select("*", *(F.lit(2).alias(c) for c in "id x v n k place value component".split()))
    again = whiten.whitened(other).withColumnRenamed("id", "vec_id").collect()
    assert {(r["vec_id"], r["component"], r["deviation"]) for r in again} == {(r["vec_id"], r["component"], r["deviation"]) for r in out} and len(again) == len(out)
    assert whiten.whitened(df.limit(0)).count() == 0 and whiten.whitened(df.where("vec_id = 3")).count() == 0
    flat = spark.createDataFrame([(k, [float(k), 2.0 * k, 7.0]) for k in range(9)], EDGE)
    got = whiten.whitened(flat).collect()
    assert {r["component"] for r in got} == {1} and len(got) == 9 and abs(got[0]["explained"] - 1) < 1e-12


def test_large_entries_are_summed_exactly():
    m = np.array([[10**9 + 1, -3], [7, 10**9]], np.int64)
    assert whiten._exact_gram(m).tolist() == (m.astype(object).T @ m.astype(object)).tolist()
    small = np.random.default_rng(1).integers(-3000, 3000, (5000, 4))
    assert whiten._exact_gram(small).tolist() == (small.T @ small).tolist()
