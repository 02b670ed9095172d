"""Pivot joins against brute force with counted comparisons, grouped assignment, histogram places, the table function."""

from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumora.functions import tables
from lumora.operators import analytics as A
from lumora.operators import vector_lists as L
from lumora.operators import vectors as V


def frame(spark, m, ids=None):
    ids = range(len(m)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(np.float32(x)) for x in v]) for i, v in zip(ids, m)], "asset_id long, vec array<float>").repartition(3)


def clumps(rng, centres, each, width, spread):
    c = rng.standard_normal((centres, width))
    m = (c[:, None] + spread * rng.standard_normal((centres, each, width))).reshape(-1, width)
    return m / np.linalg.norm(m, axis=1)[:, None]


def brute(m, least):
    m = m.astype(np.float32).astype(float)
    s = np.zeros((len(m), len(m)))
    for k in range(m.shape[1]):
        s += m[:, k][:, None] * m[:, k][None]
    return {(i, j) for i, j in zip(*np.nonzero(np.triu(s >= least, 1)))}


@pytest.mark.parametrize("least", [0.2, 0.9])
def test_near_vectors_are_exact_and_few_are_compared(spark, least):
    m = clumps(np.random.default_rng(3), 40, 40, 24, 0.08)
    df = frame(spark, m)
    got = {(r["a"], r["b"]) for r in V.near_vectors(df, least).collect()}
    assert got == brute(m, least)
    assert V.comparisons(df, 0.9) < len(m) ** 2 / 8


def test_near_vectors_with_copies_and_odd_rows(spark):
    rng = np.random.default_rng(5)
    m = np.concatenate([np.repeat(clumps(rng, 1, 1, 6, 0.0), 150, axis=0), rng.standard_normal((60, 6)) * 3])
    df = frame(spark, m).unionByName(spark.createDataFrame([(900, None), (None, [1.0] * 6)], "asset_id long, vec array<float>"))
    old, V.BLOCK = V.BLOCK, 32
    try:
        assert {(r["a"], r["b"]) for r in V.near_vectors(df, 0.95).collect()} == brute(m, 0.95)
    finally:
        V.BLOCK = old
    assert V.near_vectors(df.limit(0), 0.9).count() == 0


def test_rows_are_copied_to_few_pivots_where_all_are_near(spark):
    m = np.random.default_rng(11).standard_normal((900, 32))
    m /= np.linalg.norm(m, axis=1)[:, None]
    df = frame(spark, m)
    assert V._placed(df.select("asset_id", "vec"), 0.3, 4096)[0].count() <= 4 * len(m)
    got = [(r["a"], r["b"]) for r in V.near_vectors(df, 0.3).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(m, 0.3)


def test_reassigned_by_group(spark):
    rng = np.random.default_rng(7)
    new, old, want = [], [], {}
    for g in range(6):
        a, b = (rng.standard_normal((n, 4)) for n in (1 + g % 4, 1 + (g * 3) % 5))
        a, b = (x / np.linalg.norm(x, axis=1)[:, None] for x in (a, b))
        new += [(g, i, v.tolist()) for i, v in enumerate(a)]
        old += [(g, 10 + i, v.tolist()) for i, v in enumerate(b)]
        size = max(len(a), len(b))
        gain = np.zeros((size, size), int)
        gain[: len(a), : len(b)] = ((a @ b.T + 1) * 1e6).astype(int)
        want[g] = max(sum(gain[i, p[i]] for i in range(size)) for p in permutations(range(size))), a @ b.T, len(b)
    new.append((9, 4, [1.0, 0.0, 0.0, 0.0]))
    out = V.reassigned(spark.createDataFrame(new, "library long, label long, vec array<double>"), spark.createDataFrame(old, "library long, identity long, vec array<double>"), "library", -2.0).collect()
    for g, (total, sim, n) in want.items():
        rows = [r for r in out if r["library"] == g]
        assert len({r["identity"] for r in rows}) == len(rows) == len(sim)
        assert sum(int((sim[r["label"], r["identity"] - 10] + 1) * 1e6) for r in rows if r["identity"] < 10 + n) == total
    assert [(r["label"], r["identity"]) for r in out if r["library"] == 9] == [(4, 0)]
    strict = V.reassigned(spark.createDataFrame([(0, k, v) for k, v in enumerate(([1.0, 0.0], [0.0, 1.0], [-1.0, 0.0]))], "library long, label long, vec array<double>"), spark.createDataFrame([(0, 10, [1.0, 0.0]), (0, 11, [0.0, 1.0])], "library long, identity long, vec array<double>"), "library", 0.55)
    assert {r["label"]: r["identity"] for r in strict.collect()} == {0: 10, 1: 11, 2: 12}


def test_places_of_an_order(spark):
    rng = np.random.default_rng(1)
    for values in (rng.standard_normal(1000), np.r_[np.full(500, 3.25), rng.uniform(3.2499999999, 3.2500000001, 400)], [7.0], np.r_[-1e300, 1e-300, 0.0, 1e300, 5e-324]):
        df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(3)
        shares = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.95, "e": 1.0}
        got = A.placed_values(df, {k: ("v", p) for k, p in shares.items()}, slots=8)
        assert got == {k: sorted(values)[min(int(len(values) * p), len(values) - 1)] for k, p in shares.items()}
    assert A.bounds(spark.createDataFrame([(None, 1.0)], "lat double, lon double")).first()["lat_low"] is None
    assert A.fitted_view(A.bounds(spark.createDataFrame([], "lat double, lon double"))).first()["zoom"] == 1.0


def test_expand_detections(spark):
    tables.register(spark)
    rows = spark.sql("SELECT * FROM expand_detections(array(0.9D, 0.2D, null, 0.7D), array(0D,0D,1D,1D, 0D,0D,1D,1D, 0D,0D,1D,1D, 1D,0D,2D,1D), 8, 2, 0.5D)").collect()
    assert [tuple(r) for r in rows] == [(0, 0.9, 0.0, 0.0, 8.0, 8.0), (3, 0.7, 0.0, 8.0, 24.0, 16.0)]
    assert spark.range(1).select(F.lit(1)).count() == 1 and spark.sql("SELECT * FROM expand_detections(null, null, 8, 2, 0.5D)").count() == 0


def test_lists_find_neighbours_and_read_few(spark, tmp_path):
    m = clumps(np.random.default_rng(9), 60, 50, 16, 0.1)
    df = frame(spark, m)
    lists = L.build(df, str(tmp_path / "lists"))
    asked = df.where("asset_id % 50 = 0").select(F.col("asset_id").alias("query_id"), "vec")
    found, true = L.search(spark, lists, asked), L.search(spark, lists, asked, exact=True)
    plain = m.astype(np.float32).astype(float)
    want = {(q, r, int(j)) for q in range(0, len(m), 50) for r, j in enumerate(np.argsort(-np.round(plain @ plain[q], 12), kind="stable")[:20], 1)}
    assert {(r["query_id"], r["rank"], r["asset_id"]) for r in true.collect()} == want
    assert L.recall_at(found, true) >= 0.9 and lists.probes <= len(lists.centroids) / 8
    one = L.search(spark, lists, asked.limit(1))
    files = {f.rsplit("/", 2)[1] for f in spark.read.parquet(lists.path).where(F.col("list").isin([0])).inputFiles()}
    assert one.count() == 20 and sum(lists.sizes.values()) == len(m) and len(files) > 1


def test_lists_of_copies_nulls_and_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 16)
    df = frame(spark, np.repeat(np.eye(3), 40, axis=0)).unionByName(spark.createDataFrame([(None, [1.0, 0.0, 0.0]), (500, None)], "asset_id long, vec array<float>"))
    lists = L.build(df, str(tmp_path / "copies"), many=5)
    got = L.search(spark, lists, df.where("asset_id in (0, 500)").select(F.col("asset_id").alias("query_id"), "vec"), k=50, exact=True).orderBy("rank").collect()
    assert [r["asset_id"] for r in got] == list(range(50)) and [r["score"] for r in got] == [1.0] * 40 + [0.0] * 10
    none = L.build(df.limit(0), str(tmp_path / "none"))
    assert L.search(spark, none, df.select(F.col("asset_id").alias("query_id"), "vec")).count() == 0


@pytest.mark.parametrize("probes, most", [(9, 40), (3, 16_384), (9, 1)])
def test_visits_leave_in_bounded_batches(probes, most):
    """All visits of many queries at once, each with its vector, were gigabytes."""
    rng = np.random.default_rng(6)
    m, centres, parts = rng.standard_normal((700, 4)), rng.standard_normal((9, 4)), np.array([1, 0, 2, 3, 1, 1, 5, 1, 0])
    out = list(L._visits(m, centres, parts, probes, most))
    a_row = int(np.sort(parts)[::-1][:probes].sum())
    assert all(len(row) <= max(most, a_row) and len(set(row.tolist())) <= L.ROWS for row, _, _ in out) and len(out) > 1
    near = np.argsort(V._lengths(m, centres), axis=1, kind="stable")[:, :probes]
    want = [(i, int(c), p) for i, line in enumerate(near) for c in line for p in range(parts[c])]
    assert [tuple(map(int, x)) for r in out for x in zip(*r)] == want


def test_all_rows_train_the_lists(spark):
    rows = spark.range(120_000).select(F.col("id").alias("asset_id"), F.array(F.col("id").cast("double")).alias("vec"))
    assert L.trained(rows, 1, rounds=1).tolist() == [[59_999.5]]


@pytest.mark.parametrize("name", ["retrieval_accuracy", "vector_lists_exact"])
def test_exact_searches_measure_no_sample(spark, sf, monkeypatch, name):
    from lumora.plans import registry

    asked, search = [], L.search
    monkeypatch.setattr(L, "search", lambda spark, lists, *a, **k: asked.append((lists.probes, len(lists.centroids), k.get("exact"))) or search(spark, lists, *a, **k))
    registry.QUERIES[name](spark, sf)
    assert len(asked) == 1 and asked[0][0] == asked[0][1] and asked[0][2]
