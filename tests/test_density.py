"""Grid clusters against a plain run: random fields, one crowded place, ties, growth batch by batch."""

import random

import pytest
from pyspark.sql import functions as F

from lumora.operators.density import Grid, density_grid, grown

POINT = "id long, x double, y double, z double"


def plain(rows, eps, least):
    near = {a[0]: [b[0] for b in rows if (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2 <= eps * eps] for a in rows}
    core = {i for i, n in near.items() if len(n) >= least}
    top = {}
    for i in sorted(core):
        if i in top:
            continue
        stack = [i]
        top[i] = i
        while stack:
            for j in near[stack.pop()]:
                if j in core and j not in top:
                    top[j] = i
                    stack.append(j)
    return {r[0]: top.get(r[0], min((top[j] for j in near[r[0]] if j in core), default=None)) for r in rows}


def made(seed, n, wide, kinds):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        kind = rng.choice(kinds)
        if kind == "field":
            p = [rng.uniform(-wide, wide) for _ in range(3)]
        elif kind == "city":
            p = [5 + rng.gauss(0, 0.05), 5 + rng.gauss(0, 0.05), 5 + rng.gauss(0, 0.05)]
        elif kind == "rim":  # a crowd about eps away from the city
            p = [6 + rng.gauss(0, 0.05), 5 + rng.gauss(0, 0.05), 5 + rng.gauss(0, 0.05)]
        else:
            p = [1.0, 2.0, 3.0]
        out.append((i, *p))
    rng.shuffle(out)
    return out


def labels(df):
    return {r["id"]: r["cluster"] for r in df.select("id", "cluster").collect()}


@pytest.mark.parametrize(
    ("seed", "n", "wide", "kinds", "least"),
    [(1, 300, 3.0, ["field"], 4), (2, 400, 8.0, ["field", "city", "rim", "same"], 6), (3, 300, 2.5, ["field", "same"], 1), (4, 500, 6.0, ["city", "rim", "field"], 30)],
)
def test_equals_a_plain_run(spark, seed, n, wide, kinds, least):
    rows = made(seed, n, wide, kinds)
    assert labels(density_grid(spark.createDataFrame(rows, POINT), Grid(1.0, least))) == plain(rows, 1.0, least)


def test_everything_in_one_place(spark):
    df = spark.range(20_000).select("id", F.lit(0.5).alias("x"), (F.rand(3) * 0.01).alias("y"), (F.rand(4) * 0.01).alias("z"))
    out = density_grid(df, Grid(1.0, 5))
    assert out.groupBy("cluster", "core").count().collect() == [(0, True, 20_000)]
    odd = spark.createDataFrame([(1, None, 1.0, 1.0), (2, 1.0, 1.0, 1.0)], POINT)
    assert labels(density_grid(odd, Grid(1.0, 2))) == {1: None, 2: None}
    assert density_grid(odd.limit(0), Grid(1.0, 2)).count() == 0


def test_growth_equals_the_full_run(spark):
    rows = made(5, 330, 3.2, ["field", "field", "field", "same", "city"])  # ids in mixed order: later ones may be smaller
    grid, have = Grid(1.0, 5), []
    state = density_grid(spark.createDataFrame(rows[:150], POINT), grid)
    have += rows[:150]
    for a, b in ((150, 220), (220, 330)):
        state = grown(state, spark.createDataFrame(rows[a:b], POINT), grid)
        have += rows[a:b]
        assert labels(state) == plain(have, 1.0, 5)


def test_wide_bands_find_every_near_pair(spark):
    from lumora.operators import analytics as A

    rng = random.Random(11)
    base = [rng.getrandbits(64) for _ in range(60)]
    values = base + [b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(9))) for b in base for _ in range(6)]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame(list(enumerate(signed)), "id long, hash long")
    for most in (0, 3, 6):
        first = {v: i for i, v in reversed(list(enumerate(values)))}
        own = sorted(first.values())
        ok = lambda x, y: (x ^ y).bit_count() <= most and (x >> 60 == y >> 60 or (x >> 56) & 15 == (y >> 56) & 15)
        want = {(i, j) for i in own for j in own if i < j and ok(values[i], values[j])} | {(first[v], i) for i, v in enumerate(values) if first[v] != i}
        assert {(r["a"], r["b"]) for r in A.near_hashes(df, most).collect()} == want
    assert len(A._wide_bands(10**7, 6, ((60, 4), (56, 4)))) > 7 and A._wide_bands(1000, 20, ((60, 4), (56, 4))) == [[(60, 4)], [(56, 4)]]


def test_many_members_of_a_key_meet_in_blocks(spark, monkeypatch):
    from lumora.operators import analytics as A

    rng = random.Random(4)
    hashes = {(5 << 60 | rng.getrandbits(60)) - (1 << 63) for _ in range(300)}
    rows = list(enumerate(sorted(hashes)))
    df = spark.createDataFrame(rows, "id long, hash long")
    want = {(a, b) for a, x in rows for b, y in rows if a < b and ((x ^ y) & (1 << 64) - 1).bit_count() <= 22}
    plain = A.near_hashes(df, 22)
    monkeypatch.setattr(A, "FEW", 8)
    monkeypatch.setattr(A, "HASH_BLOCK", 50)
    for found in (plain, A.near_hashes(df, 22)):
        got = [(r["a"], r["b"]) for r in found.collect()]
        assert len(got) == len(set(got)) and set(got) == want
